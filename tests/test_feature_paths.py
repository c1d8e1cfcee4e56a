"""Every path of the silver features, chosen by the inputs that are there."""

import pytest

from kpiforge.plans import features as X


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def by_year(df):
    return {r["year"]: r for r in df.orderBy("year").collect()}


def test_affordability_paths(spark):
    nat = frame(spark, [(2000, 100.0), (2001, 150.0), (2002, 201.0)], "year long, gdp_pc double")
    regions = frame(spark, [("A",), ("B",)], "region string")
    income = frame(spark, [("A", 2001, 300.0)], "region string, year long, income double")
    full = X.affordability_from(nat, income, regions).collect()
    assert len(full) == 6
    hit = [r for r in full if r.median_income is not None]
    assert [(r.region, r.year, r.affordability_index, r.price_to_income_ratio) for r in hit] == [("A", 2001, 25.0, 0.5)]
    for missing in (None, income.filter("year = 0")):
        got = by_year(X.affordability_from(nat, missing, regions))
        assert {y: (r.region, r.affordability_index) for y, r in got.items()} == {
            2000: ("NATIONAL", 0.0), 2001: ("NATIONAL", 49.0), 2002: ("NATIONAL", 99.0)}


def test_interest_rate_paths(spark):
    rates = frame(spark, [(2000, 4.0), (2000, 6.0), (2001, 7.0)], "year long, rate double")
    lending = frame(spark, [(2000, 9.0), (2001, 8.5)], "year long, value double")
    assert {y: (r.ocr_value, r.ocr_change_bps) for y, r in by_year(X.interest_rate_from(rates, lending)).items()} == {2000: (5.0, None), 2001: (7.0, 200.0)}
    assert {y: r.ocr_value for y, r in by_year(X.interest_rate_from(None, lending)).items()} == {2000: 9.0, 2001: 8.5}
    assert {y: r.ocr_value for y, r in by_year(X.interest_rate_from(rates.limit(0), lending)).items()} == {2000: 9.0, 2001: 8.5}
    assert X.interest_rate_from(None, None) is None


def test_rent_income_paths(spark):
    rent = frame(spark, [("A", 2000, 1, 400.0), ("A", 2000, 2, 420.0)], "region string, year long, quarter int, median_weekly_rent double")
    income = frame(spark, [("A", 2000, 52000.0), ("B", 2000, 0.0)], "region string, year long, median_income double")
    infl = frame(spark, [(2000, 2.0)], "year long, general_inflation double")
    got = X.rent_income_from(rent, income, infl).orderBy("quarter").collect()
    assert [(r.quarter, r.rent_to_income_ratio, r.rent_inflation_rate, r.affordability_erosion) for r in got] == [(1, 40.0, None, -2.0), (2, 42.0, 5.0, 3.0)]
    proxy = {r.region: r for r in X.rent_income_from(None, income, infl).collect()}
    assert proxy["A"].median_weekly_rent == 300.0 and proxy["A"].quarter == 4 and proxy["A"].rent_to_income_ratio == 30.0
    assert proxy["B"].median_weekly_rent == 0.0 and proxy["B"].rent_to_income_ratio is None
    assert [r.median_income for r in X.rent_income_from(rent, None, infl).collect()] == [None, None]
    assert X.rent_income_from(None, None, infl) is None


def test_macro_volatility_needs_three_of_four(spark):
    series = lambda xs, first=2000: frame(spark, [(first + i, float(x)) for i, x in enumerate(xs)], "year long, value double")
    four = {"gdp": series([100, 110, 121, 150]), "inflation": series([1, 2, 3, 4]), "unemployment": series([5, 5, 5, 5]), "interest": series([2, 4, 2, 4], 2001)}
    got = by_year(X.macro_volatility_from(four))
    assert sorted(got) == [2000, 2001, 2002, 2003, 2004]            # outer: the years of all series
    assert got[2002].inflation_volatility == pytest.approx(1.0) and got[2002].unemployment_volatility == 0.0
    three = {k: v for k, v in four.items() if k != "gdp"}
    got = by_year(X.macro_volatility_from(three))
    assert got[2002].gdp_volatility is None and got[2002].macroeconomic_volatility_index is not None
    assert X.macro_volatility_from({k: four[k] for k in ("gdp", "inflation")}) is None
    assert X.macro_volatility_from({**three, "interest": four["interest"].limit(0)}) is None

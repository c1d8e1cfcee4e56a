from pyspark.sql import functions as F

from kpiforge.operators.records import split, summary, validate


def test_schemas_of_six_sources(spark):
    cases = [
        ("world_bank", '{"year": 2020, "value": 1.5}', []),
        ("world_bank", '{"year": "1960", "value": "2"}', []),
        ("world_bank", '{"year": 1959, "value": null}', ["year: below 1960", "value: required"]),
        ("world_bank", '{"year": 2020.5, "value": "x"}', ["year: not a whole number", "value: not a number"]),
        ("rbnz", '{"date": "2024-01-31", "value": 5.5}', []),
        ("rbnz", '{"date": "2024-01-31T10:00:00Z", "value": 5.5}', []),
        ("rbnz", '{"date": "31/01/2024", "value": 5.5}', ["date: not a date"]),
        ("rbnz", '{"date": "2024-02-31", "value": 5.5}', ["date: not a date"]),
        ("stats_nz", '{"region": "", "year": 2031, "population": 3.5}', ["region: too short", "year: above 2030", "population: not a whole number"]),
        ("mbie_tourism", '{"region": "North", "year": 1990, "visitors": null}', []),
        ("linz", '{"year": 2000}', ["region: required"]),
        ("reinz", '{"region": "N", "year": 2000, "month": 13}', ["month: above 12"]),
        ("reinz", '{"region": "N", "year": 2000, "month": 0}', ["month: below 1"]),
        ("linz", "no json", ["not an object"]),
        ("linz", None, ["not an object"]),
        ("other", "{}", ["no schema for source other"]),
        (None, "{}", ["no schema for source null"]),
    ]
    rows = spark.createDataFrame([(s, i, p) for i, (s, p, _) in enumerate(cases)], "source string, id long, payload string")
    checked = validate(rows)
    assert {r.id: list(r.errors) for r in checked.collect()} == {i: e for i, (_, _, e) in enumerate(cases)}
    good, bad = split(checked)
    assert good.columns == ["source", "id", "payload"] and good.count() == sum(not e for _, _, e in cases)
    assert bad.count() == sum(bool(e) for _, _, e in cases)


def test_summary_keeps_the_first_ten_errors(spark):
    rows = [("linz", i, '{"region": "N", "year": 2000}' if i % 3 else '{"region": "N"}') for i in range(90)] + [("rbnz", 1, '{"date": "2024-01-01", "value": 1}')]
    got = {r.source: r for r in summary(validate(spark.createDataFrame(rows, "source string, id long, payload string").repartition(5))).collect()}
    assert (got["linz"].valid, got["linz"].valid_count, got["linz"].invalid_count) == (False, 60, 30)
    assert got["linz"].errors == [f"Record {i}: year: required" for i in range(0, 30, 3)]
    assert got["rbnz"].valid and got["rbnz"].errors == []


def test_a_record_is_parsed_once(spark):
    """Filters on the errors, own or the optimizer's, do not copy the parse."""
    checked = validate(spark.createDataFrame([("linz", 1, "{}")], "source string, id long, payload string").repartition(2))
    for frame in (checked.filter("NOT is_valid"), checked.select(F.explode("errors")), checked.filter("is_valid").select("id")):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
        frame.collect()

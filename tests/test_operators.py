"""Literal-row tests of the operators, with hand-computed values and the
edge rows of FIXTURES.md part E (NULLs, ties, gaps, zero denominators)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpiforge.functions import ladders as L
from kpiforge.functions.scalar import clamp, num, safe_div, snake_case
from kpiforge.operators.aggregates import exact_median, safe_corr
from kpiforge.operators.expectations import run_suite
from kpiforge.operators.forecast import backtest_summary, fold_metrics, positions, walk_forward
from kpiforge.operators.joins import asof_backward, asof_backward_bucketed
from kpiforge.operators.windows import cumulative_change, minmax_scale, pct_change, series_window
from kpiforge.streaming.alerts import cooldown_batch


def test_num_rounds_half_up_on_decimals(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (1.005,), (0.125,)], "x double")
    got = [r[0] for r in df.select(num("x", 0).alias("a")).collect()]
    assert got == [3.0, -3.0, 1.0, 0.0]
    got2 = [r[0] for r in df.select(num("x", 2)).collect()]
    assert got2 == [2.5, -2.5, 1.01, 0.13]


def test_safe_div_and_clamp(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (6.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(safe_div("a", "b")).collect()]
    assert got == [None, None, 2.0]
    got = [r[0] for r in df.select(clamp("a", 2, 5)).collect()]
    assert got == [2.0, None, 5.0]


def test_exact_median_even_odd_ties_nulls(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 4.0), ("b", 1.0), ("c", 5.0), ("c", 5.0), ("c", 1.0),
            ("c", 9.0), ("d", None), ("d", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    assert got == {"a": 2.0, "b": 2.5, "c": 5.0, "d": 7.0}


def test_exact_median_matches_builtin_on_large_group(spark):
    df = spark.range(0, 20001).select((F.col("id") % 7).alias("k"), ((F.col("id") * 7919) % 10007).cast("double").alias("v"))
    got = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    ref = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == ref


def test_safe_corr_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "x double, y double")
    assert df.select(safe_corr("x", "y")).first()[0] is None
    df2 = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (4.0, None)], "x double, y double")
    assert abs(df2.select(safe_corr("x", "y")).first()[0] - 1.0) < 1e-12


def _ts(d, h=0, m=0):
    return dt.datetime(2024, 1, d, h, m)


def _brute_asof(left, right):
    out = {}
    for lid, k, t in left:
        cands = [r for r in right if r[0] == k and r[1] <= t]
        out[lid] = max(cands, key=lambda r: r[1])[2] if cands else None
    return out


def test_asof_backward_and_bucketed_match_brute_force(spark):
    left = [(1, "u", _ts(1, 5)), (2, "u", _ts(2, 1)), (3, "u", _ts(5, 0)), (4, "v", _ts(1, 0)),
            (5, "u", _ts(1, 6)), (6, "w", _ts(3, 0))]
    right = [("u", _ts(1, 6), 10.0), ("u", _ts(1, 2), 5.0), ("u", _ts(4, 23), None), ("v", _ts(2, 0), 1.0),
             ("w", _ts(1, 0), 3.0)]
    ldf = spark.createDataFrame(left, "id long, k string, t timestamp_ntz")
    rdf = spark.createDataFrame(right, "k string, rt timestamp_ntz, val double")
    want = _brute_asof(left, right)
    plain = {r["id"]: r["val"] for r in asof_backward(ldf, rdf, ["k"], "t", "rt", ["val"]).collect()}
    buck = {r["id"]: r["val"] for r in
            asof_backward_bucketed(ldf, rdf, ["k"], "t", "rt", ["val"], bucket=F.to_date).collect()}
    assert plain == want
    assert buck == want
    # equal time: the right row at 1 06:00 matches the left row at 1 06:00
    assert want[5] == 10.0
    # a matched right row whose value is NULL stays NULL (no fallback)
    assert want[3] is None


def test_windows_pct_change_cumulative_and_scaling(spark):
    rows = [("r", 2001, 10.0), ("r", 2002, 12.0), ("r", 2004, 0.0), ("r", 2005, 3.0), ("s", 2001, -5.0), ("s", 2002, 5.0)]
    df = spark.createDataFrame(rows, "region string, year int, x double")
    w = series_window("region", "year")
    got = {(r["region"], r["year"]): (r["p"], r["c"]) for r in
           df.select("region", "year", num(pct_change("x", w), 4).alias("p"),
                     num(cumulative_change("x", w), 4).alias("c")).collect()}
    assert got[("r", 2002)] == (20.0, 20.0)
    assert got[("r", 2005)][0] is None          # previous value 0 → no pct change
    assert got[("s", 2002)][1] == 0.0           # negative first value → cumulative 0
    sc = minmax_scale(df, "x", "s", eps=0.01, digits=1)
    vals = {r["x"]: r["s"] for r in sc.collect()}
    assert vals[-5.0] == 0.0 and vals[12.0] == 99.9


def test_cooldown_rule(spark):
    base = dt.datetime(2024, 1, 1, 0, 0, 0)
    t = lambda s: base + dt.timedelta(seconds=s)
    rows = [(1, "k", t(0), "ERROR"), (2, "k", t(100), "ERROR"), (3, "k", t(3600), "ERROR"),
            (4, "k", t(3700), "CRITICAL"), (5, "k", t(4000), "ERROR"), (6, "k", t(3700 + 3600), "ERROR"),
            (7, "j", t(50), "INFO")]
    df = spark.createDataFrame(rows, "alert_id long, key string, ts timestamp_ntz, severity string")
    got = {r["alert_id"]: r["dispatched"] for r in cooldown_batch(df, 3600).collect()}
    # 2 inside the cooldown; 3 exactly at it; 4 critical passes and stamps; 5 inside 4's window; 6 at 4 + cooldown
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True}
    capped = {r["alert_id"]: r["dispatched"] for r in cooldown_batch(df, 3600, max_per_run=3).collect()}
    assert [k for k, v in sorted(capped.items()) if v] == [1, 3, 7]
    over = {r["alert_id"] for r in cooldown_batch(df, 3600, max_per_run=3).filter("over_cap").collect()}
    assert over == {4, 6}


def test_cooldown_equal_times(spark):
    base = dt.datetime(2024, 1, 1)
    t = lambda s: base + dt.timedelta(seconds=s)
    rows = [(1, "k", t(0), "ERROR"), (2, "k", t(3600), "ERROR"), (3, "k", t(3600), "ERROR"),
            (4, "k", t(3600), "CRITICAL"), (5, "k", t(7199), "INFO"), (6, "k", t(7200), "INFO")]
    df = spark.createDataFrame(rows, "alert_id long, key string, ts timestamp_ntz, severity string")
    got = {r["alert_id"]: r["dispatched"] for r in cooldown_batch(df, 3600).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}


def test_expectations_suite_and_unknown_type(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "name string, value int")
    suite = [{"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "name", "mostly": 0.66}},
             {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "value", "min_value": 1, "max_value": 2}},
             {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "value"}},
             {"expectation_type": "expect_column_values_to_be_of_type", "kwargs": {"column": "value", "type_": "float64"}},
             {"expectation_type": "expect_table_columns_to_match_set", "kwargs": {"column_set": ["name", "id"]}}]
    got = [r["success"] for r in run_suite(df, suite).orderBy("idx").collect()]
    assert got == [True, False, True, True, False]
    with pytest.raises(ValueError):
        run_suite(df, [{"expectation_type": "expect_something_new", "kwargs": {}}])


def test_backtest_short_series_and_horizon_one(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([10, 11, 12.1, 13.31, 0.0, 14], start=1)] + [("b", 1, 5.0), ("b", 2, 6.0)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    pts = positions(df, "k", ["t"], "x")
    fc = walk_forward(pts, "k", horizon=1, min_train=3)
    fm = fold_metrics(fc, "k", 1)
    s = {r["k"]: r for r in backtest_summary(fm, pts.select("k").distinct(), "k").collect()}
    assert s["b"]["n_folds"] == 0 and s["b"]["mean_mape"] == 0.0
    assert s["a"]["n_folds"] == 3
    assert s["a"]["mean_directional_accuracy"] == 50.0
    first = {r["train_end"]: r for r in fc.collect()}
    assert abs(first[3]["pred"] - 12.1 * 1.1 ) < 1e-9       # mean growth 10 % over the first 3 points


def test_ladders(spark):
    rows = [("Composite Quality Score", 85.0, "score", "composite", "Real data"),
            ("GDP Growth YoY", -1.0, "%", "economic", "Synthetic"),
            ("Supply Gap", 12.0, "count", "supply", "Stats NZ"),
            ("Median Price", 1234567.0, "NZD", "price", "")]
    df = spark.createDataFrame(rows, "name string, value double, unit string, category string, source string")
    out = df.select(L.kpi_status("name", "value", "category").alias("s"), L.kpi_trend("name", "value").alias("t"),
                    L.format_value("value", "unit").alias("f"),
                    L.kpi_confidence(F.lit("d"), "unit", "category", "source").alias("c")).collect()
    assert [r["s"] for r in out] == ["Excellent", "Declining", "Moderate", "Measured"]
    assert [r["t"] for r in out] == ["up", "neutral", "neutral", "neutral"]
    assert [r["f"] for r in out] == ["85.0", "-1.0%", "12.00", "$1.2M"]
    assert [r["c"] for r in out] == [90.0, 65.0, 90.0, 75.0]


def test_snake_case(spark):
    from kpiforge.functions.scalar import snake_name
    names = [" Event ID ", "User.Id", "Value ($)", "__a--b__", " Time-Stamp "]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    got = [r[0] for r in df.select(snake_case("x")).collect()]
    assert got == ["event_id", "user_id", "value", "a_b", "time_stamp"]
    assert [snake_name(n) for n in names] == got


ALERTS = "alert_id long, key string, ts timestamp_ntz, severity string"


def _batch(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, k, base + dt.timedelta(seconds=s), sev) for i, k, s, sev in rows], ALERTS)


def test_cooldown_stream_decides_as_it_runs(spark, tmp_path):
    """Slices of disordered alerts, a query restarted for each: the same
    decisions as the batch operator, most of them before the end."""
    import random

    from kpiforge.streaming.alerts import CooldownStream

    rng = random.Random(3)
    times = sorted(rng.randrange(6 * 86400) for _ in range(600))
    rows = [(i, rng.choice(["a", "b", None]), t, rng.choice(["INFO", "ERROR", "CRITICAL", None])) for i, t in enumerate(times)]
    schema = "alert_id long, key string, ts timestamp, severity string"
    folder = str(tmp_path / "log")
    stream = CooldownStream(spark, lambda: spark.readStream.schema(schema).parquet(folder), 3600, delay_s=7200)
    before = 0
    for k in range(3):
        part = rows[200 * k:200 * k + 200]
        rng.shuffle(part)
        _batch(spark, part).repartition(2).write.mode("append").parquet(folder)
        stream.run()                                   # a new query on the same checkpoint
        decided = stream.result().count()
        assert decided > before
        before = decided
    stream.run()                                       # nothing new: nothing is decided twice
    assert before == stream.result().count() and before > 500
    stream.close()
    got = {r.alert_id: (r.key, r.severity, r.dispatched) for r in stream.result().collect()}
    want = {r.alert_id: (r.key, r.severity, r.dispatched) for r in cooldown_batch(_batch(spark, rows), 3600).collect()}
    assert len(got) == stream.result().count() and got == want


def test_streaming_queries_read_a_folder(spark, tmp_path):
    from kpiforge.plans import q_monitor

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    sf = str(tmp_path)
    ev.repartition(3).write.parquet(f"{sf}/events.parquet")
    pick = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = cooldown_batch(q_monitor.alerts(ev), q_monitor.COOLDOWN_S).select("alert_id", "key", "severity", "dispatched")
    assert pick(q_monitor.alert_cooldown_stream(spark, sf)) == pick(want)
    assert pick(q_monitor.upsert_stream(spark, sf)) == pick(q_monitor._latest_per_user(ev, ["event_type", "value"]))


def test_upsert_stream_restart_and_repeated_epoch(spark, tmp_path):
    """Late and repeated rows, a restart, an epoch written twice."""
    from kpiforge.streaming.incremental import current_rows, run_upsert_stream

    schema = "k string, v int, at int"
    log, target, checkpoint = (str(tmp_path / x) for x in ("log", "target", "checkpoint"))
    files = [[("a", 1, 1), ("b", 1, 5), ("b", 0, 2), (None, 7, 1)], [("a", 2, 3), ("c", 1, 1)], [("b", 9, 4), ("a", 3, 9), (None, 8, 2)]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        run_upsert_stream(spark.readStream.schema(schema).parquet(log), ["k"], ["at"], target, checkpoint)
    names = spark.read.parquet(target).schema
    want = [("a", 3, 9), ("b", 1, 5), ("c", 1, 1), (None, 8, 2)]
    pick = lambda: sorted((tuple(r) for r in current_rows(spark, target, names, ["k"]).select("k", "v", "at").collect()), key=str)
    assert pick() == sorted(want, key=str)
    # The last epoch's commit is lost: the restarted query writes it again.
    import os

    last = max(int(x) for x in os.listdir(f"{checkpoint}/commits") if x.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    count = spark.read.parquet(target).count()
    run_upsert_stream(spark.readStream.schema(schema).parquet(log), ["k"], ["at"], target, checkpoint)
    assert pick() == sorted(want, key=str) and spark.read.parquet(target).count() == count


def test_exact_median_of_one_repeated_value(spark):
    """All values equal: one distinct value, whatever its count."""
    df = spark.range(200_000).select(F.lit("k").alias("k"), F.lit(7.5).alias("v"))
    assert [tuple(r) for r in exact_median(df, ["k"], "v").collect()] == [("k", 7.5)]
    weighted = spark.createDataFrame([("k", 1.0, 10 ** 12), ("k", 2.0, 10 ** 12), (None, 3.0, 5)], "k string, v double, n long")
    assert {r["k"]: r["median"] for r in exact_median(weighted, ["k"], "v", weight="n").collect()} == {"k": 1.5, None: 3.0}


def test_shared_dir_when_unset():
    """No spark.checkpoint.dir: a private folder is registered through
    setCheckpointDir (the conf is never modified) and reused."""
    from kpiforge.session import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

        def set(self, *a):
            raise AssertionError("conf must not be modified")

    class Ctx:
        applicationId = "app-test"
        master = "local[1]"
        _dir = None

        def getCheckpointDir(self):
            return self._dir

        def setCheckpointDir(self, d):
            self._dir = d

    class Sess:
        conf = Conf()
        sparkContext = Ctx()

    s = Sess()
    d1 = shared_dir(s)
    assert s.sparkContext.getCheckpointDir() == d1
    assert shared_dir(s) == d1


def test_exact_median_many_values(spark):
    df = spark.range(0, 30001).select((F.col("id") % 3).alias("k"),
                                      ((F.col("id") * 7919) % 10007).cast("double").alias("v"))
    ref = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    got = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    assert got == ref


def test_ar_forecast_recovers_known_process(spark):
    """M7 on a noiseless AR(1) series y_t = 2 + 0.5·y_{t-1} (plus a second
    series): the fitted model forecasts the recursion exactly, per group."""
    from kpiforge.operators.forecast import ar_forecast_group
    rows, y = [], 10.0
    for t in range(1, 41):
        rows.append(("a", t, y))
        y = 2 + 0.5 * y
    rows += [("b", t, 3.0 * t + 1) for t in range(1, 41)]          # a linear trend
    df = spark.createDataFrame(rows, "region string, t int, x double")
    schema = "region string, p int, d int, aic double, step int, forecast double"
    out = {(r["region"], r["step"]): r["forecast"] for r in
           df.groupBy("region").applyInPandas(ar_forecast_group("region", 3), schema).collect()}
    want = []
    for _ in range(3):
        want.append(y)
        y = 2 + 0.5 * y
    for s in range(3):
        assert abs(out[("a", s + 1)] - want[s]) < 1e-6
        assert abs(out[("b", s + 1)] - (3.0 * (41 + s) + 1)) < 1e-6


def test_exact_median_over_all_kinds_of_doubles(spark):
    """Signs, zeros, infinities, tiny and huge numbers, weights."""
    import math
    import random
    import statistics

    rng = random.Random(5)
    pool = [0.0, -0.0, 1.0, -1.0, 1e-300, -1e-300, 1e300, math.inf, -math.inf, 5.0, 5.01, 5.02]
    rows = [(k, rng.choice([*pool, rng.uniform(-9, 9), 10 ** rng.uniform(-20, 20)]), rng.randint(1, 3)) for k in range(6) for _ in range(rng.choice([1, 2, 7, 60]))]
    rows += [(9, 7.5, 1)] * 1000 + [(None, 2.0, 1), (None, 4.0, 3)]
    df = spark.createDataFrame(rows, "k int, v double, w int")
    got = {r.k: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    weighted = {r.k: r["median"] for r in exact_median(df, ["k"], "v", weight="w").collect()}
    for k in {r[0] for r in rows}:
        plain = statistics.median([v for j, v, _ in rows if j == k])
        many = statistics.median([v for j, v, w in rows if j == k for _ in range(w)])
        assert (got[k] == plain or math.isnan(plain)) and (weighted[k] == many or math.isnan(many))

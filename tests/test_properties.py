"""Property tests: the distributed operators against brute force on random
small inputs (NULLs, ties, gaps, several keys)."""

import datetime as dt
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpiforge.operators.aggregates import exact_median
from kpiforge.operators.joins import asof_backward, asof_backward_bucketed
from kpiforge.streaming.alerts import cooldown_batch

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

values = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]),
                            st.one_of(st.none(), st.integers(-5, 5).map(float))), min_size=1, max_size=40)


@SETTINGS
@given(rows=values)
def test_exact_median_property(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    want = {}
    for k in {k for k, _ in rows}:
        vs = [v for kk, v in rows if kk == k and v is not None]
        if vs:
            want[k] = float(statistics.median(vs))
    assert got == want


base = dt.datetime(2024, 1, 1)
times = st.integers(0, 5 * 24 * 60).map(lambda m: base + dt.timedelta(minutes=m))


@SETTINGS
@given(left=st.lists(st.tuples(st.sampled_from(["u", "v"]), times), min_size=1, max_size=25),
       right=st.lists(st.tuples(st.sampled_from(["u", "v"]), times, st.integers(0, 9)), max_size=25, unique_by=lambda r: (r[0], r[1])))
def test_asof_property(spark, left, right):
    lrows = [(i, k, t) for i, (k, t) in enumerate(left)]
    ldf = spark.createDataFrame(lrows, "id long, k string, t timestamp_ntz")
    rdf = spark.createDataFrame([(k, t, float(v)) for k, t, v in right] or [("x", base, 0.0)],
                                "k string, rt timestamp_ntz, val double")
    want = {}
    for i, k, t in lrows:
        c = [(rt, v) for kk, rt, v in right if kk == k and rt <= t]
        want[i] = float(max(c)[1]) if c else None
    plain = {r["id"]: r["val"] for r in asof_backward(ldf, rdf, ["k"], "t", "rt", ["val"]).collect()}
    buck = {r["id"]: r["val"] for r in asof_backward_bucketed(ldf, rdf, ["k"], "t", "rt", ["val"], F.to_date).collect()}
    assert plain == want
    assert buck == want


def _brute_cooldown(rows, cd):
    last, out = {}, {}
    for aid, k, t, sev in sorted(rows, key=lambda r: (r[2], r[0])):
        ok = sev == "CRITICAL" or k not in last or (t - last[k]).total_seconds() >= cd
        if ok:
            last[k] = t
        out[aid] = ok
    return out


@SETTINGS
@given(ev=st.lists(st.tuples(st.sampled_from(["k", "j"]), st.integers(0, 4 * 3600).map(lambda s: base + dt.timedelta(seconds=s * 7)),
                             st.sampled_from(["INFO", "ERROR", "CRITICAL"])), min_size=1, max_size=30))
def test_cooldown_property(spark, ev):
    rows = [(i, k, t, s) for i, (k, t, s) in enumerate(ev)]
    df = spark.createDataFrame(rows, "alert_id long, key string, ts timestamp_ntz, severity string")
    for cooldown in (3600, 60, 0):
        got = {r["alert_id"]: r["dispatched"] for r in cooldown_batch(df, cooldown).collect()}
        assert got == _brute_cooldown(rows, cooldown)


@pytest.mark.parametrize("seed", range(3))
def test_cooldown_over_many_chunks(spark, seed):
    """Dense and sparse keys over hundreds of chunks, ids beyond 10^12."""
    rng = random.Random(seed)
    rows, t = [], base
    for i in range(4000):
        t += dt.timedelta(seconds=rng.choice([0, 1, 5, 30, 60, 400, 9000]))
        rows.append((10 ** 13 + i, rng.choice(["hot", "hot", "cold", None]), t, "CRITICAL" if rng.random() < 0.01 else "INFO"))
    df = spark.createDataFrame(rows, "alert_id long, key string, ts timestamp_ntz, severity string")
    got = {r["alert_id"]: r["dispatched"] for r in cooldown_batch(df, 60).collect()}
    assert got == _brute_cooldown(rows, 60)

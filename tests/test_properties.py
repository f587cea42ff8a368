"""Property checks: random plans against a brute-force evaluation in Python."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from planwise import Dataset, Filter, Plan, compile_plan
from planwise.operators.dedupe import drop_exact_duplicates

GROUPS = st.sampled_from(["a", "b", "c", None])
VALUES = st.one_of(st.none(), st.integers(-50, 50).map(float))
ROWS = st.lists(st.tuples(GROUPS, VALUES, st.integers(1, 5).map(float)), min_size=1, max_size=30)


def brute(rows, aggregation, missing, threshold):
    kept = [r for r in rows if r[2] > threshold]
    if missing == "exclude":
        # Analysis fields are the group key plus the metric; a count has no metric.
        kept = [r for r in kept if r[0] is not None and (aggregation == "count" or r[1] is not None)]
    out = {}
    for g in {r[0] for r in kept}:
        vals = [r[1] for r in kept if r[0] == g]
        nn = [v for v in vals if v is not None]
        if aggregation == "count":
            out[g] = len(vals)
        elif not nn:
            out[g] = None
        elif aggregation == "sum":
            out[g] = sum(nn)
        elif aggregation == "mean":
            out[g] = sum(nn) / len(nn)
        elif aggregation == "min":
            out[g] = min(nn)
        else:
            out[g] = max(nn)
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=ROWS, aggregation=st.sampled_from(["sum", "mean", "min", "max", "count"]),
       missing=st.sampled_from(["keep", "exclude"]), threshold=st.integers(0, 4).map(float))
def test_plan_matches_brute_force(spark, rows, aggregation, missing, threshold):
    ds = Dataset.from_frame(spark.createDataFrame(rows, "g string, v double, w double"))
    plan = Plan(group_by=["g"], metric=None if aggregation == "count" else "v", aggregation=aggregation,
                missing=missing, filters=[Filter("w", "gt", threshold)])
    got = {r["g"]: r["value"] for r in compile_plan(ds, plan).df.collect()}
    expect = brute(rows, aggregation, missing, threshold)
    assert set(got) == set(expect)
    for k, v in expect.items():
        assert (got[k] is None and v is None) or math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-9)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(GROUPS, VALUES), min_size=1, max_size=40))
def test_hash_dedupe_equals_shuffle_dedupe(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    a = sorted(map(tuple, drop_exact_duplicates(df, "hash").collect()), key=repr)
    b = sorted(map(tuple, drop_exact_duplicates(df, "shuffle").collect()), key=repr)
    assert a == b == sorted(set(rows), key=repr)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=ROWS)
def test_group_sums_add_up_and_ratio_identity(spark, rows):
    ds = Dataset.from_frame(spark.createDataFrame(rows, "g string, v double, w double"))
    groups = compile_plan(ds, Plan(group_by=["g"], metric="v", missing="keep")).df.collect()
    total = compile_plan(ds, Plan(metric="v", missing="keep")).df.first()["value"]
    parts = [r["value"] for r in groups if r["value"] is not None]
    assert (total is None and not parts) or total == pytest.approx(sum(parts))


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(days=st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 86399), VALUES), min_size=1, max_size=40),
       grain=st.sampled_from(["day", "week", "month", "year"]))
def test_time_bucket_groups_match_labels(spark, days, grain):
    """Grouping on the bucket start and labelling afterwards gives the same
    groups and sums as grouping on the label text of every row."""
    import datetime

    from pyspark.sql import functions as F

    from planwise.functions.exprs import time_bucket

    base = datetime.datetime(2019, 1, 1)
    rows = [(base + datetime.timedelta(days=d, seconds=s), v) for d, s, v in days]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    got = {r["t"]: r["value"] for r in compile_plan(
        Dataset.from_frame(df), Plan(group_by=["t"], metric="v", time_grain=grain, missing="keep")).df.collect()}
    expect = {r["t"]: r["value"] for r in df.groupBy(time_bucket(F.col("t"), grain).alias("t"))
              .agg(F.sum("v").alias("value")).collect()}
    assert set(got) == set(expect)
    for k, v in expect.items():
        assert (got[k] is None and v is None) or math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-9)


DATE_PIECES = st.lists(st.one_of(
    st.sampled_from(["2026", "1999", "12345", "26", "-", "/", " ", "  ", "\t", ":", ".", "T", "t", "+", "x"]),
    st.integers(0, 99).map(str), st.integers(0, 999999).map(str)), min_size=1, max_size=12).map("".join)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.one_of(DATE_PIECES, st.sampled_from([
    "2026-01-31", " 2026-1-1 ", "2026/02/03 04:05", "2026-02-30", "2026-1-1T3:4:5", "2026-1-1t03:04:05.123",
    "2026-12-31 23:59:59.999999", "2026-1-1 1:2:3.", "+2026-1-1", "2026-1-1 24:00"])), min_size=1, max_size=40))
def test_layout_guard_never_hides_a_parse(spark, texts):
    """Guarding each layout's parse with its shape regex gives exactly the
    unguarded try_to_timestamp result, value by value."""
    from pyspark.sql import functions as F

    from planwise.operators.profile import DATE_FORMATS, _date
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    cols = []
    for k, fmt in enumerate(DATE_FORMATS):
        plain = F.try_to_timestamp(F.trim("s"), F.lit(fmt)).cast("timestamp_ntz")
        cols.append(F.count_if(~_date(F.col("s"), fmt).eqNullSafe(plain)).alias(f"diff{k}"))
    diffs = df.agg(*cols).first()
    assert all(v == 0 for v in diffs), diffs


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(GROUPS, VALUES), min_size=1, max_size=40), hot=st.integers(0, 60))
def test_profile_matches_brute_force(spark, rows, hot):
    """Per-column nulls, distinct values and min/max, with one value repeated
    ``hot`` extra times (a hot key collapses map-side)."""
    from planwise.operators.profile import profile
    rows = rows + [("a", 7.0)] * hot
    ds = Dataset.from_frame(spark.createDataFrame(rows, "g string, v double"))
    got = {r["field"]: r for r in profile(ds).collect()}
    for i, name in enumerate(("g", "v")):
        vals = [r[i] for r in rows]
        nn = [x for x in vals if x is not None]
        assert got[name]["nulls"] == len(vals) - len(nn)
        assert got[name]["unique"] == len(set(nn))
    nn = [r[1] for r in rows if r[1] is not None]
    assert got["v"]["min"] == (str(min(nn)) if nn else None) and got["v"]["max"] == (str(max(nn)) if nn else None)
    assert got["g"]["min"] is None and got["g"]["dtype"] == "string"

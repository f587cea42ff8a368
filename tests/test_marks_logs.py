"""Chart-data operators, run-log analytics and streaming."""

import datetime as dt
from collections import Counter

import pytest

from planwise import Dataset, Plan, compile_plan
from planwise.operators import marks, runlog
from planwise.operators.review import GuardError
from planwise.operators.suggest import cache_key, propose, unknown_citations


def test_density_counts_and_viewport(spark):
    df = spark.range(10000).selectExpr("CAST(id % 100 AS DOUBLE) AS x", "CAST(id % 70 AS DOUBLE) AS value")
    full = marks.density_stats(marks.density_raster(df, "x", "value", 200, 100)).first()
    assert full["points_in_view"] == 10000
    view = marks.density_stats(marks.density_raster(df, "x", "value", 200, 100, (0, 20), (0, 20))).first()
    assert 0 < view["points_in_view"] < 10000


def test_histogram_sums_to_rows_with_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (10.0,), (None,)], "v double")
    h = marks.histogram(df, "v").orderBy("bin").collect()
    assert len(h) == 10 and sum(r["count"] for r in h) == 3 and h[-1]["count"] == 1 and h[5]["count"] == 0


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    vals = [float(v) for v in np.random.default_rng(7).normal(size=501)]
    df = spark.createDataFrame([("g" if i % 3 else "h", v) for i, v in enumerate(vals)], "k string, v double")
    got = {r["k"]: r for r in marks.exact_quantiles(df, "k", "v").collect()}
    for key in ("g", "h"):
        sub = [v for i, v in enumerate(vals) if ("g" if i % 3 else "h") == key]
        expect = np.quantile(sub, [0.25, 0.5, 0.75])
        assert [got[key]["q0"], got[key]["q1"], got[key]["q2"]] == pytest.approx(list(expect))


def test_box_whiskers_and_outliers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]], "k string, v double")
    b = marks.box_stats(df, "k", "v").first()
    assert b["outliers"] == 1 and b["upper_whisker"] == 5.0 and b["lower_whisker"] == 1.0
    assert marks.box_outliers(df, "k", "v").first()["v"] == 100.0


def test_heatmap_and_duplicates(spark):
    df = spark.createDataFrame([("A", "X", 1.0), ("A", "Y", 2.0), ("B", "X", 3.0), ("B", "Y", 4.0)], "g string, s string, v double")
    m = {r["g"]: (r["X"], r["Y"]) for r in marks.heatmap_matrix(df, "g", "s", "v").collect()}
    assert m == {"A": (1.0, 2.0), "B": (3.0, 4.0)}
    dup = df.union(spark.createDataFrame([("A", "X", 9.0)], df.schema))
    with pytest.raises(Exception, match="duplicate"):
        marks.heatmap_matrix(dup, "g", "s", "v").collect()


def test_sankey_and_guards(spark):
    flow = spark.createDataFrame([("访问", "注册", 100.0), ("注册", "付费", 30.0)], "s string, t string, v double")
    assert marks.sankey_nodes(flow, "s", "t").count() == 3 and marks.sankey_links(flow, "s", "t", "v").count() == 2
    neg = spark.createDataFrame([("a", "b", -1.0)], "s string, t string, v double")
    with pytest.raises(GuardError):
        marks.sankey_links(neg, "s", "t", "v")
    geo = spark.createDataFrame([(121.47, 31.23), (120.15, 30.27)], "lon double, lat double")
    assert marks.geo_view(geo, "lon", "lat").first()["points"] == 2
    bad = spark.createDataFrame([(190.0, 0.0)], "lon double, lat double")
    with pytest.raises(GuardError):
        marks.geo_view(bad, "lon", "lat")


def test_bars_negative_values_and_missing_label(spark):
    df = spark.createDataFrame([("East", 400.0), ("West", 200.0), (None, -50.0)], "r string, v double")
    bars = {r["category"]: r["value"] for r in marks.bar_marks(df, "r", "v").collect()}
    assert bars == {"East": 400.0, "West": 200.0, "(missing)": -50.0}


def test_table_and_mark_caps(spark):
    df = spark.range(41).selectExpr("CAST(id AS STRING) AS k", "CAST(id AS DOUBLE) AS v")
    with pytest.raises(GuardError):
        marks.kpi_table(df, "k", "v")
    with pytest.raises(GuardError):
        marks.bar_marks(df, "k", "v", max_marks=40)


def test_evidence_and_citations(spark):
    df = spark.range(130).selectExpr("id AS k", "CAST(id AS DOUBLE) AS value")
    ev = marks.top_evidence(df, "value", ["k"])
    rows = ev.collect()
    assert len(rows) == 100 and rows[0]["total_groups"] == 130
    cited = spark.createDataFrame([(1,), (999,)], "evidence_id int")
    assert [r["evidence_id"] for r in unknown_citations(cited, ev).collect()] == [999]


def test_violin_density_integrates_to_about_one(spark):
    import numpy as np
    vals = np.random.default_rng(1).normal(size=400)
    df = spark.createDataFrame([("a", float(v)) for v in vals], "g string, v double")
    pts = sorted((r["x"], r["density"]) for r in marks.violin_density(df, "g", "v").collect())
    xs, ys = zip(*pts)
    assert np.trapezoid(ys, xs) == pytest.approx(1.0, abs=0.05)


def test_runlog_latest_superseded_recent(spark):
    t0 = dt.datetime(2026, 1, 1)
    ev = spark.createDataFrame([
        (1, "r1", "queued", t0), (2, "r1", "running", t0 + dt.timedelta(seconds=5)),
        (3, "r2", "queued", t0), (4, "r2", "completed", t0 + dt.timedelta(seconds=20)),
    ], "seq long, run string, status string, ts timestamp_ntz")
    latest = {r["run"]: r["status"] for r in runlog.latest_state(ev, "run", "seq").collect()}
    assert latest == {"r1": "running", "r2": "completed"}
    over = runlog.overdue_runs(runlog.latest_state(ev, "run", "seq"), "status", "ts", t0 + dt.timedelta(minutes=10))
    assert [r["run"] for r in over.collect()] == ["r1"]
    sup = {r["seq"]: r["superseded"] for r in runlog.superseded(ev, "run", "seq").collect()}
    assert sup == {1: True, 2: False, 3: True, 4: False}
    rec = runlog.recent_per_key(ev, "run", "seq", 1).collect()
    assert sorted(r["seq"] for r in rec) == [2, 4]


def test_compare_and_set(spark):
    state = spark.createDataFrame([("p1", "d1", 2, None)], "project string, dataset string, generation int, head string")
    results = spark.createDataFrame([("p1", "d1", 2, None, "ok"), ("p1", "d1", 1, None, "old")],
                                    "project string, dataset string, generation int, head string, tag string")
    acc = {r["tag"]: r["accepted"] for r in runlog.compare_and_set(
        results, state, ["project", "dataset", "generation", "head"]).collect()}
    assert acc == {"ok": True, "old": False}


def test_history_depth(spark):
    revs = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent string")
    depth = {r["id"]: r["depth"] for r in runlog.history_depth(revs, "id", "parent").collect()}
    assert depth == {"a": 0, "b": 1, "c": 2}


def test_history_depth_matches_recursive_cte(spark):
    """Pointer doubling equals the recursive definition on a forest with a
    long chain, a wide fan-out, a dangling parent and a cycle."""
    rows = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(300)]          # one chain of 300
    rows += [("r", None)] + [(f"k{i}", "r") for i in range(50)]                  # fan-out under one root
    rows += [("x1", "missing"), ("x2", "x1"), ("y1", "y2"), ("y2", "y1")]       # dangling and cyclic
    revs = spark.createDataFrame(rows, "id string, parent string")
    rows_out = runlog.history_depth(revs, "id", "parent").collect()
    assert {r["id"] for r in rows_out if r["status"] == "unrooted"} == {"x1", "x2", "y1", "y2"}
    assert all(r["root"] is None and r["depth"] is None for r in rows_out if r["status"] == "unrooted")
    got = {r["id"]: (r["root"], r["depth"]) for r in rows_out if r["status"] == "rooted"}
    parent = dict(rows)
    expect = {}
    for node in parent:
        seen, cur, d = set(), node, 0
        while cur in parent and parent[cur] is not None and cur not in seen:
            seen.add(cur)
            cur, d = parent[cur], d + 1
        if cur in parent and parent[cur] is None:
            expect[node] = (cur, d)
    assert got == expect
    assert got["c299"] == ("c0", 299) and "x2" not in got and "y1" not in got


def test_proposals_and_cache_key(spark):
    ds = Dataset.from_frame(spark.createDataFrame([("A", 1.0), ("B", 3.0)], "hospital string, visits double"))
    out = propose(ds, goal="penetration of hospitals")
    assert len(out["proposals"]) >= 2 and out["questions"]
    assert all(p["plan"].aggregation != "ratio_total" for p in out["proposals"])
    p = out["proposals"][0]["plan"]
    assert cache_key("x", ds, p) == cache_key("x", ds, p) != cache_key("y", ds, p)


def test_stream_equals_batch(spark):
    from planwise.registry import QUERIES
    sf = "/root/testdata/sf0.001"
    stream = {(r["ts"], r["event_type"]): r["value"] for r in QUERIES["stream_daily_sum"](spark, sf).collect()}
    ds = Dataset.from_frame(spark.read.parquet(f"{sf}/events.parquet"))
    batch = {(r["ts"], r["event_type"]): r["value"] for r in compile_plan(
        ds, Plan(group_by=["ts", "event_type"], metric="value", time_grain="day"), decimals=2).df.collect()}
    assert stream == batch


def test_violin_of_all_events(spark):
    import __spark_entry__
    sf_dir = "/root/testdata/sf0.001"
    rows = __spark_entry__.queries()["mark_violin_all"](spark, sf_dir).collect()
    kinds = {r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().collect()}
    shown = Counter(r.event_type for r in rows if not r.flat)
    assert shown == dict.fromkeys([*kinds, None], 100) and "click" in shown
    assert [(r.event_type, r.x) for r in rows if r.flat] == [("single", 1.0)]

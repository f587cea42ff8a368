"""Faults found in review, each with the case that showed it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from planwise import Dataset, Plan, PlanError, compile_plan
from planwise.operators import marks, runlog
from planwise.operators.dedupe import drop_exact_duplicates
from planwise.operators.joins import join_stats
from planwise.operators.profile import fingerprint
from planwise.operators.suggest import cached_result, committed
from planwise.sources.catalog import SourceCatalog
from planwise.sources.delimited import IngestError, read_delimited, read_pasted
from planwise.sources.sql import SqlGuardError, capped, guarded_sql
from planwise.streaming.streams import event_stream, read_latest, run_available, stream_plan


@pytest.mark.parametrize("sql", [
    "SELECT '--' AS a, reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT '/*' AS a, java_method('java.lang.System', 'getProperty', 'user.home') -- */",
    "SELECT r'\\' AS a, reflect('java.lang.System', 'getProperty', 'user.home') AS b, '' AS c",
    'SELECT "it\'s" AS a, try_reflect("java.lang.System", "getProperty", "user.home")',
    "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home')",
    "SELECT (SELECT max(reflect('java.lang.System', 'getProperty', 'user.home')))",
    "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.home')",
])
def test_denied_functions_in_any_disguise(spark, sql):
    with pytest.raises(SqlGuardError):
        guarded_sql(spark, sql)


def test_texts_that_only_look_denied(spark):
    assert guarded_sql(spark, "SELECT 'do not reflect on it' AS a -- reflect").first()["a"].startswith("do")


def test_limits_are_honoured(spark):
    assert capped(spark.range(10_500), 20_000).count() == 10_500
    with pytest.raises(SqlGuardError):
        capped(spark.range(3), 0)


def test_source_query_sees_its_own_tables_only(spark, tmp_dir):
    spark.range(3).write.parquet(f"{tmp_dir}/a")
    spark.range(5).createOrReplaceTempView("outside")
    catalog = SourceCatalog(spark)
    catalog.add_parquet("s", {"a": f"{tmp_dir}/a"})
    assert catalog.query("s", "SELECT count(*) AS n FROM a").first()["n"] == 3
    with pytest.raises(SqlGuardError):
        catalog.query("s", "SELECT count(*) FROM outside")


def test_fingerprint_sees_moved_nulls(spark):
    schema = "a string, b string"
    sums = {fingerprint(spark.createDataFrame(rows, schema)).first()["checksum"]
            for rows in ([(None, "x")], [("x", None)], [("", "x")], [("x", "")], [("x", "x")], [("x", "x"), ("x", "x")])}
    assert len(sums) == 6


def test_unfinished_cache_folder_is_a_miss(spark, tmp_dir):
    spark.range(2).write.parquet(f"{tmp_dir}/k/half")  # no marker at the top
    assert not committed(spark, f"{tmp_dir}/k")
    df, hit = cached_result(spark.range(4), tmp_dir, "k")
    assert not hit and df.count() == 4 and cached_result(spark.range(4), tmp_dir, "k")[1]
    ds = Dataset.from_frame(spark.createDataFrame([("a", 1.0)], "g string, v double"))
    result = compile_plan(ds, Plan(group_by=("g",), metric="v"))
    checksum = fingerprint(ds.df).first()["checksum"]
    assert [result.cached(tmp_dir, checksum)[1].cache_hit for _ in range(2)] == [False, True]


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("b", 5.0), ("b", 5.0)], "g string, v double")
    assert {r["g"]: r["median"] for r in marks.box_stats(df, "g", "v").collect()} == {None: 2.0, "a": 2.0, "b": 5.0}
    violin = marks.violin_density(df, "g", "v").collect()
    assert {r["g"] for r in violin if not r["flat"]} == {None}
    assert {(r["g"], r["x"], r["density"]) for r in violin if r["flat"]} == {("a", 2.0, None), ("b", 5.0, None)}
    log = spark.createDataFrame([(None, 1), (None, 2), ("k", 1), ("k", 2)], "k string, seq int")
    assert {(r["k"], r["seq"], r["superseded"]) for r in runlog.superseded(log, "k", "seq").collect()} == {
        (None, 1, True), (None, 2, False), ("k", 1, True), ("k", 2, False)}


def test_only_open_requests_go_stale(spark):
    log = spark.createDataFrame([("k", 1, "completed"), ("k", 2, "queued"), ("k", 3, "running")], "k string, seq int, status string")
    got = {r["seq"]: r["superseded"] for r in runlog.superseded(log, "k", "seq", "status").collect()}
    assert got == {1: False, 2: True, 3: False}


def test_one_value_that_fills_a_table(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"),
                                    F.lit("g").alias("g"))
    q = marks.exact_quantiles(df, "g", "v").first()
    import numpy as np
    assert [q["q0"], q["q1"], q["q2"]] == list(np.quantile([r["v"] for r in df.collect()], [.25, .5, .75]))


def test_join_stats_beyond_the_broadcast_bound(spark):
    big = spark.range(100).select((F.col("id") % 3).alias("k"), "id").withColumn("k", F.nullif("k", F.lit(0)))
    stats = big.groupBy("k").agg(F.max("id").alias("m"))
    few = join_stats(big, stats, ["k"])
    many = join_stats(big, stats, ["k"], broadcast_rows=0)
    assert sorted(few.collect(), key=str) == sorted(many.collect(), key=str) and few.count() == 100


def test_hash_dedupe_beyond_the_broadcast_bound(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (None, "a")], "a int, b string")
    for bound in (0, 10):
        assert drop_exact_duplicates(df, "hash", bound).count() == 3


def test_repeated_state_does_not_multiply_results(spark):
    state = spark.createDataFrame([("p", 1), ("p", 1)], "p string, g int")
    assert runlog.compare_and_set(spark.createDataFrame([("p", 1)], "p string, g int"), state, ["p", "g"]).count() == 1


def test_nan_is_missing(spark):
    ds = Dataset.from_frame(spark.createDataFrame([("a", float("nan")), ("a", 2.0)], "g string, v double"))
    with pytest.raises(PlanError, match="1 rows"):
        compile_plan(ds, Plan(group_by=("g",), metric="v")).collect()
    for policy in ("exclude", "keep"):
        assert compile_plan(ds, Plan(group_by=("g",), metric="v", missing=policy)).df.first()["value"] == 2.0


def test_first_appearance_follows_files(spark, tmp_dir):
    # the second file is larger, so Spark reads it first
    spark.createDataFrame([("z", 1)], "g string, v int").coalesce(1).write.parquet(f"{tmp_dir}/t/p=0")
    spark.range(5000).selectExpr("'a' AS g", "CAST(id AS INT) AS v").coalesce(1).write.parquet(f"{tmp_dir}/t/p=1")
    ds = Dataset.from_frame(spark.read.parquet(f"{tmp_dir}/t"))
    out = compile_plan(ds, Plan(group_by=("g",), aggregation="count"), first_seen=True).df
    assert [r["g"] for r in out.collect()] == ["z", "a"]


def test_folder_of_files_with_preambles(spark, tmp_dir):
    for i in range(2):
        spark.createDataFrame([("Title",), ("k,v",), (f"{i},x",), (f"{i + 5},y",)], "value string").coalesce(1).write.mode(
            "append").text(f"{tmp_dir}/f")
    got = sorted(tuple(r) for r in read_delimited(spark, f"{tmp_dir}/f", header_row=2).df.collect())
    assert got == [("0", "x"), ("1", "x"), ("5", "y"), ("6", "y")]
    spark.createDataFrame([("Title",), ("v,k",), ("x,9",)], "value string").coalesce(1).write.mode("append").text(f"{tmp_dir}/f")
    with pytest.raises(IngestError, match="different headers"):
        read_delimited(spark, f"{tmp_dir}/f", header_row=2)


def test_header_row_with_line_breaks_in_quotes(spark, tmp_dir):
    with open(f"{tmp_dir}/q.csv", "w") as f:
        f.write('Title\nk,v\n1,"two\nlines"\n2,z\n')
    got = sorted(tuple(r) for r in read_delimited(spark, f"{tmp_dir}/q.csv", header_row=2, multiline=True).df.collect())
    assert got == [("1", "two\nlines"), ("2", "z")]


def test_replacement_character_is_text(spark, tmp_dir):
    with open(f"{tmp_dir}/r.csv", "w", encoding="utf-8") as f:
        f.write("k,v\n1,\ufffd\n")
    assert read_delimited(spark, f"{tmp_dir}/r.csv").df.first()["f2"] == "\ufffd"


def test_pasted_rows(spark):
    assert [tuple(r) for r in read_pasted(spark, "k\tv\n\t\na\t1\n").df.collect()] == [(None, None), ("a", "1")]
    with pytest.raises(IngestError, match="row 2 is blank"):
        read_pasted(spark, "k\tv\n\na\t1")


@pytest.mark.parametrize("grain,early,late", [("month", dt.datetime(2026, 1, 31, 23, 59), dt.datetime(2026, 2, 1, 0, 1)),
                                              ("month", dt.datetime(2026, 2, 28, 23, 59), dt.datetime(2026, 3, 1, 12, 0)),
                                              ("year", dt.datetime(2025, 12, 31, 23, 59), dt.datetime(2026, 1, 1, 0, 1))])
def test_rows_inside_the_delay_count(spark, tmp_dir, grain, early, late):
    schema = spark.createDataFrame([], "ts timestamp_ntz").schema
    plan = lambda: stream_plan(event_stream(spark, f"{tmp_dir}/in", schema, time_col="ts"), "ts", grain, [], "count")
    for day in (late, late + dt.timedelta(minutes=1), early, late + dt.timedelta(days=3), early):
        spark.createDataFrame([(day,)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
        data = run_available(plan(), f"{tmp_dir}/out", mode="update")
    fmt = "%Y-%m" if grain == "month" else "%Y"
    got = {r["ts"]: r["value"] for r in read_latest(spark, data, ["ts"]).collect()}
    # the first early row comes within a day of the end, the second after it
    assert got == {early.strftime(fmt): 1, late.strftime(fmt): 3}


def test_rows_without_a_time_stop_the_stream(spark, tmp_dir):
    schema = spark.createDataFrame([], "ts timestamp_ntz").schema
    spark.createDataFrame([(None,), (dt.datetime(2026, 1, 1),)], schema).coalesce(1).write.parquet(f"{tmp_dir}/in")
    events = lambda: event_stream(spark, f"{tmp_dir}/in", schema, time_col="ts")
    with pytest.raises(Exception, match="has no ts"):
        run_available(stream_plan(events(), "ts", "day", [], "count"), f"{tmp_dir}/a", mode="update")
    data = run_available(stream_plan(events(), "ts", "day", [], "count", null_time="drop"), f"{tmp_dir}/b", mode="update")
    assert read_latest(spark, data, ["ts"]).first()["value"] == 1


@pytest.mark.parametrize("text,want", [
    ("2026-01-02T10:20", dt.datetime(2026, 1, 2, 10, 20)), ("2026-01-02T10:20:30Z", dt.datetime(2026, 1, 2, 10, 20, 30)),
    ("2026-01-02T10:20:30+08:00", dt.datetime(2026, 1, 2, 2, 20, 30)), ("2026-01-02 03:04 PM", dt.datetime(2026, 1, 2, 15, 4)),
    ("2026-01-02T10:20:30.5-01:30", dt.datetime(2026, 1, 2, 11, 50, 30, 500000)),
])
def test_dates_that_inference_reads(spark, text, want):
    from planwise.operators.profile import type_dataset
    if ".5-" in text:
        text = text.replace(".5-", ".500000-")
    ds = type_dataset(Dataset.from_frame(spark.createDataFrame([(text,), (None,)], "d string")))
    assert ds.dtype("d") == "date" and ds.df.where("d IS NOT NULL").first()["d"] == want


@pytest.mark.parametrize("text", ["01/02/2026", "20260102", "Jan 2, 2026", "2 Jan 2026", "January 2, 2026"])
def test_dates_that_a_cast_reads(spark, text):
    from planwise.operators.profile import strict_cast
    df = spark.createDataFrame([(text,)], "d string")
    assert df.select(strict_cast(df, "d", "date")).first()["d"] in (dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 2, 0, 0))


def test_log_shade(spark):
    raster = spark.createDataFrame([(0, 0, 0), (0, 1, 9), (1, 1, 99)], "px int, py int, count long")
    assert [round(r["shade"], 3) for r in marks.density_shade(raster).orderBy("count").collect()] == [0.0, 0.5, 1.0]

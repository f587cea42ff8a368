"""First-seen ordering, report frame, formatting, source catalogue, preview."""

import pytest
from pyspark.sql import functions as F

from planwise import Dataset, Filter, Plan, compile_plan
from planwise.functions.exprs import format_value
from planwise.sources.catalog import SourceCatalog, UnknownSource, preview


def test_first_seen_order(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", 3.0), ("c", 4.0)], "k string, v double").coalesce(1)
    out = compile_plan(Dataset.from_frame(df), Plan(group_by=["k"], metric="v"), first_seen=True).df.collect()
    assert [r["k"] for r in out] == ["b", "a", "c"] and out[0]["value"] == 4.0


def test_report_frame_accounting(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 1.0), ("B", None), ("C", 5.0)], "k string, v double")
    plan = Plan(group_by=["k"], metric="v", missing="exclude", duplicates="drop_exact",
                filters=[Filter("k", "ne", "C")])
    rep = compile_plan(Dataset.from_frame(df), plan).report_frame().first()
    assert (rep["input_rows"], rep["duplicate_rows_removed"], rep["filtered_rows"], rep["missing_rows"],
            rep["analyzed_rows"], rep["groups"]) == (4, 1, 2, 1, 1, 1)


def test_format_value(spark):
    df = spark.createDataFrame([(0.1234,), (1234.5,)], "v double")
    pct, num = df.select(format_value(F.col("v"), "percent", 1).alias("p"), format_value(F.col("v")).alias("n")).collect()[0]
    assert pct == "12.3%" and num == "0.12"


def test_catalog_rejects_unknown(spark):
    cat = SourceCatalog(spark)
    cat.add_parquet("w", {"region": "/root/testdata/sf0.001/region.parquet"})
    assert cat.read("w", "region").count() == 5
    assert cat.browse("w").count() == 2
    with pytest.raises(UnknownSource):
        cat.read("nope", "region")
    with pytest.raises(UnknownSource):
        cat.read("w", "orders")


def test_preview_returns_total(spark):
    ds = Dataset.from_frame(spark.range(100).toDF("x"))
    rows, total = preview(ds, 12)
    assert len(rows) == 12 and total == 100


def test_registered_queries_all_have_callables():
    import __spark_entry__ as entry
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 90


def test_scale_conf_sizes_shuffles():
    from planwise.session import scale_conf
    conf = scale_conf(10 * (1 << 40))  # 10 TiB -> 81,920 partitions of 128 MiB
    assert conf["spark.sql.shuffle.partitions"] == "81920"
    assert scale_conf(100 * (1 << 40))["spark.sql.shuffle.partitions"] == "819200"  # no cap: partitions keep their size
    assert conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == conf["spark.sql.shuffle.partitions"]
    assert scale_conf(1)["spark.sql.shuffle.partitions"] == "1"


def test_parquet_schema_is_the_present_one(spark, tmp_dir):
    from planwise.sources.parquet import read_parquet
    path = f"{tmp_dir}/t"
    spark.createDataFrame([(1, "a")], "k long, v string").write.parquet(path)
    assert read_parquet(spark, path).columns == ["k", "v"]
    spark.createDataFrame([(1, "a", 2.0)], "k long, v string, w double").write.mode("overwrite").parquet(path)
    assert read_parquet(spark, path).columns == ["k", "v", "w"]

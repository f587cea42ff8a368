"""Guarded SQL, snapshots, packages and the SQLite source."""

import os
import sqlite3

import pytest

from planwise import Plan, compile_plan
from planwise.sources.snapshot import read_snapshot, rerun_package, write_package, write_snapshot
from planwise.sources.sql import SqlGuardError, capped, guarded_sql, sql_dataset, table_preview


@pytest.fixture()
def orders_view(spark):
    spark.createDataFrame([(1, "East", 100.0), (2, "West", 200.0), (3, "East", 300.0)],
                          "id int, region string, amount double").createOrReplaceTempView("t_orders")


@pytest.mark.parametrize("sql", [
    "SELECT region, sum(amount) AS s FROM t_orders GROUP BY region",
    "WITH x AS (SELECT * FROM t_orders) SELECT * FROM x",
    "SELECT id FROM t_orders UNION SELECT 4",
    "SELECT id FROM t_orders EXCEPT SELECT 1",
    "VALUES (1, 2)",
    "SELECT * FROM t_orders ORDER BY amount -- trailing comment",
])
def test_guard_accepts_queries(spark, orders_view, sql):
    guarded_sql(spark, sql).collect()


@pytest.mark.parametrize("sql", [
    "DELETE FROM t_orders",
    "INSERT INTO t_orders VALUES (4, 'x', 1.0)",
    "DROP VIEW t_orders",
    "CREATE TABLE z AS SELECT 1",
    "SET spark.sql.ansi.enabled=false",
    "CACHE TABLE t_orders",
    "SELECT 1; DROP VIEW t_orders",
    "SELECT reflect('java.lang.System', 'exit', '0')",
    "SELECT java_method('java.lang.Math', 'abs', -1)",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
])
def test_guard_rejects_writes_and_escapes(spark, orders_view, sql):
    with pytest.raises(SqlGuardError):
        guarded_sql(spark, sql).collect()


def test_sql_result_as_dataset_and_cap(spark, orders_view):
    ds = sql_dataset(spark, "SELECT region, amount FROM t_orders")
    out = {r["f1"]: r["value"] for r in compile_plan(ds, Plan(group_by=["f1"], metric="f2")).df.collect()}
    assert out == {"East": 400.0, "West": 200.0}
    with pytest.raises(SqlGuardError, match="exceeds 1 rows"):
        capped(guarded_sql(spark, "SELECT * FROM t_orders"), 1)
    assert table_preview(spark, "t_orders", 2).count() == 2
    with pytest.raises(SqlGuardError):
        table_preview(spark, "t_orders; DROP", 2)


def test_snapshot_roundtrip_and_package(spark, tmp_dir):
    from planwise.registry import dataset
    ds = dataset(spark, "/root/testdata/sf0.001", "nation")
    meta = write_snapshot(ds, os.path.join(tmp_dir, "snaps"), "s1")
    assert meta["rows"] == 25 and meta["profile"]["n_name"]["unique"] == 25
    back = read_snapshot(spark, os.path.join(tmp_dir, "snaps"), "s1")
    assert back.fields == ds.fields and back.df.count() == 25
    with pytest.raises(Exception):
        write_snapshot(ds, os.path.join(tmp_dir, "snaps"), "s1")  # immutable
    plan = Plan(group_by=["n_regionkey"], aggregation="count")
    pkg = os.path.join(tmp_dir, "pkg")
    write_package(ds, plan, pkg, include_data=True)
    assert rerun_package(spark, pkg).count() == 0


def test_sqlite_source(spark, tmp_dir):
    from planwise.sources.sqlite import read_sqlite
    path = os.path.join(tmp_dir, "db.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE orders (id INTEGER, region TEXT, amount REAL)")
    con.executemany("INSERT INTO orders VALUES (?, ?, ?)", [(1, "East", 100.0), (2, "West", 200.0), (3, "East", 300.0)])
    con.commit()
    con.close()
    df = read_sqlite(spark, path, "orders", partitions=2)
    got = {r["region"]: r["s"] for r in df.groupBy("region").agg({"amount": "sum"}).withColumnRenamed("sum(amount)", "s").collect()}
    assert got == {"East": 400.0, "West": 200.0}
    with pytest.raises(Exception):
        read_sqlite(spark, path, "orders; DROP TABLE orders").collect()


def test_result_sinks(spark, tmp_dir):
    """JSON records, CSV with a UTF-8 byte-order mark, Parquet, and the report next to them."""
    import glob
    import json

    from planwise.sources.snapshot import write_result
    df = spark.createDataFrame([("华东", 400.0), ("West", 200.0)], "region string, value double").repartition(2)
    report = {"input_rows": 2, "warnings": ["w"]}
    for fmt in ("json", "csv", "parquet"):
        write_result(df, f"{tmp_dir}/{fmt}", fmt, report=report)
    rows = [json.loads(line) for f in glob.glob(f"{tmp_dir}/json/data/part-*") for line in open(f, encoding="utf-8")]
    assert sorted((r["region"], r["value"]) for r in rows) == [("West", 200.0), ("华东", 400.0)]
    parts = [f for f in glob.glob(f"{tmp_dir}/csv/data/part-*") if os.path.getsize(f)]
    assert parts and all(open(f, "rb").read().startswith(b"\xef\xbb\xbfregion,value") for f in parts)
    back = spark.read.option("header", True).csv(f"{tmp_dir}/csv/data")
    assert back.columns == ["region", "value"] and back.count() == 2
    assert spark.read.parquet(f"{tmp_dir}/parquet/data").count() == 2
    text = "".join(r["value"] for r in spark.read.text(f"{tmp_dir}/parquet/report.json").collect())
    assert json.loads(text) == report

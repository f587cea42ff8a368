"""Checksums from per-file facts, and cached results whose hits read no row."""

import glob
import os

from pyspark.sql import functions as F

from planwise.dataset import Dataset
from planwise.operators.profile import fingerprint
from planwise.plans.compile import PlanResult, compile_plan
from planwise.plans.plan import Plan
from planwise.sources.manifest import table_state


def _rows(spark, a, b, parts=2):
    return spark.range(a, b, 1, parts).select("id", F.when(F.col("id") % 3 > 0, F.sha2(F.col("id").cast("string"), 512)).alias("text"))


def _whole(spark, path):
    return fingerprint(spark.read.parquet(path)).first()["checksum"]


def _spoil(path):
    """Overwrite a file's first data bytes; its name, size and times stay."""
    was = os.stat(path)
    with open(path, "r+b") as f:
        f.seek(4)
        f.write(b"\xff" * 2000)
    os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))


def test_only_new_files_are_read(spark, tmp_dir):
    path, root = f"{tmp_dir}/a table", f"{tmp_dir}/facts"
    _rows(spark, 0, 3000).write.parquet(path)
    first = table_state(spark, path, root)
    assert (first.rows, first.files, first.files_new, first.rows_new) == (3000, 2, 2, 3000)
    assert first.checksum == _whole(spark, path)
    _rows(spark, 3000, 3500, 1).write.mode("append").parquet(path)
    want = _whole(spark, path)
    olds = [f for f in glob.glob(f"{path}/part-*.parquet") if spark.read.parquet(f).where("id < 3000").count()]
    assert len(olds) == 2
    for old in olds:
        os.utime(old, ns=(10**18, 10**18))  # well before the appended file
    table_state(spark, path, f"{tmp_dir}/facts2")  # facts by the files' times as they are now
    for old in olds:
        _spoil(old)
    _rows(spark, 3500, 3600, 1).write.mode("append").parquet(path)
    grown = table_state(spark, path, f"{tmp_dir}/facts2")
    assert (grown.rows, grown.files, grown.files_new, grown.rows_new) == (3600, 4, 1, 100)
    assert grown.checksum != want
    again = table_state(spark, path, f"{tmp_dir}/facts2")
    assert (again.files_new, again.rows_new, again.checksum) == (0, 0, grown.checksum)
    healthy = f"{tmp_dir}/healthy"
    _rows(spark, 0, 3600, 5).write.parquet(healthy)
    assert grown.checksum == _whole(spark, healthy)


def test_removed_and_empty_files_and_partitions(spark, tmp_dir):
    path, root = f"{tmp_dir}/t", f"{tmp_dir}/facts"
    _rows(spark, 0, 90, 3).withColumn("part", F.col("id") % 3).write.partitionBy("part").parquet(path)
    assert table_state(spark, path, root).checksum == _whole(spark, path)
    only = f"{path}/part=1"
    assert table_state(spark, only, root).rows == 30
    empty = f"{tmp_dir}/empty"
    spark.createDataFrame([], "a int").write.parquet(empty)
    state = table_state(spark, empty, root)
    assert (state.rows, state.checksum) == (0, _whole(spark, empty))
    _rows(spark, 0, 10, 1).write.mode("overwrite").parquet(empty)
    state = table_state(spark, empty, root)
    assert (state.rows, state.files, state.checksum) == (10, 1, _whole(spark, empty))


def test_a_hit_reads_no_row(spark, tmp_dir, monkeypatch):
    df = spark.createDataFrame([("2024-01-05", 1.0), ("2024-02-07", None)], "d string, v double").withColumn("d", F.to_timestamp("d"))
    result = compile_plan(Dataset.from_frame(df), Plan(group_by=("d",), metric="v", time_grain="month", missing="exclude"))
    _, first = result.cached(tmp_dir, "data")
    monkeypatch.setattr(PlanResult, "_counts", lambda *a: 1 / 0)
    stored, again = result.cached(tmp_dir, "data")
    assert again.cache_hit and not first.cache_hit and stored.count() == 1
    left, right = ({k: v for k, v in r.__dict__.items() if k not in ("cache_hit", "compute_seconds")} for r in (first, again))
    assert left == right and first.missing_rows == 1

"""Checksums of tables from a manifest of per-file fingerprints.

A table's fingerprint (``operators.profile.fingerprint``) is made of sums, so it
is the sum of its files' fingerprints.  The manifest is a Parquet folder of
facts that is only appended to: a file of this name, size, modification time
and read with this schema has these sums.  A table's checksum joins the files
it has now with the facts; only files without a fact are read, so an unchanged
table reads no row and an append reads what was appended.  A removed file
drops out of the join, a file written over is another file.

The list of files is a DataFrame (one row a file, contents not read) and is
joined by Spark; one time passes through the driver, the oldest of the new
files, by which Spark leaves older files out of the scan.  Files that came in
with an older time are thus read, and known files that are newer than these
are read once more.

Defined cases: a file without rows has sums of zero; facts that two runs wrote
at once are equal and count once; the facts of a run that failed are facts still.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.operators.profile import md5_sums, row_md5, with_checksum
from planwise.sources.parquet import read_parquet

KEY = ["_file", "_size", "_modified", "_schema"]
FACTS = ("_file string, _size bigint, _modified bigint, _schema string, "
         "rows bigint, sum_a decimal(38,0), sum_b decimal(38,0)")


@dataclass(frozen=True)
class TableState:
    """What a table holds now, and what had to be read to tell."""

    rows: int
    checksum: str
    files: int
    files_new: int
    rows_new: int


def _file_keys(schema: str) -> list:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"),
            F.unix_micros("_metadata.file_modification_time").alias("_modified"), F.lit(schema).alias("_schema")]


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], FACTS)
    return spark.read.schema(FACTS).parquet(folder).dropDuplicates(KEY)


def table_state(spark: SparkSession, path: str, root: str) -> TableState:
    """Rows and checksum of the Parquet table at ``path``; facts are kept below the shared folder ``root``."""
    folder = f"{root.rstrip('/')}/files"
    listed = spark.read.format("binaryFile").load(path)  # before the table's own listing
    table = read_parquet(spark, path)
    schema = table.schema.json()
    now = listed.select(*_file_keys(schema))
    new = now.join(_facts(spark, folder), KEY, "left_anti")
    files_new, oldest = new.agg(F.count(F.lit(1)), F.min("_modified")).first()
    rows_new = 0
    if files_new:
        since = F.col("_metadata.file_modification_time") >= F.timestamp_micros(F.lit(oldest))
        rows = table.where(since).select(*_file_keys(schema), F.expr(row_md5(table.columns)).alias("_md5"))
        sums = rows.groupBy(KEY).agg(*md5_sums())
        zero = {c: F.coalesce(c, F.lit(0)).cast(t) for c, t in (("rows", "bigint"), ("sum_a", "decimal(38,0)"), ("sum_b", "decimal(38,0)"))}
        new.join(sums, KEY, "left").withColumns(zero).write.mode("append").parquet(folder)
    found = now.join(_facts(spark, folder), KEY)
    if files_new:
        rows_new = found.join(new.select("_file"), "_file", "left_semi").agg(F.sum("rows")).first()[0]
    total = found.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for c, t in (
        ("rows", "bigint"), ("sum_a", "decimal(38,0)"), ("sum_b", "decimal(38,0)"))])
    one = with_checksum(total).first()
    return TableState(one["rows"], one["checksum"], one["files"], files_new, rows_new)

"""Immutable Parquet snapshots with a JSON sidecar, result sinks, and
reproduction packages.  All data is written by Spark executors; only the
small metadata documents pass through the driver."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.dataset import Dataset, Field
from planwise.operators.profile import duplicate_rows, fingerprint, profile
from planwise.plans.compile import compile_plan
from planwise.plans.plan import Plan


def _write_json(spark: SparkSession, path: str, obj: dict) -> None:
    text = json.dumps(obj, ensure_ascii=False, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))


def write_snapshot(ds: Dataset, root: str, snapshot_id: str | None = None, with_profile: bool = True) -> dict:
    """Write ``ds`` once (never overwritten) and return its metadata."""
    spark = ds.df.sparkSession
    sid = snapshot_id or uuid.uuid4().hex
    base = f"{root.rstrip('/')}/{sid}"
    ds.df.write.mode("errorifexists").parquet(f"{base}/data")
    stored = spark.read.parquet(f"{base}/data")
    fp = fingerprint(stored).first()
    meta = ds.metadata()
    meta.update(id=sid, rows=fp["rows"], checksum=fp["checksum"], snapshot=f"{sid}/data")
    if with_profile:
        prof = profile(Dataset(stored, ds.fields)).collect()
        meta["duplicate_rows"] = duplicate_rows(stored).first()["duplicate_rows"]
        meta["profile"] = {r["field"]: {k: r[k] for k in ("nulls", "unique", "min", "max")} for r in prof}
        by_id = {r["field"]: r for r in prof}
        for f in meta["fields"]:
            f["nulls"], f["unique"] = by_id[f["id"]]["nulls"], by_id[f["id"]]["unique"]
    _write_json(spark, f"{base}/dataset.json", meta)
    return meta


def read_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> Dataset:
    base = f"{root.rstrip('/')}/{snapshot_id}"
    meta = _read_json(spark, f"{base}/dataset.json")
    fields = tuple(Field(f["id"], f["name"], f["dtype"], f.get("meaning", "")) for f in meta["fields"])
    return Dataset(spark.read.parquet(f"{base}/data"), fields, meta.get("source", ""),
                   tuple(meta.get("warnings", [])), tuple(meta.get("transforms", [])))


UTF8_BOM = "\ufeff"


def write_result(df: DataFrame, path: str, fmt: str = "json", report: dict | None = None,
                 bom: bool = True) -> None:
    """Result sink: JSON records, CSV (UTF-8 with header) or Parquet, plus
    the plan report next to it.  CSV part files start with a byte-order mark
    (spreadsheet tools need it to read UTF-8): it is written as the first
    character of the header line of every part file."""
    if fmt == "csv" and bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], UTF8_BOM + df.columns[0])
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(f"{path}/data")
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(f"{path}/data")
    else:
        writer.format(fmt).save(f"{path}/data")
    if report is not None:
        _write_json(df.sparkSession, f"{path}/report.json", report)


def _public(meta: dict) -> dict:
    """A dataset description without where its data lies."""
    out = {k: v for k, v in meta.items() if k != "source"}
    out["transforms"] = [{k: v for k, v in t.items() if k != "source"} for t in meta.get("transforms", [])]
    return out


def write_package(ds: Dataset, plan: Plan, path: str, include_data: bool = False, chart: dict | None = None) -> None:
    """Reproduction package: plan, dataset description with its checksum (no
    private paths), the chart configuration, the result, and optionally the data."""
    spark = ds.df.sparkSession
    meta = _public(ds.metadata()) | {"checksum": fingerprint(ds.df).first()["checksum"]}
    if chart is not None:
        _write_json(spark, f"{path}/chart.json", chart)
    _write_json(spark, f"{path}/plan.json", plan.to_dict())
    _write_json(spark, f"{path}/dataset.json", meta)
    compile_plan(ds, plan).df.write.mode("errorifexists").parquet(f"{path}/result")
    if include_data:
        ds.df.write.mode("errorifexists").parquet(f"{path}/data")


def rerun_package(spark: SparkSession, path: str, ds: Dataset | None = None, digits: int = 9) -> DataFrame:
    """Recompute a package's plan and return rows that differ from the stored
    result (both directions, duplicates respected); empty means reproduced.
    Doubles are compared to ``digits`` significant digits: sums depend on the
    order of addition in the last ones."""
    plan = Plan.from_dict(_read_json(spark, f"{path}/plan.json"))
    if ds is None:
        meta = _read_json(spark, f"{path}/dataset.json")
        fields = tuple(Field(f["id"], f["name"], f["dtype"], f.get("meaning", "")) for f in meta["fields"])
        ds = Dataset(spark.read.parquet(f"{path}/data"), fields)
    def rounded(df: DataFrame) -> DataFrame:
        doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
        return df.withColumns({c: F.format_string(f"%.{digits - 1}e", F.col(c)) for c in doubles})
    fresh = rounded(compile_plan(ds, plan).df)
    stored = rounded(spark.read.parquet(f"{path}/result"))
    return (fresh.exceptAll(stored).withColumn("_side", F.lit("recomputed_only"))
            .unionByName(stored.exceptAll(fresh).withColumn("_side", F.lit("stored_only"))))

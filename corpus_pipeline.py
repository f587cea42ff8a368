"""Corpus pipeline over ``documents``: filter, deduplicate, decontaminate and pack.

Each stage takes all that its predecessor kept and returns the columns of
``documents``; the last returns packed pieces.  A text that loses words keeps
the others joined by one space, and its ``n_chars`` is counted anew.  Rows that
share an id, or have none, share the decision of the quality stage where any of
them is kept; near dedup tells rows apart by a stored row key, decontamination
by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm.common import drop_paths, stored, table, unused, written_paths
from planwise.llm.decontaminate import contaminated
from planwise.llm.near_dedup import near_duplicates
from planwise.llm.packing import pack_documents, public_tokenizer
from planwise.llm.quality import classify
from planwise.llm.substrings import remove_repeats


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    key = unused(docs.columns, "_kept_id")
    kept = decided.where("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity fits their language's trusted text."""
    return _kept(docs, classify(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, one with the smallest id, of each group of near duplicates (five words, 0.8).

    Repeated rows and rows without an id are rows like others; of these a row without an id stays last.
    """
    row = unused(docs.columns, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows, doc_id=row, width=5).select(row, "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row)
    first = (groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(order).alias("least"))
             .select(F.col(f"least.{row}").alias(row)))
    return rows.join(first, row, "left_semi").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows; a text that loses nothing stays as it is."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = remove_repeats(docs.select("doc_id", "text", *[F.col(c).alias(f"_old_{c}") for c in others]),
                         carry=tuple(f"_old_{c}" for c in others), originals=True)
    fresh = {"doc_id": F.col("doc_id"), "text": F.col("kept"),
             "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("_old_n_chars"))}
    return out.select(*[(fresh[c] if c in fresh else F.col(f"_old_{c}")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    key = unused(docs.columns, "_key")
    whole = docs.withColumn(key, F.struct("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5")))
    leak = unused(whole.columns, "_leak")
    leaks = contaminated(whole, table(spark, sf_dir, "benchmark"), doc_id=key).select(F.col(key).alias(leak)).distinct()
    return whole.join(leaks, F.col(key).eqNullSafe(F.col(leak)), "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 ids."""
    return pack_documents(docs, public_tokenizer())


STAGES = [("quality classifier", quality_classifier), ("near dedup", near_dedup), ("substring dedup", substring_dedup),
          ("decontamination", decontamination), ("packing", packing)]

ORACLE_SQL = None  # trained models and tokenizers; tests compare each stage with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; once a stage's rows are stored, what it and the stage before it wrote is deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with written_paths() as paths:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_paths(spark, before + paths[:-1])
        before = paths[-1:]
    return docs

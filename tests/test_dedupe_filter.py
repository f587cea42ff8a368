"""Hash-first removal of duplicates: one path for every filter size, exact at each."""

import re

import pytest
from pyspark.sql import functions as F

from planwise.operators.dedupe import _mask, drop_exact_duplicates, repeated_filter


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def many(spark):
    """12,000 rows: a third is one row, half of the others occur twice, some are null."""
    n = F.col("id")
    return spark.range(0, 12_000, 1, 6).select(
        F.when(n % 3 == 0, 0).otherwise(n % 6_000).alias("k"),
        F.when(n % 7 == 0, None).otherwise(F.lit("x")).alias("_row_hash"),
        F.when(n % 3 == 0, "hot").otherwise(F.repeat(F.lit("long "), (n % 5).cast("int"))).alias("a.b"))


@pytest.mark.parametrize("words", [1, 8, 512, 1 << 20])
def test_every_filter_size_is_exact(many, words):
    got = drop_exact_duplicates(many, "hash", words)
    assert got.columns == many.columns
    assert rows_of(got) == rows_of(many.distinct())


def test_filter_is_bounded_and_has_no_false_negatives(spark):
    hashed = spark.range(5_000).selectExpr("explode(array(id, id)) AS id").select(F.xxhash64("id").alias("h"))
    assert repeated_filter(hashed, "h", 16).count() == 16
    assert repeated_filter(hashed.distinct(), "h").count() == 0
    words = 1 << 12
    found = repeated_filter(hashed, "h", words)
    passes = (F.pmod("h", F.lit(words)) == F.col("word")) & (F.col("bits").bitwiseAND(_mask(F.col("h"))) == _mask(F.col("h")))
    assert hashed.distinct().join(found, passes, "left_anti").count() == 0
    unseen = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h"))
    assert unseen.join(found, passes, "left_semi").count() < 1_000  # of 20,000


def test_unique_rows_are_not_shuffled(spark, many, capsys):
    drop_exact_duplicates(many, "hash").explain()
    plan = capsys.readouterr().out
    stays = plan[:plan.index("HashAggregate")]  # the union's first side, down to its scan
    assert re.search(r"BroadcastHashJoin.*LeftAnti", stays) and "hashpartitioning" not in stays


def test_empty_and_signed_zero(spark):
    assert drop_exact_duplicates(spark.createDataFrame([], "a int, b string"), "hash").count() == 0
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (None,), (None,)], "v double")
    assert drop_exact_duplicates(zeros, "hash").count() == zeros.dropDuplicates().count() == 3

"""Exact removal of duplicate rows, with a hash-first variant for wide rows.

``shuffle`` is Spark's ``dropDuplicates``: every distinct row of every task
crosses the network once.  ``hash`` counts 64-bit row hashes first (an 8-byte
shuffle) and gathers those that occur more than once in a Bloom filter: a hash
names one word of 64 bits and four bits of it, and the words are merged by
``bit_or``, partially before the shuffle.  A row whose bits are not all set has
no duplicate and stays where it is; the others, repeated rows and false alarms,
go through an exact ``dropDuplicates``.

The filter has a fixed number of words, so what is broadcast is bounded whatever
the input's size, and there is one path for every size: with more repeated
hashes the words fill up and more unique rows take the exact path, until all
do.  The result is exact always, as colliding but different rows are compared
in full.  A row that occurs very often collapses inside each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwise.functions.exprs import quote_id, unused_names
from planwise.session import ensure_checkpoint_dir

FILTER_WORDS = 1 << 20  # words of 64 bits: at most 8 MiB of bits, 16 bytes a broadcast row
BITS = 4  # set for each hash


def _mask(row_hash: Column) -> Column:
    """The bits of a hash: four runs of six bits of a second hash."""
    second = F.xxhash64(row_hash, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"),
                            F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def repeated_filter(hashed: DataFrame, row_hash: str, words: int = FILTER_WORDS) -> DataFrame:
    """Bloom filter (word, bits) of the hashes that occur more than once; at most ``words`` rows."""
    repeated = hashed.groupBy(row_hash).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (repeated.groupBy(F.pmod(F.col(row_hash), F.lit(max(1, words))).alias("word"))
            .agg(F.bit_or(_mask(F.col(row_hash))).alias("bits")))


def drop_exact_duplicates(df: DataFrame, strategy: str = "shuffle", filter_words: int = FILTER_WORDS) -> DataFrame:
    if strategy == "shuffle" or not df.columns:
        return df.dropDuplicates()
    if strategy != "hash":
        raise ValueError("strategy must be 'shuffle' or 'hash'")
    ensure_checkpoint_dir(df.sparkSession)
    cols = [quote_id(c) for c in df.columns]
    row_hash, word, bits = unused_names(df.columns, "_row_hash", "_word", "_bits")
    hashed = df.withColumn(row_hash, F.xxhash64(*[F.col(c) for c in cols]))
    found = repeated_filter(hashed, row_hash, filter_words).toDF(word, bits).checkpoint(eager=True)
    mask = _mask(F.col(row_hash))
    hit = (F.pmod(F.col(row_hash), F.lit(max(1, filter_words))) == F.col(word)) & (F.col(bits).bitwiseAND(mask) == mask)
    unique_rows = hashed.join(F.broadcast(found), hit, "left_anti").select(cols)
    suspects = hashed.join(F.broadcast(found), hit, "left_semi").select(cols)
    return unique_rows.unionByName(suspects.dropDuplicates())

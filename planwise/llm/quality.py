"""Operator 6: quality filter by an interpolated modified Kneser-Ney model.

The model is an n-gram model over the bytes of the token stream of a text (its
words joined by one space, then an end mark), trained on trusted documents.
Counts are joined shard by shard with the distinct n-grams of each block of
documents, which gives every document its perplexity.  A document is kept if
its perplexity lies between a low and a high limit (text that repeats itself
strays below as well as above) of its own language, at every size by one rule:
the high one is a quantile of the trusted documents that the model has not
seen, the low one of all trusted documents, as copies of what it has seen fall
lower; both are widened in inverse proportion to the number of documents.  A
length class moves them toward its own quantiles as if the language's had the
weight of ``least`` documents.  A language without such documents has no limit
on that side, and no other language's.

The model is fitted on all trusted documents but the fifth set aside by the
checksum of the id, which is unseen; every other count, score and quantile
covers all rows.  ``train_rows`` may bound the fitted documents (to those with
the smallest hashes of their ids; the others are unseen then); by default
nothing does.

Defined cases: null text is empty; a text without words is rejected; a null
language is a language of its own; a null label or one for an unknown
document is ignored; without trusted documents nothing is rejected but texts
without words; repeated rows are scored one by one; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm import lookup
from planwise.llm.bytegrams import suffix_bits, window_sums, windows, with_levels
from planwise.llm.common import (KeyMap, byte_values, distinct, merged, packed_blocks, per_block, release, shard_count,
                                 stored, table, text_bytes, unpack_block)
from planwise.llm.tokens import Tokens, chunks

ORDER = 4
TRAIN_ROWS = None
QUANTILE = 0.998
LEAST = 200
WIDEN = 10  # times the spread from the median to a limit, over the number of documents


def _requests(docs: DataFrame, order: int, shards: int) -> DataFrame:
    def ask(block, rows):
        texts, train = byte_values(rows["_text"]), np.array(rows["_train"].to_pylist(), bool)
        parts = []
        for learn in (True, False):
            for part in chunks([texts[i] for i in np.flatnonzero(train == learn)]):
                keys, n = distinct(windows(*Tokens(part, lower=False).stream(), order))
                parts.append((keys, n if learn else np.zeros(len(keys), np.int64)))
        yield from lookup.request_rows(block, 0, *merged(parts), shards)
    return per_block(docs, ask, lookup.REQUEST)


def discounts(grams: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and above, from how many n-grams occur 1 to 4 times."""
    n = grams.agg(*[F.coalesce(F.sum((F.col("n") == i).cast("long")), F.lit(0)) for i in (1, 2, 3, 4)]).first()
    if not (n[0] and n[1] and n[2]):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)]


def kn_levels(grams: DataFrame, order: int):
    """Count tables, order 0 first, and the discounts; below the top a count is the number of distinct bytes before."""
    counts = [grams.select(F.col("key").alias("g"), "n")]
    for k in reversed(range(order)):
        counts.append(stored(counts[-1].groupBy(F.col("g").bitwiseAND(F.lit(suffix_bits(k))).alias("g"))
                             .agg(F.count("*").alias("n")), f"kn-order{k}"))
    counts.reverse()
    levels, cuts = [], []
    for k, c in enumerate(counts):
        cuts.append(discounts(c))
        kinds = [F.sum(F.when(F.col("n") == 1, 1).otherwise(0)), F.sum(F.when(F.col("n") == 2, 1).otherwise(0)),
                 F.sum(F.when(F.col("n") > 2, 1).otherwise(0))]
        contexts = (c.groupBy(F.shiftright("g", 8).alias("ctx"))
                    .agg(F.sum("n").alias(f"t{k}"), *[x.alias(f"{v}{k}") for v, x in zip("xyz", kinds)]))
        levels.append((c.select("g", F.col("n").alias(f"c{k}")), contexts))
    return levels, cuts


def kn_value(cuts: list[list[float]]):
    """log10 probability of a window from the columns that ``with_levels`` adds."""
    p = F.lit(1 / 256)
    for k, (d1, d2, d3) in enumerate(cuts):
        c, t = F.col(f"c{k}"), F.col(f"t{k}")
        off = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        left = (d1 * F.col(f"x{k}") + d2 * F.col(f"y{k}") + d3 * F.col(f"z{k}")) / t
        p = F.coalesce((c - off) / t, F.lit(0.0)) + F.coalesce(left, F.lit(1.0)) * p
    return F.log10(p)


def perplexities(docs: DataFrame, train, text: str, keep: list[str], order: int = ORDER) -> DataFrame:
    """The columns ``keep`` with n_bytes and log10 probability of every row, for a model of the rows where ``train`` holds."""
    picked = docs.select(*keep, F.col(text).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    shards = shard_count(text_bytes(picked, "_text"))
    requests = stored(_requests(picked, order, shards), "kn-requests")
    grams = stored(lookup.counted(requests), "kn-counts")
    levels, cuts = kn_levels(grams.where("n > 0"), order)
    values = with_levels(grams.select("kind", "shard", "key"), levels).select(
        "kind", "shard", "key", kn_value(cuts).cast("float").cast("double").alias("value"))
    found = lookup.answers(requests, stored(values, "kn-values"))
    kept_types = [f"{c} {picked.schema[c].dataType.simpleString()}" for c in keep]

    def finish(packed: pa.Table, got: pa.Table) -> pa.Table:
        release()  # what the block before it took
        if not packed.num_rows:
            raise RuntimeError("answers for an unknown block: the input changed between two reads of it")
        rows = unpack_block(packed["data"][0].as_py())
        keys, vals = lookup.read_answers(got, 0)
        known, sums, sizes = KeyMap(keys), [], []
        for part in chunks(byte_values(rows["_text"])):
            data, starts = Tokens(part, lower=False).stream()
            sums.append(window_sums(known, vals, data, starts, order))
            sizes.append(np.diff(np.append(starts, len(data))))
        return pa.table({**{c: rows[c] for c in keep}, "n_bytes": pa.array(np.concatenate(sizes), pa.int64()),
                         "log10_p": pa.array(np.concatenate(sums), pa.float64())})
    return (packed_blocks(picked).groupBy("block").cogroup(found.groupBy("block"))
            .applyInArrow(finish, ", ".join([*kept_types, "n_bytes bigint", "log10_p double"])))


def _marked(base: DataFrame, fitted: DataFrame) -> DataFrame:
    """``base`` with ``_fit``, true for the rows whose ``_id`` is in ``fitted`` and else null, without a shuffle of the texts.

    Ids alone are joined; the rows found come back as a bit for each place in the input, 64 places to a broadcast row.
    """
    placed = base.withColumn("_place", F.monotonically_increasing_id())
    bits = (placed.select("_id", "_place").join(fitted, "_id").groupBy(F.shiftright("_place", 6).alias("_word"))
            .agg(F.expr("bit_or(shiftleft(1L, CAST(_place & 63 AS INT)))").alias("_bits")))
    fit = F.expr("CASE WHEN shiftright(_bits, CAST(_place & 63 AS INT)) & 1L = 1L THEN true END")
    return (placed.join(F.broadcast(stored(bits, "kn-fitted-places")), F.shiftright("_place", 6) == F.col("_word"), "left")
            .select(*base.columns, fit.alias("_fit")))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang",
             order: int = ORDER, train_rows: int | None = TRAIN_ROWS, quantile: float = QUANTILE, least: int = LEAST) -> DataFrame:
    """(doc id, lang, n_bytes, perplexity, lowest, highest, kept) for every row; labels has (doc_id, quality)."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    fold = F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(5)) == 0
    fitted = trusted.where(~fold)
    fitted = stored(fitted if train_rows is None else fitted.orderBy(F.xxhash64("_id"), "_id").limit(train_rows), "kn-fitted")
    marked = _marked(docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_body")), fitted)
    scored = stored(perplexities(marked, F.col("_fit"), "_body", ["_id", "_lang", "_fit"], order)
                    .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_p") / F.col("n_bytes")))
                    .withColumn("_ln", F.ln("perplexity"))
                    .withColumn("_class", F.least(F.greatest(F.log2("n_bytes").cast("int"), F.lit(4)), F.lit(12))), "kn-scored")
    known = scored.select("_id", "_fit").join(fitted.withColumn("_is", F.lit(True)), "_id", "left")
    if not known.where(~F.col("_fit").eqNullSafe(F.col("_is"))).isEmpty():
        raise RuntimeError("fitted rows were marked wrongly: the input changed between two reads of it")
    good = scored.join(trusted, "_id", "left_semi").where("n_bytes > 1")
    unseen = F.when(F.col("_fit").isNull(), F.col("_ln"))

    def ends(by: list[str], tag: str) -> DataFrame:
        low = F.percentile_approx("_ln", [1 - quantile, 0.5], 20_000)
        high = F.percentile_approx(unseen, [0.5, quantile], 20_000)
        return good.groupBy(*[F.col(c).alias(f"{c}_{tag}") for c in by]).agg(
            low.alias(f"low_{tag}"), F.count("_ln").alias(f"n_{tag}"), high.alias(f"high_{tag}"), F.count(unseen).alias(f"m_{tag}"))

    # few documents show little of a language's spread: limits are further apart by a share of it, and one of e, over their number
    own = ends(["_lang"], "l").select(
        "_lang_l", F.expr(f"low_l[0] - ({WIDEN} * (low_l[1] - low_l[0]) + 1) / n_l").alias("low"),
        F.expr(f"CASE WHEN m_l > 0 THEN high_l[1] + ({WIDEN} * (high_l[1] - high_l[0]) + 1) / m_l END").alias("high"))
    classes = ends(["_lang", "_class"], "c").select("_lang_c", "_class_c", "n_c", "m_c", F.col("low_c")[0].alias("low_c"),
                                                    F.col("high_c")[1].alias("high_c"))
    out = (scored.join(F.broadcast(stored(own, "kn-quantile")), F.col("_lang").eqNullSafe(F.col("_lang_l")), "left")
           .join(F.broadcast(stored(classes, "kn-quantile")),  # a row for each language and length class
                 F.col("_lang").eqNullSafe(F.col("_lang_c")) & (F.col("_class") == F.col("_class_c")), "left"))
    lowest, highest = (F.coalesce((F.col(n) * F.col(f"{x}_c") + least * F.col(x)) / (F.col(n) + least), F.col(x))
                       for x, n in (("low", "n_c"), ("high", "m_c")))
    fits = F.coalesce(F.col("_ln") >= lowest, F.lit(True)) & F.coalesce(F.col("_ln") <= highest, F.lit(True))
    return out.select(F.col("_id").alias(doc_id), F.col("_lang").alias(lang), "n_bytes", "perplexity", F.exp(lowest).alias("lowest"),
                      F.exp(highest).alias("highest"), ((F.col("n_bytes") > 1) & fits).alias("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

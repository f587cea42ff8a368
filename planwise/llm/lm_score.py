"""Operator 1: language-model scoring by prediction by partial matching (PPM).

The model is a trie of byte contexts of order 0 to ``order`` over the token
stream of a text: its words, lower-cased A-Z, joined by one space, then an end
mark.  Escapes follow method D (each distinct symbol gives half a count to the
escape); symbols that a longer context has seen are excluded from the shorter
ones, and are not counted there either (a shorter context counts a symbol once
for each longer context that it followed); below order 0 the symbols not yet
seen share the rest.

Pretrained scoring counts windows in the training rows on Spark, so that the
trie grows with the corpus and is never held in one place; adaptive scoring
(:func:`adaptive_score`) learns each document from nothing while reading it.

Defined cases: null or empty text is the end mark alone; a null id counts as
an empty one for the split; repeated rows are scored (and learned) one by one;
an empty table gives an empty result; without training rows every byte costs
1/256.  Words are keyed by 64-bit hashes in the count join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm import lookup
from planwise.llm.bytegrams import suffix_bits, window_sums, windows, with_levels
from planwise.llm.common import (KeyMap, byte_values, distinct, merged, packed_blocks, per_block, release,
                                 shard_count, stored, table, text_bytes, unpack_block)
from planwise.llm.tokens import Tokens, chunks

ORDER = 5
GRAM, WORD = 0, 1
END_WORD = 0x5E4D0F7E47  # key of the end token in the count join


def held_out(doc_id, folds: int = 7, fold: int = 2):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _requests(docs: DataFrame, order: int, shards: int) -> DataFrame:
    def ask(block, rows):
        texts, train = byte_values(rows["_text"]), np.array(rows["_train"].to_pylist(), bool)
        words, grams = {True: [], False: []}, {True: [], False: []}
        for learn in (True, False):
            chosen = [texts[i] for i in np.flatnonzero(train == learn)]
            for part in chunks(chosen):
                tokens = Tokens(part, lower=True)
                words[learn].append(distinct(tokens.keys()))
                words[learn].append((np.array([END_WORD], np.uint64), np.array([len(part)])))
                grams[learn].append(distinct(windows(*tokens.stream(), order)))
        for kind, parts in ((WORD, words), (GRAM, grams)):
            keys, n = merged(parts[True] + [(k, np.zeros(len(k), np.int64)) for k, _ in parts[False]])
            yield from lookup.request_rows(block, kind, keys, n, shards)
    return per_block(docs, ask, lookup.REQUEST)


def ppm_levels(grams: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """Count tables of the trie, order 0 first: gram counts, and for each
    context its total, its distinct symbols and the mass these have one order lower."""
    counts = [grams.select(F.col("key").alias("g"), F.col("n"))]
    for k in reversed(range(order)):
        counts.append(stored(counts[-1].groupBy(F.col("g").bitwiseAND(F.lit(suffix_bits(k))).alias("g"))
                             .agg(F.count("*").alias("n")), f"lm-order{k}"))
    counts.reverse()
    levels = []
    for k, c in enumerate(counts):
        nodes = c.select(F.shiftright("g", 8).alias("ctx"), "g", "n")
        if k:
            lower = counts[k - 1].select(F.col("g").alias("low"), F.col("n").alias("low_n"))
            nodes = nodes.join(lower, F.col("g").bitwiseAND(F.lit(suffix_bits(k - 1))) == F.col("low"))
        else:
            nodes = nodes.withColumn("low_n", F.lit(0))
        contexts = nodes.groupBy("ctx").agg(F.sum("n").alias(f"t{k}"), F.count("*").alias(f"d{k}"),
                                            F.sum("low_n").alias(f"e{k}"))
        levels.append((c.select("g", F.col("n").alias(f"c{k}")), contexts))
    return levels


def ppm_value(order: int):
    """log10 probability of a window from the columns that :func:`with_levels` adds."""
    def level(k: int, above: int | None):
        # ``above``: the context one order higher that was seen and escaped from
        dx, ex = (F.col(f"d{above}"), F.col(f"e{above}")) if above is not None else (F.lit(0), F.lit(0))
        if k < 0:
            return -F.log10(F.lit(256.0) - dx)
        fresh, mass = (F.col(f"d{k}") - dx).cast("double"), (F.col(f"t{k}") - ex).cast("double")
        seen = F.log10((2 * F.col(f"c{k}") - 1) / (2 * mass))
        escape = F.when(fresh > 0, F.log10(fresh / (2 * mass))).otherwise(0.0)
        known = F.when(F.col(f"c{k}").isNotNull(), seen).otherwise(escape + level(k - 1, k))
        # once a context is known, all shorter ones are
        return known if above is not None else F.when(F.col(f"t{k}").isNull(), level(k - 1, None)).otherwise(known)
    return level(order, None)


def score(docs: DataFrame, train, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """Score every row of ``docs`` with a model of the rows where ``train`` holds.

    Returns (doc id, held_out, n_tokens, n_known, train_tokens, base_score, score).
    """
    picked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"),
                         F.coalesce(train, F.lit(False)).alias("_train"))
    shards = shard_count(text_bytes(picked, "_text"))
    requests = stored(_requests(picked, order, shards), "lm-requests")
    counts = stored(lookup.counted(requests), "lm-counts")
    totals = (counts.where((F.col("kind") == WORD) & (F.col("n") > 0))
              .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first())
    n_train, vocabulary = int(totals["n"]), int(totals["v"])
    grams = counts.where(F.col("kind") == GRAM)
    wide = with_levels(grams.select("kind", "shard", "key"), ppm_levels(grams.where("n > 0"), order))
    values = wide.select("kind", "shard", "key", ppm_value(order).cast("float").cast("double").alias("value")).unionByName(
        counts.where(F.col("kind") == WORD).select("kind", "shard", "key", F.col("n").cast("double").alias("value")))
    found = lookup.answers(requests, stored(values, "lm-values"))
    id_type = picked.schema["_id"].dataType.simpleString()
    whole = n_train + 1 * (vocabulary + 1)

    def finish(packed: pa.Table, got: pa.Table) -> pa.Table:
        if not packed.num_rows:
            raise RuntimeError("answers for an unknown block: the input changed between two reads of it")
        rows = unpack_block(packed["data"][0].as_py())
        word_keys, word_n = lookup.read_answers(got, WORD)
        gram_keys, gram_p = lookup.read_answers(got, GRAM)
        word_map, gram_map = KeyMap(word_keys), KeyMap(gram_keys)
        end = word_n[word_map.find(np.array([END_WORD], np.uint64))[0]]
        n_tokens, n_known, base, sums = [], [], [], []
        for part in chunks(byte_values(rows["_text"])):
            tokens = Tokens(part, lower=True)
            at = word_map.find(tokens.keys())
            if len(at) and at.min() < 0:
                raise RuntimeError("a word has no count: the input changed between two reads of it")
            c = word_n[at]
            cuts = np.concatenate([[0], np.cumsum(c > 0)]), np.concatenate([[0.0], np.cumsum(np.log10((c + 1) / whole))])
            known, logs = (cut[tokens.first + tokens.count] - cut[tokens.first] for cut in cuts)
            n_tokens.append(tokens.count + 1)
            n_known.append(known + (end > 0))
            base.append(logs + math.log10((end + 1) / whole))
            sums.append(window_sums(gram_map, gram_p, *tokens.stream(), order))
        del word_map, gram_map, word_keys, gram_keys, word_n, gram_p
        release()
        n = rows.num_rows
        return pa.table({"id": rows["_id"], "held_out": pc.invert(rows["_train"]),
                         "n_tokens": pa.array(np.concatenate(n_tokens), pa.int64()),
                         "n_known": pa.array(np.concatenate(n_known), pa.int64()),
                         "train_tokens": pa.array([n_train] * n, pa.int64()),
                         "base_score": pa.array(np.concatenate(base), pa.float64()),
                         "score": pa.array(np.concatenate(sums), pa.float64())})

    schema = (f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double")
    return (packed_blocks(picked).groupBy("block").cogroup(found.groupBy("block"))
            .applyInArrow(finish, schema).withColumnRenamed("id", doc_id))


def adaptive_score(text: str | None, order: int = ORDER) -> float:
    """log10 probability of one text under a trie that starts empty and learns each byte after coding it."""
    trie: dict[bytes, Counter] = {}
    return coded(trie, text, order, learn=True)


def coded(trie: dict[bytes, Counter], text: str | None, order: int, learn: bool) -> float:
    """Code length (log10) of one text under a trie of contexts; ``learn`` updates it byte by byte."""
    data = b"\xff" * order + b" ".join(_words((text or "").encode())) + b"\xff"
    total = 0.0
    for i in range(order, len(data)):
        symbol, excluded, p, found = data[i], set(), None, 0
        for k in range(order, -1, -1):
            node = trie.get(data[i - k:i])
            if node is None:
                continue
            live = {s: c for s, c in node.items() if s not in excluded}
            mass = sum(live.values())
            if symbol in live:
                p, found = (2 * live[symbol] - 1) / (2 * mass), k
                break
            if live:
                total += math.log10(len(live) / (2 * mass))
            excluded = set(node)
        total += math.log10(p) if p is not None else -math.log10(256 - len(excluded))
        if learn:
            for k in range(found, order + 1):
                trie.setdefault(data[i - k:i], Counter())[symbol] += 1
    return total


def adaptive_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """Adaptive mode for every row: (doc id, score)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "score": pa.array(
                [adaptive_score(t, order) for t in b.column(1).to_pylist()], pa.float64())})
    return (docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"id {kind}, score double")
            .withColumnRenamed("id", doc_id))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, ~held_out(F.col("doc_id")))

"""Operator 3: benchmark decontamination by BM25 and block-max WAND.

Equal items collapse to one text.  The number of texts, their mean and largest
length and the document frequency of each term are Spark aggregates over all
of them, so hits do not depend on how items are split.  Texts are dealt to
shards of about ``shard_items`` by their hash; a task builds each shard's index
and writes it to the shared folder, from where the tasks that search read it,
one pass over the documents for each shard.  Every passage of every document (windows of twice the longest item,
starting once a longest item) is a query.  An item's impacts are divided by
its BM25 score for its own text, so that one threshold fits all items.

A passage is searched by block-max WAND if the bounds allow a hit: an item's
weakest terms (the frequent ones, up to a share ``weak`` of its score) count as
if all were there, and the other terms that the passage holds must bring the
sum to the threshold for some item.  What WAND retrieves is verified by five-word
shingles: the item's question (all but its last sentence) and answer (its last
sentence) must overlap with the passage, or nearly the whole item must.

Defined cases: null and empty texts hold no terms, match nothing and are never
matched; repeated items are matched under each of their ids; repeated rows give one row per
id and item; a null id is an id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm.common import KeyMap, byte_values, shared_dir, stored, table
from planwise.llm.warc import _filesystem as filesystem
from planwise.llm.tokens import WORDS_ONLY, Tokens, chunks, spans

THRESHOLD = 0.6  # of an item's own score
WEAK = 0.25
PART, WHOLE = 0.5, 0.8  # overlap of question and answer, or of the whole item
SHINGLE = 5
K1, B = 1.2, 0.75
SHARD_ITEMS = 20_000
BLOCK = 32
LEAST_STRIDE = 64
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _shingles(keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(0, np.uint64)
    return np.unique(spans(keys, min(SHINGLE, len(keys))))


def parts(text: str | None) -> tuple[str, str]:
    """Question and answer of an item; one sentence is both."""
    cut = [x for x in SENTENCE.split((text or "").strip()) if x]
    return (" ".join(cut[:-1]), cut[-1]) if len(cut) > 1 else ("".join(cut), "".join(cut))


def item_keys(text: str | None) -> np.ndarray:
    return Tokens([(text or "").encode()], True, WORDS_ONLY).keys()


class Stats(NamedTuple):
    """What BM25 counts over all item texts: their number, mean and largest length, and how many hold each term."""
    texts: int
    mean: float
    longest: int
    frequency: dict[int, int]


class Index:
    """BM25 postings of some items in blocks with their largest impacts."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = THRESHOLD, weak: float = WEAK,
                 stats: Stats | None = None):
        self.ids = [i for i, _ in items]
        keys = [item_keys(t) for _, t in items]
        self.parts = []
        for _, t in items:
            q, a = (item_keys(x) for x in parts(t))
            self.parts.append((q, a))
        self.keys = keys
        self.vocabulary = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]))
        term_of = {int(k): i for i, k in enumerate(self.vocabulary)}
        counts = [Counter(term_of[int(k)] for k in ks) for ks in keys]
        if stats is None:  # these are all items
            found = Counter(t for c in counts for t in c)
            stats = Stats(len(items), max(1.0, sum(map(len, keys)) / max(1, len(items))), max([0, *map(len, keys)]),
                          {int(k): found[i] for i, k in enumerate(self.vocabulary)})
        n = stats.texts
        df = [stats.frequency[int(k)] for k in self.vocabulary]
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        self.weak = np.zeros(len(items))
        strong: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for item, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(keys[item]) / stats.mean)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in c.items()}
            own = sum(impact.values())
            low = 0.0
            for t, x in sorted(impact.items(), key=lambda p: (p[1], int(self.vocabulary[p[0]]))):
                x /= own
                self.postings[t].append((item, x))
                if low + x <= min(weak, threshold * 0.999):
                    low += x
                else:
                    strong[t].append((item, x))
            self.weak[item] = low
        self.listed = [[i for i, _ in p] for p in self.postings]
        self.highest = [max((x for _, x in p), default=0.0) for p in self.postings]
        self.blocks = [[(p[min(a + BLOCK, len(p)) - 1][0], max(x for _, x in p[a:a + BLOCK]))
                        for a in range(0, len(p), BLOCK)] for p in self.postings]
        sizes = np.array([len(p) for p in strong] + [0])[:len(strong)].astype(np.int64)
        self.strong_n, self.strong_at = sizes, np.cumsum(sizes) - sizes
        self.strong_item = np.array([i for p in strong for i, _ in p], np.int64)
        self.strong_impact = np.array([x for p in strong for _, x in p], float)
        self.ends = [[b[0] for b in blocks] for blocks in self.blocks]
        self.stride = max(LEAST_STRIDE, stats.longest)
        self.threshold = threshold

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items whose score for the distinct query terms reaches the threshold, by block-max WAND."""
        cursors = [[self.postings[t], 0, t] for t in sorted(set(terms)) if self.postings[t]]
        out, theta = [], self.threshold * (1 - 1e-9)
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.highest[c[2]]
                if bound >= theta:
                    pivot = i
                    break
            if pivot < 0:
                break  # all lists together cannot reach the threshold
            item = cursors[pivot][0][cursors[pivot][1]][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][1]][0] == item:
                pivot += 1
            block, end = 0.0, 1 << 62
            for c in cursors[:pivot + 1]:
                k = bisect_left(self.ends[c[2]], item, c[1] // BLOCK)  # the block that may hold the item
                if k < len(self.ends[c[2]]):
                    last, most = self.blocks[c[2]][k]
                    block += most
                    end = min(end, last)
            if block < theta:
                # no item up to the first block end, nor before the next list's item, can reach it
                upto = end + 1 if end < 1 << 62 else item + 1
                if pivot + 1 < len(cursors):
                    upto = min(upto, cursors[pivot + 1][0][cursors[pivot + 1][1]][0])
                upto = max(upto, item + 1)
                moved = cursors[:pivot + 1]
            elif cursors[0][0][cursors[0][1]][0] == item:
                score = sum(c[0][c[1]][1] for c in cursors[:pivot + 1])
                if score >= theta:
                    out.append((item, score))
                upto, moved = item + 1, cursors[:pivot + 1]
            else:
                upto, moved = item, cursors[:pivot]
            for c in moved:
                c[1] = bisect_left(self.listed[c[2]], upto, c[1])
            cursors = [c for c in cursors if c[1] < len(c[0])]
        return out


def overlap(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the part's shingles that the passage holds."""
    mine = _shingles(part)
    if not len(mine):
        return 0.0
    have = spans(passage, min(SHINGLE, len(part)))
    return float(np.isin(mine, have).mean())


def passages_of(index: Index, texts: list[bytes]):
    """(text, first word, item, score, question overlap, answer overlap) of each verified hit."""
    found = KeyMap(index.vocabulary)
    stride, n_items = index.stride, max(1, len(index.ids))
    for part_start, part in _numbered(texts):
        tokens = Tokens(part, True, WORDS_ONLY)
        keys = tokens.keys()
        term = found.find(keys)
        last = np.maximum(0, -(-tokens.count // stride) - 2)
        first_passage = np.cumsum(last + 1) - (last + 1)
        at = np.flatnonzero(term >= 0)
        at = at[index.strong_n[term[at]] > 0] if len(at) else at
        owner = np.searchsorted(tokens.first + tokens.count, at, "right")
        slot = (at - tokens.first[owner]) // stride
        pairs = []
        for shift in (0, 1):
            j = slot - shift
            ok = (j >= 0) & (j <= last[owner])
            pairs.append(np.stack([first_passage[owner[ok]] + j[ok], term[at[ok]]], axis=1))
        pair = np.unique(np.concatenate(pairs) @ np.array([len(index.vocabulary) + 1, 1])) if len(at) else np.zeros(0, int)
        passage, t = pair // (len(index.vocabulary) + 1), pair % (len(index.vocabulary) + 1)
        n = index.strong_n[t]
        flat = np.repeat(index.strong_at[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(passage, n) * n_items + index.strong_item[flat]
        cells, inverse = np.unique(cell, return_inverse=True)
        strong = np.bincount(inverse, index.strong_impact[flat], len(cells))
        hot = np.unique(cells[strong + index.weak[cells % n_items] >= index.threshold * (1 - 1e-9)] // n_items)
        for p in hot.tolist():
            text = int(np.searchsorted(first_passage, p, "right")) - 1
            a = int(tokens.first[text]) + (p - int(first_passage[text])) * stride
            b = min(a + 2 * stride, int(tokens.first[text] + tokens.count[text]))
            here = term[a:b]
            for item, score in index.search(here[here >= 0].tolist()):
                q, r = (overlap(x, keys[a:b]) for x in index.parts[item])
                whole = overlap(index.keys[item], keys[a:b])
                if whole >= WHOLE or (q >= PART and r >= PART):
                    yield part_start + text, a - int(tokens.first[text]), item, score, q, r


def _numbered(texts):
    at = 0
    for part in chunks(texts):
        yield at, part
        at += len(part)


HIT = "item_id bigint, passage_start bigint, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 item_text: str = "text", item_id: str = "item_id", threshold: float = THRESHOLD,
                 shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc id, item_id, passage_start, score, question_overlap, answer_overlap): the best verified
    passage for each document and item."""
    picked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    id_type = picked.schema["_id"].dataType.simpleString()
    texts, shards = _indexed(items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")), threshold, shard_items)
    out = docs.sparkSession.createDataFrame([], f"_id {id_type}, {HIT}")
    for path in shards:
        out = out.unionByName(picked.mapInArrow(_search(path), f"_id {id_type}, {HIT}"))
    # an item's text is found once and holds for every id that has it
    out = out.withColumnRenamed("item_id", "_text_id").join(texts, "_text_id").drop("_text_id")
    best = F.max(F.struct("score", -F.col("passage_start"), "question_overlap", "answer_overlap")).alias("best")
    return (out.groupBy("_id", "item_id").agg(best)
            .select(F.col("_id").alias(doc_id), "item_id", (-F.col("best.col2")).alias("passage_start"), "best.score",
                    "best.question_overlap", "best.answer_overlap"))


def _indexed(items: DataFrame, threshold: float, shard_items: int) -> tuple[DataFrame, list[str]]:
    """((_text_id, item_id) of all items, paths of the shards' indexes) for items (i, t)."""
    spark = items.sparkSession
    named = items.where("t IS NOT NULL").select("i", "t", F.sha2(F.col("t").cast("binary"), 256).alias("h"))
    texts = stored(named.groupBy("h").agg(F.any_value("t").alias("t")).withColumn("_text_id", F.xxhash64("h")), "item-texts")

    def terms(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys, n = np.unique(item_keys(t), return_counts=True)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i)), pa.array(keys.view(np.int64)), pa.array(n)],
                                                     ["_text_id", "term", "n"])
    found = stored(texts.select("_text_id", "t").mapInArrow(terms, "_text_id bigint, term bigint, n bigint"), "item-terms")
    size = found.groupBy("_text_id").agg(F.sum("n").alias("n")).agg(F.count("*"), F.avg("n"), F.max("n")).first()
    ids = named.join(texts.select("h", "_text_id"), "h").select("_text_id", F.col("i").alias("item_id"))
    if not size[0]:
        return ids, []
    shards = -(-size[0] // shard_items)
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    known = (found.join(frequency, "term").groupBy("_text_id").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
             .join(texts, "_text_id").withColumn("shard", F.pmod(F.col("_text_id"), F.lit(shards))))
    base = shared_dir(spark, "item-index")

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = sorted(rows.select(["_text_id", "t", "terms"]).to_pylist(), key=lambda r: r["_text_id"])
        df = {x["term"] & (1 << 64) - 1: x["df"] for r in rows for x in r["terms"]}
        index = Index([(r["_text_id"], r["t"]) for r in rows], threshold, stats=Stats(size[0], max(1.0, float(size[1])), size[2], df))
        # each attempt has a file of its own; only those of finished tasks are returned
        name = f"shard-{key[0].as_py()}-{TaskContext.get().taskAttemptId()}"
        fs, root = filesystem(base)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(pickle.dumps(index))
        return pa.table({"path": [f"{base}/{name}"]})
    built = known.groupBy("shard").applyInArrow(build, "path string")
    return ids, sorted(r["path"] for r in built.collect())  # one path for each shard


_held: dict[str, Index] = {}


def _load(path: str) -> Index:
    """A shard's index; a worker holds one at a time."""
    if path not in _held:
        _held.clear()
        fs, at = filesystem(path)
        with fs.open_input_stream(at, compression=None) as data:
            _held[path] = pickle.loads(data.read())
    return _held[path]


def _search(path):
    def run(batches):
        index = _load(path)
        for b in batches:
            rows = pa.Table.from_batches([b])
            hits = list(passages_of(index, byte_values(rows["_text"])))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                pa.array([index.ids[h[2]] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()),
                *[pa.array([h[j] for h in hits], pa.float64()) for j in (3, 4, 5)]],
                ["_id", "item_id", "passage_start", "score", "question_overlap", "answer_overlap"])
    return run


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

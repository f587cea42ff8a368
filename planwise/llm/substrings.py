"""Operator 8: removal of repeated word windows.

Every window of ``width`` consecutive words gets a Rabin-Karp key.  A block of
documents sends each distinct key once to a shard, where the keys of all
blocks are counted; a bit per key comes back.  Windows whose sequence starts
anywhere else, in the same document or another, are marked on the input, and
overlapping marks merge into maximal removal intervals.

A key is 64 bits of one polynomial, dealt to shards by a second one, so two
different windows meet with a chance below 2**-64 a pair.

Defined cases: null and empty texts have no words; texts shorter than a window
lose nothing; repeated rows are documents of their own and lose what they
share; an empty table gives an empty result; ids may be null or repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm.common import (KeyMap, byte_values, distinct, mixed, packed_blocks, per_block, release, shard_count,
                                 squeeze, squeeze_sorted, table, text_bytes, unpack_block, unsqueeze, unsqueeze_sorted)
from planwise.llm.tokens import Tokens, chunks, spans

WIDTH = 35
SECOND = 0xA0761D6478BD642F
REQUEST = "block bigint, shard bigint, n_keys bigint, keys binary, more binary"
REPLY = "block bigint, shard bigint, n_keys bigint, repeated binary"


def _windows(texts: list[bytes], width: int, shards: int):
    """Tokens of the texts, and of each window inside one text its first word, key and shard."""
    tokens = Tokens(texts, lower=False)
    words = tokens.keys()
    n = max(0, len(words) - width + 1)
    owner = np.repeat(np.arange(len(texts)), tokens.count)
    at = np.flatnonzero(owner[:n] == owner[width - 1:width - 1 + n])
    keys = spans(words, width)[at]
    shard = (spans(words, width, SECOND)[at] % np.uint64(shards)).astype(np.uint32)
    return tokens, at, keys, shard


def _by_shard(parts: list[tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct keys of each shard, with how often each occurs; empties ``parts``."""
    keys, shard = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    parts.clear()
    order = np.argsort(shard, kind="stable")
    keys, shard = keys[order], shard[order]
    del order
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    out = {}
    for a, b in zip(cut, np.append(cut[1:], len(shard))):
        out[int(shard[a])] = distinct(keys[a:b])
    return out


def _requests(docs: DataFrame, width: int, shards: int) -> DataFrame:
    def ask(block, rows):
        parts = [_windows(part, width, shards)[2:] for part in chunks(byte_values(rows["_text"]))]
        for shard, (keys, n) in _by_shard(parts).items():
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "shard": pa.array([shard], pa.int64()),
                "n_keys": pa.array([len(keys)], pa.int64()), "keys": pa.array([squeeze_sorted(keys)], pa.binary()),
                "more": pa.array([squeeze(np.packbits(n > 1))], pa.binary())})
    return per_block(docs, ask, REQUEST)


def _replies(requests: DataFrame) -> DataFrame:
    def count(asked: pa.Table) -> pa.Table:
        release()  # what the shard before it took
        keys = [unsqueeze_sorted(k) for k in asked["keys"].to_pylist()]
        more = [np.unpackbits(unsqueeze(m, np.uint8), count=len(k)).astype(bool)
                for k, m in zip(keys, asked["more"].to_pylist())]
        every = np.sort(np.concatenate([np.concatenate(keys), np.concatenate([k[m] for k, m in zip(keys, more)])]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for k in keys:
            at = np.minimum(np.searchsorted(twice, k), max(0, len(twice) - 1))
            out.append(squeeze(np.packbits(twice[at] == k if len(twice) else np.zeros(len(k), bool))))
        return pa.table({"block": asked["block"], "shard": asked["shard"], "n_keys": asked["n_keys"],
                         "repeated": pa.array(out, pa.binary())})
    return requests.groupBy("shard").applyInArrow(count, REPLY)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH,
                   carry: tuple[str, ...] = (), originals: bool = False) -> DataFrame:
    """(doc id, n_words, n_removed, removed, kept, carried columns): ``removed`` lists maximal intervals
    [first, last] of word positions, ``kept`` holds the other words joined by one space; with ``originals``,
    ``kept`` is the text as it was, null included, where nothing is removed."""
    picked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"),
                         *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)])
    shards = shard_count(text_bytes(picked, "_text"))
    replies = _replies(_requests(picked, width, shards))

    def judged(packed: pa.Table, got: pa.Table) -> pa.Table:
        if not packed.num_rows:
            raise RuntimeError("replies for an unknown block: the input changed between two reads of it")
        rows = unpack_block(packed["data"][0].as_py())
        runs = list(chunks(byte_values(rows["_text"])))
        mine = _by_shard([_windows(part, width, shards)[2:] for part in runs])
        repeated = [np.zeros(0, np.uint64)]
        answered = 0
        for shard, n, bits in zip(got["shard"].to_pylist(), got["n_keys"].to_pylist(), got["repeated"].to_pylist()):
            keys, _ = mine.get(shard, (np.zeros(0, np.uint64), None))
            if len(keys) != n:
                raise RuntimeError("a block's windows changed between two reads of the input")
            answered += n
            repeated.append(mixed(keys[np.unpackbits(unsqueeze(bits, np.uint8), count=n).astype(bool)]
                                  ^ np.uint64(shard)))
        if answered != sum(len(k) for k, _ in mine.values()):
            raise RuntimeError("a block's windows changed between two reads of the input")
        del mine
        hit = KeyMap(np.unique(np.concatenate(repeated)))
        n_words, n_removed, removed, kept = [], [], [], []
        whole = rows["_text"].cast(pa.binary()).to_pylist() if originals else None
        for part in runs:
            tokens, at, keys, shard = _windows(part, width, shards)
            first = at[hit.find(mixed(keys ^ shard.astype(np.uint64))) >= 0]
            total = int(tokens.count.sum())
            edges = np.zeros(total + 1, np.int32)
            np.add.at(edges, first, 1)
            np.add.at(edges, first + width, -1)
            gone = np.cumsum(edges[:-1]) > 0
            lost = np.concatenate([[0], np.cumsum(gone)])
            stream, starts = tokens.stream()
            ends = np.append(starts[1:], len(stream)) - 1
            flat = stream.tobytes()
            for i, (f, c) in enumerate(zip(tokens.first.tolist(), tokens.count.tolist())):
                n = int(lost[f + c] - lost[f])
                n_words.append(c)
                n_removed.append(n)
                if not n:
                    removed.append([])
                    kept.append(whole[len(kept)] if originals else flat[starts[i]:ends[i]])
                    continue
                mask = gone[f:f + c]
                turn = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                removed.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(turn[0::2], turn[1::2])])
                words = part[i].split()
                kept.append(b" ".join([w for w, g in zip(words, mask.tolist()) if not g]))
        return pa.table({"id": rows["_id"], "n_words": pa.array(n_words, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()),
                         "removed": pa.array(removed, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                         "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                         **{f"_carry{i}": rows[f"_carry{i}"] for i in range(len(carry))}})

    def finish(packed: pa.Table, got: pa.Table) -> pa.Table:
        out = judged(packed, got)
        release()
        return out

    id_type = picked.schema["_id"].dataType.simpleString()
    schema = f"id {id_type}, n_words bigint, n_removed bigint, removed array<struct<first:int,last:int>>, kept string"
    schema += "".join(f", _carry{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return (packed_blocks(picked).groupBy("block").cogroup(replies.groupBy("block"))
            .applyInArrow(finish, schema)
            .withColumnsRenamed({"id": doc_id} | {f"_carry{i}": c for i, c in enumerate(carry)}))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (remove_repeats(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))

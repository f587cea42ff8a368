"""Operator 5: near-duplicate documents by HyperMinHash.

A document's set is its distinct shingles of ``width`` lower-cased words; with
fewer words the whole sequence is one shingle; without words the set is empty
and linked with nothing.  Each shingle's 64-bit key falls into one of 256
buckets by its first 8 bits; the bucket's register keeps the leading zeros and
ten mantissa bits of the smallest rest, 16 bits in all.  Empty registers of
small sets borrow from a full one in an order fixed by the bucket.

Documents with equal sets form one class.  Class representatives meet where a
band of six registers agrees (42 bands; a pair at 0.8 is missed with a chance
of 3e-6).  A handful of shingles fills no registers, so sets of up to nine meet
exactly instead: two of them at 0.8 are equal after leaving out one shingle at
most each, or two of a partner's ten or eleven.  Within a band bucket, members are first compared with a hub, the
member that shares most with the others, and the links contract into
components.  Members of buckets that this leaves in several components meet
by an exact prefix filter, whatever their bucket: with shingles in the order
of how few open members have them, two linked sets share one of their first
fifth.  Only pairs of different components are formed, so the copies of one
text, however many, pair with nothing but their hub.  Each pair passes a
register estimate, less the agreement that chance gives for sets of their
sizes, before its full sets decide.

Defined cases: null text is empty; a null id is a document of its own and its
own component; repeated rows have equal sets; an empty table gives an empty
result.  Shingles are told apart by 64-bit keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwise.llm.common import byte_values, mixed, portions, stored, table
from planwise.llm.components import components
from planwise.llm.tokens import Tokens, chunks, inverse, powers, spans

REGISTERS, MANTISSA = 256, 10
BAND, BANDS = 6, 42
SHORT_BASE = 0xE7037ED1A0B428DB
SMALL, PARTNER = 9, 11  # at 0.8 a set of up to nine shingles has partners of up to eleven
# Fixed value: expected collisions a register of two equally large sets, times 2**mantissa bits (HyperMinHash, Yu and Weber).
COLLISIONS = 0.169919487159739
_BORROW = mixed(np.arange(REGISTERS * 4096, dtype=np.uint64)) % np.uint64(REGISTERS)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle keys of each text."""
    out = []
    for part in chunks(texts):
        tokens = Tokens(part, lower=True)
        words = tokens.keys()
        full = spans(words, width)
        n = len(words)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers(inverse(SHORT_BASE), n), out=sums[1:], dtype=np.uint64)
        base = powers(SHORT_BASE, n)
        for f, c in zip(tokens.first.tolist(), tokens.count.tolist()):
            if c >= width:
                keys = np.sort(full[f:f + c - width + 1])
                keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
            elif c:
                keys = mixed((sums[f + c:f + c + 1] - sums[f:f + 1]) * base[f:f + 1] ^ np.uint64(c))
            else:
                keys = np.zeros(0, np.uint64)
            out.append(keys)
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, one row of 256 for each set; rows of empty sets are zero."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    if not sets:
        return out
    keys = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = (keys >> np.uint64(56)).astype(np.int64)
    cell = owner * REGISTERS + bucket
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    rest = (keys[first] << np.uint64(8)) | np.uint64(1)
    zeros = (64 - np.frexp(rest.astype(np.float64))[1]).clip(0, 63)
    tail = (rest << zeros.astype(np.uint64)) << np.uint64(1)
    full = np.zeros((len(sets), REGISTERS), bool)
    full.ravel()[cell[first]] = True
    out.ravel()[cell[first]] = (zeros.astype(np.uint16) << MANTISSA) | (tail >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    row, col = np.nonzero(~full & full.any(axis=1)[:, None])
    for turn in range(4096):
        if not len(row):
            break
        source = _BORROW[col * 4096 + turn].astype(np.int64)
        got = full[row, source]
        out[row[got], col[got]] = out[row[got], source[got]]
        row, col = row[~got], col[~got]
    for r, c in zip(row, col):  # practically never
        out[r, c] = out[r, np.flatnonzero(full[r])[0]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from registers, less the agreement that different minima of sets of these sizes show by chance."""
    agree = (a == b).mean(axis=1)
    low, high = np.minimum(n_a, n_b), np.maximum(np.maximum(n_a, n_b), 1)
    ratio = low / high
    chance = COLLISIONS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return (agree - chance) / (1 - chance)


def small_keys(keys: np.ndarray) -> np.ndarray:
    """Keys of a small set and of what is left without one shingle, or two above SMALL."""
    if not 4 <= len(keys) <= PARTNER:  # below four shingles only equal sets reach 0.8
        return np.zeros(0, np.uint64)
    each = mixed(keys)
    total = each.sum(dtype=np.uint64)
    out = [np.array([total]), total - each]
    if len(keys) > SMALL:
        i, j = np.triu_indices(len(keys), 1)
        out.append(total - each[i] - each[j])
    return np.unique(mixed(np.concatenate(out)))


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    id_type = docs.schema["_id"].dataType.simpleString()

    def sign(batches):
        for batch in portions(batches):
            rows = pa.Table.from_batches([batch])
            sets = shingle_sets(byte_values(rows["_text"]), width)
            regs = registers(sets)
            yield pa.RecordBatch.from_pydict({
                "_id": rows["_id"].combine_chunks(), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_id": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                                    for s in sets], pa.binary()),
                "registers": pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets)], pa.binary()),
                "small": pa.array([small_keys(s).tobytes() if len(s) <= PARTNER else None for s in sets], pa.binary())})
    return docs.mapInArrow(sign, f"_id {id_type}, n_shingles bigint, set_id binary, registers binary, small binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(key, id) for each band of a representative of ten shingles or more, and each key of a small set."""
    id_type = reps.schema["id"].dataType.simpleString()

    def cut(batches):
        for batch in portions(batches):
            n = batch.num_rows
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, REGISTERS)
            part = regs[:, :BAND * BANDS].reshape(n, BANDS, BAND).astype(np.uint64)
            keys = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), (n, BANDS)).copy()
            for j in range(BAND):
                keys = mixed((keys ^ part[:, :, j]) * np.uint64(0x9E3779B97F4A7C15))
            wide = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False) > SMALL)
            small = [np.frombuffer(x or b"", np.uint64) for x in batch.column(3).to_pylist()]
            flat = np.concatenate([keys[wide].ravel(), *small])
            owner = np.concatenate([np.repeat(wide, BANDS), np.repeat(np.arange(n), [len(x) for x in small])])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), batch.column(0).take(pa.array(owner))],
                                             ["key", "id"])
    return reps.select("id", "registers", "n_shingles", "small").mapInArrow(cut, f"key bigint, id {id_type}")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    id_type = docs.schema["_id"].dataType.simpleString()

    def build(batches):
        for batch in portions(batches):
            rows = pa.Table.from_batches([batch])
            sets = shingle_sets(byte_values(rows["_text"]), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             ["id", "keys"])
    return (docs.join(ids.withColumnRenamed("id", "_id"), "_id", "left_semi").select("_id", "_text")
            .mapInArrow(build, f"id {id_type}, keys binary"))


def _verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of the pairs whose estimate lets their full sets decide."""
    side = lambda name: reps.select(F.col("id").alias(name), F.col("registers").alias(f"r_{name}"),
                                    F.col("n_shingles").alias(f"n_{name}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    # sizes alone bound the similarity
    near = near.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    pair_type = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("a", "b"))

    def likely(batches):
        for b in portions(batches):
            n = b.num_rows
            cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            regs = [np.frombuffer(b"".join(cols[c].to_pylist()), np.uint16).reshape(n, REGISTERS) for c in ("r_a", "r_b")]
            n_a, n_b = (cols[c].to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            sd = np.sqrt(0.16 / np.minimum(REGISTERS, np.maximum(n_a, n_b)))
            keep = pa.array(estimate(*regs, n_a, n_b) >= percent / 100 - 8 * sd)
            yield pa.RecordBatch.from_arrays([cols["a"].filter(keep), cols["b"].filter(keep)], ["a", "b"])

    def decide(batches):
        for b in portions(batches):
            cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            linked = []
            for x, y in zip(cols["k_a"].to_pylist(), cols["k_b"].to_pylist()):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([cols["a"], cols["b"], pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    near = near.mapInArrow(likely, pair_type)
    full = (near.join(sets.select(F.col("id").alias("a"), F.col("keys").alias("k_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("keys").alias("k_b")), "b"))
    return full.mapInArrow(decide, f"{pair_type}, linked boolean")


def _prefix_pairs(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(id, other): pairs of members (id, component) in different components that may be linked.

    Shingles are ordered by how few members have them.  A linked pair shares at least ``percent`` of either set, so
    the first |x| - ceil(percent |x|) + 1 shingles of both sets have one in common; behind the first one they share,
    what is left of the smaller rest bounds the overlap.  Shingles of one member pair nothing and go before the join.
    """
    id_type = members.schema["id"].dataType.simpleString()

    def spread(batches):
        for b in portions(batches):
            for i, data in enumerate(b.column(1).to_pylist()):
                keys = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(keys), i))), pa.array(keys)],
                                                 ["id", "shingle"])
    chosen = sets.join(members.select("id"), "id", "left_semi").select("id", "keys")
    rows = stored(chosen.mapInArrow(spread, f"id {id_type}, shingle bigint"), "open-shingles")
    seldom = rows.groupBy("shingle").agg(F.count("*").alias("n"))
    by_set = Window.partitionBy("id")
    ranked = (rows.join(seldom, "shingle").withColumn("rank", F.row_number().over(by_set.orderBy("n", "shingle")))
              .withColumn("size", F.count("*").over(by_set)))
    prefix = (ranked.where((F.col("rank") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1) & (F.col("n") > 1))
              .select("id", "shingle", "size", (F.col("size") - F.col("rank")).alias("rest")))
    prefix = stored(prefix.join(members, "id"), "open-prefixes")
    other = prefix.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("id", "component", "size", "rest")])
    enough = (100 + percent) * (1 + F.least("rest", "other_rest")) >= percent * (F.col("size") + F.col("other_size"))
    return (prefix.join(other, "shingle").where((F.col("component") < F.col("other_component")) & enough)
            .select("id", F.col("other_id").alias("other")))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """(doc id, n_shingles, component_id, kept): documents whose sets share at least ``percent`` of
    their union are linked; a component is named by its smallest id, which alone is kept."""
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100: the bands and the keys of small sets are made for these")
    picked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    signed = stored(_signatures(picked, width), "signatures")
    reps = stored(signed.where("set_id IS NOT NULL AND _id IS NOT NULL").groupBy("set_id")
                  .agg(F.min(F.struct("_id", "registers", "n_shingles", "small")).alias("least"))
                  .select("set_id", F.col("least._id").alias("id"), "least.registers", "least.n_shingles", "least.small"),
                  "classes")
    sizes = _bands(reps).groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(_bands(reps).join(sizes, "key"), "band-members")
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    members = stored(members.drop("size").join(weight, "id"), "band-weights")
    sets = stored(_sets(picked, members.select("id").distinct(), width), "candidate-sets")

    # first every member with its bucket's hub, the member with the widest reach
    hub = F.max(F.struct("weight", F.xxhash64("id"), "id")).alias("hub")
    hubs = stored(members.groupBy("key").agg(hub).select("key", F.col("hub.id").alias("other")), "hubs")
    ends = [F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")]
    starred = members.join(hubs, "key").select("key", "id", "other")
    tested = stored(_verified(stored(_pairs(starred.where("id <> other")), "pairs"), reps, sets, percent), "near-tested")
    links = tested.where("linked").select("a", "b")
    parts = stored(components(links), "near-components")

    # then the buckets that this leaves in several components; of two members the hub was one
    labelled = starred.join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    torn = (labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                        F.count("*").alias("n")).where("lo <> hi AND n > 2").select("key"))
    open_ = stored(labelled.join(torn, "key").select("id", "component").distinct(), "open-members")
    if not open_.isEmpty():
        found = stored(_pairs(_prefix_pairs(sets, open_, percent)), "pairs")
        more = _verified(found, reps, sets, percent).where("linked").select("a", "b")
        parts = stored(components(stored(links.unionByName(more), "near-links")), "near-components")
    classes = reps.join(parts, "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id"))
    out = (signed.select("_id", "n_shingles", "set_id").join(classes, "set_id", "left")
           .select(F.col("_id").alias(doc_id), "n_shingles",
                   F.when(F.col("_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "_id"))
                   .alias("component_id")))
    return out.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)

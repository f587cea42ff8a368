"""Operator 9: exact top-k inner products from an impact-ordered index.

Vectors are dealt to index blocks.  A block's postings (dimension, row,
impact) lie in segments by descending quantised impact: segment s holds the
postings with 2**(s-1) <= |impact| < 2**s.  A search adds the segments to the
scores of a whole block of queries, largest impacts first.  After a segment,
what is still unread can change a score by at most the query's absolute sum
times the largest unread impact; rows that cannot reach the k-th best lower
bound by then are out.  The search of a block stops only when that leaves no
more rows than ``k`` needs, or when all segments are read; the possible
members are then scored again exactly from the whole vectors.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part; shorter vectors count as padded with zeros; a vector without
components scores 0; ties go to the smaller id; rows that repeat an id are
candidates of other ids one by one, never of their own; a null id takes no
part; an empty table gives an empty result.  Scores are exact 64-bit
integers; components whose products could leave 63 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwise.llm.common import squeeze, stored, table, unsqueeze

K, SCALE = 20, 64
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
EXACT = float(1 << 53)


# ------------------------------------------------------------------ index of one block
def segments(matrix: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Postings by descending quantised impact: (level, rows, dimensions, impacts), by dimension inside a level."""
    rows, dims = np.nonzero(matrix)
    impact = matrix[rows, dims]
    level = np.frexp(np.abs(impact))[1]
    order = np.lexsort((rows, dims, -level))
    rows, dims, impact, level = rows[order], dims[order], impact[order], level[order]
    cut = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]])) if len(level) else np.zeros(0, np.int64)
    return [(int(level[a]), rows[a:b].astype(np.int32), dims[a:b].astype(np.int32), impact[a:b])
            for a, b in zip(cut, np.append(cut[1:], len(level)))]


def _place(segment, shape) -> np.ndarray:
    _, rows, dims, impact = segment
    plane = np.zeros(shape)
    plane[rows, dims] = impact
    return plane


def search_block(ids: np.ndarray, index: list, shape: tuple[int, int], query_ids: np.ndarray, queries: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query position, row, score) of a block for each query, ties to the smaller id."""
    n, m = len(query_ids), shape[0]
    largest = max((2.0 ** s[0] for s in index), default=0.0)
    if n and m and np.abs(queries).sum(axis=1).max() * largest >= float(1 << 62):
        raise ValueError("scores would not fit into 64 bits")
    acc = np.zeros((n, m))
    own = query_ids[:, None] == ids[None, :]
    acc[own] = -np.inf
    possible = min(k, m)
    reach = np.abs(queries).sum(axis=1)
    alive = None
    exact = bool(n) and reach.max() * largest < EXACT
    for at, segment in enumerate(index):
        acc += queries @ _place(segment, shape).T
        left = index[at + 1][0] if at + 1 < len(index) else None
        if left is None or not exact:
            continue
        slack = reach * (2.0 ** left - 1)  # impacts of the next segment lie below 2**left
        best = np.partition(acc, m - possible, axis=1)[:, m - possible] if possible else np.zeros(n)
        alive = acc + slack[:, None] >= (best - slack)[:, None]
        if alive.sum() <= 2 * possible * n:
            break  # proof: no other row can be among the k best
    else:
        alive = None
    if alive is None and possible:
        best = np.partition(acc, m - possible, axis=1)[:, m - possible]
        alive = acc >= best[:, None] - (0 if exact else np.abs(best)[:, None] * 1e-9 + 1)
    if not possible or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, row = np.nonzero(alive & ~own)
    whole = np.zeros(shape, np.int64)
    for _, rows, dims, impact in index:
        whole[rows, dims] = impact.astype(np.int64)
    score = np.concatenate([np.einsum("ij,ij->i", queries[q[a:a + 65536]].astype(np.int64), whole[row[a:a + 65536]])
                            for a in range(0, len(q), 65536)]) if len(q) else np.zeros(0, np.int64)
    order = np.lexsort((ids[row], -score, q))
    q, row, score = q[order], row[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    top = place < k
    return q[top], row[top], score[top]


# ------------------------------------------------------------------ on Spark
def _packed(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Vectors in blocks of about ``rows``: (name, n, width, ids, values)."""
    total = vectors.count()
    n = max(1, -(-total // rows))

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        lists = t["vec"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        matrix = np.zeros((t.num_rows, int(sizes.max(initial=0))))
        if matrix.size:
            matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return pa.table({name: pa.array([key[0].as_py()], pa.int32()), "n": pa.array([t.num_rows], pa.int64()),
                         "width": pa.array([matrix.shape[1]], pa.int64()),
                         "ids": pa.array([squeeze(t["id"].to_numpy())], pa.binary()),
                         "vals": pa.array([squeeze(matrix)], pa.binary())})
    # neighbouring ids spread over all blocks
    deal = F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")
    return (vectors.withColumn("_deal", deal).groupBy("_deal")
            .applyInArrow(pack, f"{name} int, n bigint, width bigint, ids binary, vals binary"))


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, n, width, ids, level, rows, dims, impacts): one row per segment; level null for a block without postings."""
    def order(batches):
        for b in batches:
            for block, n, width, ids, vals in zip(*(b.column(i).to_pylist() for i in range(5))):
                parts = segments(unsqueeze(vals, np.float64).reshape(n, width)) or [(None, *[np.zeros(0)] * 3)]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block] * len(parts), pa.int32()), "n": pa.array([n] * len(parts), pa.int64()),
                    "width": pa.array([width] * len(parts), pa.int64()),
                    "ids": pa.array([ids if i == 0 else None for i in range(len(parts))], pa.binary()),
                    "level": pa.array([p[0] for p in parts], pa.int32()),
                    "rows": pa.array([squeeze(p[1].astype(np.int32)) for p in parts], pa.binary()),
                    "dims": pa.array([squeeze(p[2].astype(np.int32)) for p in parts], pa.binary()),
                    "impacts": pa.array([squeeze(p[3].astype(np.float64)) for p in parts], pa.binary())})
    return _packed(vectors, block_rows, "block").mapInArrow(
        order, "block int, n bigint, width bigint, ids binary, level int, rows binary, dims binary, impacts binary")


def search(queries: DataFrame, index: DataFrame, k: int = K, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (id, vec) against the index, block by block."""
    asked = stored(_packed(queries, query_rows, "qblock"), "query-blocks")
    n_blocks = asked.agg(F.max("qblock")).first()[0]
    n_blocks = 0 if n_blocks is None else n_blocks + 1
    if not n_blocks:
        return queries.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"),
                              F.lit(0).cast("bigint").alias("score")).limit(0)
    # a block of the index meets each block of the stated queries in a task of its own
    last = index.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    met = index.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))

    def run(have: pa.Table, ask: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        if not have.num_rows or not ask.num_rows:
            return empty
        h = have.to_pylist()
        ids = unsqueeze(next(r["ids"] for r in h if r["ids"] is not None), np.int64)
        index_ = sorted(((r["level"], unsqueeze(r["rows"], np.int32), unsqueeze(r["dims"], np.int32),
                          unsqueeze(r["impacts"], np.float64)) for r in h if r["level"] is not None), key=lambda s: -s[0])
        a = ask.to_pylist()[0]
        q_ids = unsqueeze(a["ids"], np.int64)
        q = unsqueeze(a["vals"], np.float64).reshape(a["n"], a["width"])
        width = max(h[0]["width"], a["width"])
        q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
        at, row, score = search_block(ids, index_, (len(ids), width), q_ids, q, k)
        return pa.table({"query_id": pa.array(q_ids[at], pa.int64()), "vec_id": pa.array(ids[row], pa.int64()),
                         "score": pa.array(score, pa.int64())})

    found = (met.groupBy("qblock", "block").cogroup(asked.groupBy("qblock", "block"))
             .applyInArrow(run, "query_id bigint, vec_id bigint, score bigint"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    scale: int = SCALE) -> DataFrame:
    """(id, vec): floor(scale * x) of every component, without the rows that take no part."""
    as_double = F.transform(embedding, lambda x: x.cast("double"))
    sound = F.coalesce(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return (vectors.select(F.col(vec_id).cast("bigint").alias("id"), as_double.alias("_v"))
            .where(F.col("id").isNotNull() & F.col("_v").isNotNull() & sound)
            .select("id", F.transform("_v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("vec")))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    index = stored(build_index(vectors), "impact-index")
    return search(vectors.where("id % 20 = 0"), index)


ORACLE_OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id,
                  CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
                  vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

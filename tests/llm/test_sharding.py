import zlib
from collections import defaultdict

import numpy as np

from planwise.llm.sharding import assign, op10_sharding, place
from tests.llm.conftest import SF


def _laws(rows, texts, shards):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
    for got in by_shard.values():
        assert sorted(r.slot for r in got) == list(range(len(got)))
    assert all(0 <= s < shards for s in by_shard)
    return [sum(r.size for r in by_shard[s]) for s in range(shards)]


def test_op10_on_the_table(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = op10_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        assert r.size == len(b) + 8 and r.text_crc32 == zlib.crc32(b) and r.law == "bytes" and r.grown_shard is None
    sizes = _laws(rows, texts, 24)
    assert max(sizes) / min(sizes) < 1.02
    together = defaultdict(set)
    for r in rows:
        together[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in together.values()) <= 24


def test_hot_group_is_cut(spark):
    rows = [(i, "the same text " * 5 if i % 3 == 0 else f"text {i} " * (i % 17 + 1), i) for i in range(6000)]
    got = assign(spark.createDataFrame(rows, "doc_id bigint, text string, shard bigint"), shards=8).collect()
    sizes = _laws(got, None, 8)
    assert len(got) == 6000 and max(sizes) / min(sizes) < 1.02
    tokens = [sum(r.tokens for r in got if r.shard == s) for s in range(8)]
    assert max(tokens) / min(tokens) < 1.2


def test_edge_cases(spark):
    schema = "doc_id bigint, text string"
    rows = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (4, "é " * 50_000)]
    got = assign(spark.createDataFrame(rows, schema), shards=4).collect()
    assert sorted(r.size for r in got) == [8, 8, 11, 11, 11, 11, 150_008]
    assert {r.tokens for r in got} == {0, 2, 50_000}
    _laws(got, None, 4)
    assert assign(spark.createDataFrame([], schema)).count() == 0


def test_place_takes_the_largest_dot_product():
    residual = np.array([[10.0, 1.0, 1.0], [9.0, 10.0, 1.0]])
    demand = np.array([[2.0, 0.1, 0.0], [0.1, 5.0, 0.0]])
    assert place(demand, residual, np.array([10.0, 10.0, 10.0])).tolist() == [0, 1]
    assert np.allclose(residual, [[8.0, 0.9, 1.0], [8.9, 5.0, 1.0]])

import math

import numpy as np

from planwise.llm.topk import build_index, integer_vectors, op9_exact_topk, search, search_block, segments
from tests.llm.conftest import SF


def _brute(rows, is_query, k=20):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints.setdefault(i, []).append([math.floor(64 * x) for x in v])
    out = []
    for q, vs in ints.items():
        if is_query(q):
            for a in vs:
                scored = [(-sum(x * y for x, y in zip(a, b)), i) for i, bs in ints.items() if i != q for b in bs]
                out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_op9_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in op9_exact_topk(spark, SF).collect())
    assert got == _brute(rows, lambda i: i % 20 == 0)


def test_segments_descend_and_stop_is_exact():
    rng = np.random.default_rng(1)
    for width, n in ((4, 300), (64, 500), (1, 50)):
        m = np.floor(rng.normal(0, 20, (n, width)) * rng.choice([1, 30], (n, 1)))
        index = segments(m)
        assert [s[0] for s in index] == sorted((s[0] for s in index), reverse=True)
        q = np.floor(rng.normal(0, 20, (40, width)))
        at, row, score = search_block(np.arange(n), index, m.shape, np.arange(1000, 1040), q, 10)
        exact = (q @ m.T).astype(int)
        for i in range(40):
            want = sorted((-exact[i, j], j) for j in range(n))[:10]
            assert [(-int(s), int(r)) for s, r in zip(score[at == i], row[at == i])] == want


def test_edge_cases(spark):
    schema = "vec_id bigint, embedding array<float>, score int"
    rows = [(0, [1.0, 0.5], 1), (20, [0.25], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, None, 1), (4, [None, 1.0], 1),
            (5, [float("nan")], 1), (6, [float("inf"), 0.0], 1), (7, [], 1), (8, [-0.01, -3.0], 1), (None, [9.0], 1),
            (2, [1.0, 0.5], 1)]
    vectors = integer_vectors(spark.createDataFrame(rows, schema))
    got = search(vectors.where("id % 20 = 0"), build_index(vectors, 3), k=4, query_rows=1).collect()
    assert sorted(tuple(r) for r in got) == _brute([r[:2] for r in rows], lambda i: i % 20 == 0, 4)
    none = vectors.limit(0)
    assert search(none, build_index(none)).count() == 0
    assert search(vectors.where("id = 0"), build_index(none)).count() == 0

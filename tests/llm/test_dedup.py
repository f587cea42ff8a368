import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from planwise.llm.common import portions
from planwise.llm.near_dedup import _signatures, near_duplicates, op5_near_dedup
from planwise.llm.substrings import _by_shard, op8_substring_dedup, remove_repeats
from tests.llm import helpers
from tests.llm.conftest import SF

SCHEMA = "doc_id bigint, text string"


def _rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_op8_equals_brute_force(spark, documents):
    got = sorted(tuple(r) for r in op8_substring_dedup(spark, SF).collect())
    assert got == sorted(helpers.without_repeats(_rows(documents), 35))


def test_op5_equals_brute_force(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_near_dedup(spark, SF).collect()}
    assert got == helpers.near(_rows(documents), 2)


def test_edge_cases_of_repeats(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, "a b c d e"), (2, "x b c d y"), (3, None), (4, ""), (5, long), (6, "q q q q q"), (None, "a b c d e"),
            (1, "a b c d e"), (7, "only two")]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit(1)), width=3)
    out = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept) for r in got.collect())
    want = sorted((i if i is not None else -1, n, m) for i, n, m, _ in helpers.without_repeats(rows, 3))
    assert [x[:3] for x in out] == want
    by_id = {x[0]: x[3] for x in out}
    assert by_id[2] == "x y" and by_id[6] == "" and by_id[5] == long
    assert {tuple(s) for r in got.where("doc_id = 2").collect() for s in r.removed} == {(1, 3)}
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_edge_cases_of_near_duplicates(spark):
    rows = [(5, "One two three"), (3, "one TWO three"), (9, None), (8, ""), (7, "   "), (None, "one two three"),
            (4, "solo"), (2, "solo"), (6, "other words here"), (6, "other words here")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumn("registers", F.lit(0)), width=2).collect()
    seen = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got}
    assert seen == {(5, 2, 3, False), (3, 2, 3, True), (9, 0, 9, True), (8, 0, 8, True), (7, 0, 7, True),
                    (None, 2, None, True), (4, 1, 2, False), (2, 1, 2, True), (6, 2, 6, True)}
    assert len(got) == len(rows)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_family_linked_only_through_its_source(spark):
    rng = random.Random(5)
    source = [f"s{i}" for i in range(60)]
    rows = [(1000, " ".join(source))]
    for i in range(150):
        copy = list(source)
        for j in rng.sample(range(60), 3):
            copy[j] = f"c{i}_{j}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2).collect()}
    assert got == {i: c for i, (_, c) in helpers.near(rows, 2).items()}


def test_small_sets_meet_exactly(spark):
    rng = random.Random(8)
    rows = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(rng.randint(4, 13))]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy.insert(rng.choice([0, len(copy)]), rng.choice(["x", "y", f"n{rng.random()}"]))
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + i, "of the " + " ".join(rng.choices("abcdefghij", k=3))) for i in range(200)]
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2).collect()}
    assert got == helpers.near(rows, 2)


def test_drifting_family_without_a_centre(spark):
    rng = random.Random(9)
    text, rows = [f"w{i}" for i in range(80)], []
    for i in range(120):
        rows.append((i, " ".join(text)))
        text[rng.randrange(80)] = f"v{i}"
        text[rng.randrange(80)] = f"u{i}"
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), width=2).collect()}
    assert got == {i: c for i, (_, c) in helpers.near(rows, 2).items()}


class _Task:
    """Stands for a table: what is mapped over it is handed back, to run here."""
    schema = StructType().add("_id", "long").add("_text", "string")

    def mapInArrow(self, fn, _):
        return fn


def test_signatures_take_memory_by_the_portion_not_by_the_batch():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(6000)]
    batch = pa.RecordBatch.from_pydict({"_id": pa.array(range(len(texts)), pa.int64()), "_text": pa.array(texts)})
    sign = _signatures(_Task(), 2)
    list(sign(iter([batch.slice(0, 50)])))
    tracemalloc.start()
    ids = [i for out in sign(iter([batch])) for i in out.column(0).to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(len(texts))) and most < 80e6  # of 14 MB of text; 55 MB, and 150 MB in one piece


def test_portions_keep_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["x" * n for n in (10, 0, 5000, 3, 900, 900)] + [None])})
    got = [p.column(0).to_pylist() for p in portions(iter([batch, batch.slice(2, 1), batch.slice(0, 0)]), 1000)]
    assert [x for p in got for x in p] == [*batch.column(0).to_pylist(), "x" * 5000]
    assert all(len(p) == 1 or sum(64 + len(x or "") for x in p) <= 1000 for p in got)


def test_windows_by_shard_are_not_held_twice():
    import numpy as np
    rng = np.random.default_rng(5)
    parts = [(rng.integers(0, 500, 1000, dtype=np.uint64), rng.integers(0, 3, 1000).astype(np.uint32)) for _ in range(4)]
    keys, shard = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    got = _by_shard(parts)
    assert not parts and sorted(got) == [0, 1, 2]
    for s, (k, n) in got.items():
        want = np.unique(keys[shard == s], return_counts=True)
        assert k.tolist() == want[0].tolist() and n.tolist() == want[1].tolist()

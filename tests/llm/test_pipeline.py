import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from planwise.llm.common import stored, table, written_paths
from planwise.llm.packing import END_ID, public_tokenizer
from tests.llm import helpers
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each one."""
    docs, out = table(spark, SF, "documents"), []
    out.append(("documents", docs, docs.collect()))
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        out.append((name, docs, docs.collect()))
    return out


def _rows(stage):
    return sorted((r.doc_id, r.text) for r in stage[2])


def test_stages_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near dedup", "substring dedup", "decontamination",
                                                      "packing"]
    assert "pipeline" in __spark_entry__.queries() and corpus_pipeline.ORACLE_SQL is None
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in __spark_entry__.queries() if k.startswith("op")}


def test_all_but_the_last_return_documents(stages):
    for _, df, _ in stages[1:5]:
        assert df.schema.simpleString() == stages[0][1].schema.simpleString()


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in stages[1][2]}
    good, bad = ([i for i, q in labels.items() if q == want] for want in (1, 0))
    assert np.mean([i in kept for i in good]) > 0.97 and np.mean([i in kept for i in bad]) < 0.35
    assert {(r.doc_id, r.text) for r in stages[1][2]} <= {(r.doc_id, r.text) for r in stages[0][2]}


def test_near_dedup_equals_brute_force(stages):
    want = {i for i, (_, c) in helpers.near(_rows(stages[1]), 5).items() if i == c}
    assert {r.doc_id for r in stages[2][2]} == want


def test_substring_dedup_equals_brute_force(stages):
    want = {i: (n, sha) for i, _, n, sha in helpers.without_repeats(_rows(stages[2]), 35)}
    before = dict(_rows(stages[2]))
    assert len(stages[3][2]) == len(want)
    for r in stages[3][2]:
        n, sha = want[r.doc_id]
        if n:
            assert hashlib.sha256(r.text.encode()).hexdigest() == sha and r.n_chars == len(r.text)
        else:
            assert r.text == before[r.doc_id]


def test_decontamination_takes_leaks_only(spark, stages):
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    before, after = dict(_rows(stages[3])), {r.doc_id for r in stages[4][2]}
    leaked = {i for i, t in before.items() if any(x in t for x in items)}
    assert not leaked & after and len(before) - len(after) <= max(2 * len(leaked), 3)


def test_packing_covers_what_is_left(stages):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizer())
    pieces = {}
    for r in stages[5][2]:
        pieces.setdefault(r.doc_id, []).append((r.start, list(r.ids)))
    assert set(pieces) == {r.doc_id for r in stages[4][2]}
    for r in stages[4][2]:
        ids = [x for _, part in sorted(pieces[r.doc_id]) for x in part]
        assert ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids + [END_ID]


def test_pipeline_edge_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c", None, None, 5), (2, "a b c", None, None, 5),
            (3, "long " * 40_000, "en", "s", 200_000),
            *[(None, x.text, "en", "s", 1) for x in table(spark, SF, "benchmark").limit(1).collect()]]
    docs = spark.createDataFrame([(*r, 1, "r", "k", "l", 7) for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                 "kept int, _row string, _key string, _LEAK string, __key int")
    assert corpus_pipeline.quality_classifier(spark, docs, SF).columns == docs.columns
    for name, stage in corpus_pipeline.STAGES[1:]:
        if name != "near dedup":
            assert {tuple(r) for r in docs.select("_row", "_key", "_LEAK", "__key").collect()} == {("r", "k", "l", 7)}
        before, docs = docs, stored(stage(spark, docs, SF), "edge")
        if name == "decontamination":  # only the row without an id that holds a test item goes
            assert before.count() - docs.count() == 1 and docs.where("doc_id IS NULL").count() == 1
    assert {r.doc_id for r in docs.collect()} == {None, 1, 2, 3}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, before.limit(0), SF).count() == 0


def test_one_row_of_each_group_of_copies_stays(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("a")), (None, text("b")), (2, text("b")), (None, text("c")), (None, text("c")),
            (3, text("d")), (3, text("e"))]
    docs = stored(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("bigint")), "rows")
    once = corpus_pipeline.near_dedup(spark, docs, SF)
    assert once.columns == docs.columns
    out = corpus_pipeline.substring_dedup(spark, stored(once, "once"), SF).collect()
    want = [(1, text("a")), (2, text("b")), (None, text("c")), (3, text("d")), (3, text("e"))]
    assert sorted([(r.doc_id, r.text) for r in out], key=str) == sorted(want, key=str)


def test_run_leaves_its_result_only(spark):
    with written_paths() as paths:
        out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (at := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(hadoop).exists(at)]
    assert there == paths[-1:]

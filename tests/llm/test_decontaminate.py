import math
import random
import re
from collections import Counter

import numpy as np

from planwise.llm.decontaminate import Index, contaminated, op3_decontamination
from tests.llm import helpers
from tests.llm.conftest import SF


def _words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", helpers.lower(text))


def _overlap(part, passage):
    """Share of the five-word shingles of a part that the passage holds."""
    n = min(5, len(part))
    mine = {tuple(part[k:k + n]) for k in range(len(part) - n + 1)} if part else set()
    return len(mine & {tuple(passage[k:k + n]) for k in range(len(passage) - n + 1)}) / len(mine) if mine else 0.0


def _brute(rows, items):
    """Every passage against every item by plain BM25 and plain shingles; knows nothing of the index."""
    texts = {t: _words(t) for _, t in items if _words(t or "")}
    n, mean, stride = len(texts), sum(map(len, texts.values())) / max(1, len(texts)), max([64, *map(len, texts.values())])
    df = Counter(w for ws in texts.values() for w in set(ws))
    impact = {}
    for t, ws in texts.items():
        norm = 1.2 * (0.25 + 0.75 * len(ws) / mean)
        one = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + norm) for w, f in Counter(ws).items()}
        impact[t] = {w: x / sum(one.values()) for w, x in one.items()}
    out = set()
    for doc, text in rows:
        words = _words(text or "")
        for a in range(0, max(1, len(words)), stride):
            passage = words[a:a + 2 * stride]
            held = set(passage)
            for t, ws in texts.items():
                if sum(x for w, x in impact[t].items() if w in held) >= 0.6 * (1 - 1e-9):
                    cut = [x for x in re.split(r"(?<=[.!?])\s+", t.strip()) if x]
                    q, r = (" ".join(cut[:-1]), cut[-1]) if len(cut) > 1 else ("".join(cut), "".join(cut))
                    if _overlap(ws, passage) >= 0.8 or (_overlap(_words(q), passage) >= 0.5 and _overlap(_words(r), passage) >= 0.5):
                        out |= {(doc, i) for i, x in items if x == t}
    return out


def test_op3_equals_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op3_decontamination(spark, SF).collect()}
    assert got == _brute(rows, items)
    planted = {(d, i) for d, t in rows for i, x in items if x in (t or "")}
    assert planted and planted <= got


def test_wand_equals_full_scores():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 12)))) for i in range(300)]
    index = Index(items, threshold=0.5)
    for _ in range(100):
        terms = rng.sample(range(len(index.vocabulary)), rng.randint(1, 20))
        full = np.zeros(len(items))
        for t in terms:
            for i, x in index.postings[t]:
                full[i] += x
        want = {int(i) for i in np.flatnonzero(full >= 0.5 * (1 - 1e-9))}
        assert {i for i, _ in index.search(terms)} == want


def test_edge_cases(spark):
    item = "What lies under the old stone bridge by the river? A chest of silver coins and one letter."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, item), (5, "Yes.")], "item_id bigint, text string")
    rows = [(1, "filler " * 500 + item.upper() + " more" * 300), (2, None), (3, ""), (None, item), (None, item),
            (4, "What lies under the old stone bridge by the river? Nobody knows the answer to it."), (5, "a clean text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.item_id) for r in contaminated(docs.withColumnRenamed("text", "score"), items, text="score")
                  .collect()), key=str)
    assert got == sorted([(1, 1), (1, 4), (None, 1), (None, 4)], key=str)
    two = {(r.doc_id, r.item_id) for r in contaminated(docs, items, shard_items=2).collect()}
    assert two == set(got)
    assert contaminated(docs.limit(0), items).count() == 0 and contaminated(docs, items.limit(0)).count() == 0


def test_hits_do_not_depend_on_the_shards(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = items.unionByName(items.selectExpr("item_id + 1000 AS item_id", "text").limit(15))  # some texts twice
    docs = documents.where("doc_id % 4 = 0")
    whole, *others = ([tuple(r) for r in contaminated(docs, items, shard_items=n).orderBy("doc_id", "item_id").collect()] for n in (1000, 10, 2))
    assert whole and all(o == whole for o in others)

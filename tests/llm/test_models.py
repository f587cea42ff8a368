import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwise.llm import lm_score, quality, toxicity
from planwise.llm.toxicity import Lexicon, matches
from tests.llm import helpers
from tests.llm.conftest import SF

SCHEMA = "doc_id bigint, text string"


def _trie(texts, order):
    grams = Counter()
    for t in texts:
        data = b"\xff" * order + b" ".join((t or "").encode().lower().split()) + b"\xff"
        grams.update(data[i - order:i + 1] for i in range(order, len(data)))
    trie = {}
    while True:
        for g, n in grams.items():
            trie.setdefault(g[:-1], Counter())[g[-1]] = n
        if len(next(iter(grams), b"x")) == 1:
            return trie
        grams = Counter(g[1:] for g in grams)


def _base(rows, trained):
    counts = Counter(w for i, t in rows if trained(i) for w in [*helpers.words(helpers.lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        tokens = [*helpers.words(helpers.lower(t)), None]
        out.setdefault(i, []).append((len(tokens), sum(counts[w] > 0 for w in tokens), n,
                                      sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in tokens)))
    return out


def _compare(rows, got, trained, order):
    trie, base = _trie([t for i, t in rows if trained(i)], order), _base(rows, trained)
    text = dict(rows)
    for r in got:
        n, known, total, score = base[r.doc_id][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.held_out == (not trained(r.doc_id))
        assert r.base_score == pytest.approx(score, rel=1e-9)
        assert r.score == pytest.approx(lm_score.coded(trie, text[r.doc_id], order, learn=False), rel=1e-5)


def _trained(i):
    return crc32(str(i).encode()) % 7 != 2


def test_op1_equals_a_trie_in_memory(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.where(F.length("text") < 600).collect()]
    docs = spark.createDataFrame(rows, SCHEMA)
    _compare(rows, lm_score.score(docs, ~lm_score.held_out(F.col("doc_id"))).collect(), _trained, lm_score.ORDER)


def test_op1_beats_single_words_on_held_out_text(spark):
    out = lm_score.op1_lm_score(spark, SF.replace("0.01", "0.1")).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert out[1] > out[0]


def test_ppm_probabilities_sum_to_one():
    rng = random.Random(1)
    trie = _trie(["".join(rng.choices("abc ", k=300))], 2)

    def total(context):
        out = 0.0
        for s in range(256):
            excluded, log, p = set(), 0.0, None
            for k in range(2, -1, -1):
                node = trie.get(context[2 - k:])
                if node is None:
                    continue
                live = {x: c for x, c in node.items() if x not in excluded}
                mass = sum(live.values())
                if s in live:
                    p = (2 * live[s] - 1) / (2 * mass)
                    break
                if live:
                    log += math.log10(len(live) / (2 * mass))
                excluded = set(node)
            out += 10 ** log * (p if p is not None else 1 / (256 - len(excluded)))
        return out
    for context in (b"ab", b"zz", b"\xff\xff", b"za"):
        assert total(context) == pytest.approx(1.0)


def test_op1_edge_cases(spark):
    rows = [(1, "Same text"), (2, None), (3, ""), (5, "   "), (7, "ünseen wörds"), (12, "same  TEXT"), (4, "x" * 20_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    _compare(rows, lm_score.score(docs, F.col("doc_id") != 7).collect(), lambda i: i != 7, lm_score.ORDER)
    untrained = lm_score.score(docs, F.lit(False)).where("doc_id = 1").first()
    assert untrained.score == pytest.approx(-10 * math.log10(256)) and untrained.train_tokens == 0
    assert lm_score.score(docs.limit(0), F.lit(True)).count() == 0
    twice = lm_score.score(spark.createDataFrame([(None, "a b"), (None, "a b")], SCHEMA), F.lit(True)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    adaptive = lm_score.adaptive_scores(docs, text="text").collect()
    assert {r.doc_id for r in adaptive} == {i for i, _ in rows}
    assert lm_score.adaptive_score("ab " * 50) > 3 * lm_score.adaptive_score("ab " * 12) * 50 / 36


# ------------------------------------------------------------------ Kneser-Ney
def _kn(texts, order):
    """Probability function of an interpolated modified Kneser-Ney model, written from the definition."""
    grams = [set() for _ in range(order + 1)]
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        data = b"\xff" * order + b" ".join((t or "").encode().split()) + b"\xff"
        for i in range(order, len(data)):
            counts[order][data[i - order:i + 1]] += 1
    for k in range(order - 1, -1, -1):
        grams[k] = set(counts[k + 1])
        for g in grams[k]:
            counts[k][g[1:]] += 1
    cut = []
    for c in counts:
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        if n[0] and n[1] and n[2]:
            y = n[0] / (n[0] + 2 * n[1])
            cut.append([min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3)])
        else:
            cut.append([0.5, 1.0, 1.5])
    contexts = [defaultdict(list) for _ in counts]
    for k, c in enumerate(counts):
        for g, v in c.items():
            contexts[k][g[:-1]].append(v)

    def p(context, symbol):
        out = 1 / 256
        for k in range(order + 1):
            h = context[order - k:]
            seen = contexts[k].get(h)
            if not seen:
                continue
            v = counts[k].get(h + bytes([symbol]), 0)
            off = 0 if not v else cut[k][min(v, 3) - 1]
            out = (v - off) / sum(seen) + sum(cut[k][min(x, 3) - 1] for x in seen) / sum(seen) * out
        return out
    return p


def test_kneser_ney_equals_its_definition(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.where(F.length("text") < 400).limit(60).collect()]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = quality.perplexities(docs, F.col("doc_id") % 2 == 0, "text", ["doc_id"], order=3).collect()
    p, text = _kn([t for i, t in rows if i % 2 == 0], 3), dict(rows)
    assert sum(p(b"the", s) for s in range(256)) == pytest.approx(1.0)
    for r in got:
        data = b"\xff" * 3 + b" ".join((text[r.doc_id] or "").encode().split()) + b"\xff"
        want = sum(math.log10(p(data[i - 3:i], data[i])) for i in range(3, len(data)))
        assert r.n_bytes == len(data) - 3 and r.log10_p == pytest.approx(want, rel=1e-5)


def test_op6_separates_junk(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.op6_quality(spark, SF).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = {r[0]: r[1] for r in rows}
    assert share[1] > 0.97 and share[0] < 0.35


def test_op6_edge_cases(spark, documents):
    good = [(i, r.text, r.lang) for i, r in enumerate(documents.where("lang = 'en'").limit(80).collect())]
    rows = [*good, (900, None, "en"), (901, "", None), (902, "%%%$$$ " * 300, "en"), (None, "the and of", "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("kept", F.lit(0))
    labels = spark.createDataFrame([*[(i, 1) for i, _, _ in good], (None, 1), (5000, 1), (902, None)], "doc_id bigint, quality int")
    got = {r.doc_id: r.kept for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows) and not got[900] and not got[901] and not got[902]
    none = quality.classify(docs, labels.limit(0)).where("n_bytes > 1").select("kept").distinct().collect()
    assert [r.kept for r in none] == [True]
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_op6_small_languages_are_judged_by_their_own_text(spark, documents):
    good = [(i, r.text, "en") for i, r in enumerate(documents.where("lang = 'en' AND n_chars > 200").orderBy("doc_id").limit(80).collect())]
    noise = lambda k: " ".join(str(hash((k, j)) % 10**9) for j in range(60))
    codes = [(1000 + k, noise(k), "xx") for k in range(40)]
    rows = [*good, *codes, (2000, noise(2000), "en"), (2001, noise(2001), "xx"), (2002, "%%%$$$ " * 300, "yy"), (2003, "%%%$$$ " * 300, "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good + codes], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert not got[2000].kept and got[2001].kept  # numbers are usual in one language and junk in the other
    assert got[2002].kept and got[2002].lowest is None and got[2002].highest is None and not got[2003].kept
    assert sum(got[i].kept for i, _, _ in codes) == len(codes)


def test_op6_limits_take_every_trusted_row_that_was_not_fitted(spark, documents):
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    clean = documents.where("lang = 'en' AND n_chars > 200").join(good, "doc_id", "left_semi")
    texts = [r.text for r in clean.orderBy("doc_id").limit(40).collect()]
    ids = [i for i in range(1000) if crc32(str(i).encode()) % 5][:len(texts)]
    rows = [*[(i, t, "en") for i, t in zip(ids, texts)], (9000, "%%%$$$ " * 300, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels, train_rows=10).collect()}
    assert got[9000].highest is not None and not got[9000].kept
    assert sum(got[i].kept for i in ids) == len(ids)


def test_op6_fits_every_trusted_row_that_is_not_set_aside(spark):
    text = F.concat_ws(" ", F.lit("word"), (F.col("doc_id") % 97).cast("string"), (F.xxhash64("doc_id") % 1009).cast("string"))
    docs = spark.range(0, 26_000, 1, 4).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    whole = quality.perplexities(docs, train, "text", ["doc_id"])
    want = {r.doc_id: 10 ** (-r.log10_p / r.n_bytes) for r in whole.collect()}
    got = {r.doc_id: r.perplexity for r in quality.classify(docs, labels).collect()}
    assert len(got) == 26_000 and got == pytest.approx(want)


# ------------------------------------------------------------------ toxicity
def test_grammar_states():
    lex = Lexicon({"idiot": 3.0, "scumm*": 2.0})
    states = lambda t: [(k, s) for k, s, _, _ in matches(t, lex)]
    assert states("you are an idiot") == [("insult", "targeted")]
    assert states("Idiot, you!") == [("insult", "targeted")]
    assert states("an idiot. you") == [("insult", "plain")]
    assert states("he is not an idiot") == [("insult", "negated")]
    assert states("not at all in this long clause an idiot") == [("insult", "plain")]
    assert states('she said: "you idiot"') == [("insult", "reported")]
    assert states("she said so. you idiot") == [("insult", "targeted")]
    assert states("kill them, scummiest SCUMM") == [("threat", "plain")] * 0 + [("threat", "targeted"), ("insult", "targeted"),
                                                                              ("insult", "targeted")]
    assert states(None) == states("") == []


def test_threats_keep_their_state():
    lex = Lexicon({"hur*": 4.0, "fool": 2.0})
    assert matches("I will hurt you", lex) == [("threat", "targeted", 4.0, 0)]
    assert matches("they said he will not hurt you", lex) == [("threat", "reported", 4.0, 0)]
    assert matches("he will not burn", lex) == [("threat", "negated", 1.0, 0)] == matches("he will never burn", lex)
    xs = [tuple(toxicity.features(matches(t, lex))) for t in
          ("I will hurt you", "they said he will not hurt you", "nothing will hurt", "it will not hurt", "a fool", "you fool")]
    assert len(set(xs)) == len(xs)


def _states_by_definition(text, lex):
    """Each match's state from the positions of the words around it, without any machine."""
    out, sentence_start, spans, tokens = [], 0, [], toxicity.TOKEN.findall((text or "").lower())
    start = 0
    for i, t in enumerate([*tokens, "."]):
        if t in toxicity.STOP:
            spans.append((start, i, sentence_start))
            start = i + 1
            sentence_start = sentence_start if t == ":" else i + 1
    kind = [None if t in toxicity.STOP else lex.read(t)[0] for t in tokens]
    for clause, (a, b, first) in enumerate(spans):
        for i in range(a, b):
            if kind[i] in ("insult", "threat"):
                state = ("reported" if "report" in kind[first:i] else
                         "negated" if "negation" in kind[max(a, i - toxicity.REACH):i] else
                         "targeted" if "target" in kind[a:b] else "plain")
                out.append((kind[i], state, lex.read(tokens[i])[1], clause))
    return out


def test_the_composed_machine_equals_the_definition():
    rng = random.Random(3)
    lex = Lexicon({"fool": 2.0, "scumm*": 1.5, "scummier": 3.0, "kill*": 2.5})
    words = "you they not never said wrote kill killing hurt fool scummy scummier a day by sea . : ; !".split()
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        assert matches(text, lex) == _states_by_definition(text, lex), text


def test_composition_equals_running_one_after_the_other():
    rng = random.Random(4)
    first, second = toxicity.negation(2), toxicity.report()
    both = toxicity.compose(first, second)
    for _ in range(300):
        symbols = [rng.choice(toxicity.PLAIN + toxicity.MATCHES) for _ in range(rng.randint(0, 12))]
        assert both.run(symbols)[0] == second.run(first.run(symbols)[0])[0]


def test_op7_on_held_out_rows(spark):
    sf = SF.replace("0.01", "0.1")
    rows = toxicity.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [(r.predicted, r.toxic) for r in rows if r.held_out]
    hit = sum(p and t for p, t in out)
    assert hit / max(1, sum(p for p, _ in out)) > 0.9 and hit / sum(t for _, t in out) > 0.75


def test_op7_edge_cases(spark):
    rows = [(i, "you are a fool and a liar" if i % 2 else "a fine day by the sea") for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, "fool"), (500, None), (501, ""), (7, "you fool")], SCHEMA).withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([*[(i, i % 2) for i in range(200)], (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.train_model(docs, labels)).collect()
    assert len(got) == 204 and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    assert score[1] > 0.5 > score[2] and score[500] == score[501] < 0.5
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert len({r.score for r in toxicity.score(docs, toxicity.train_model(docs, none)).collect()}) == 1
    assert toxicity.score(docs.limit(0), ({}, np.zeros(toxicity.N_FEATURES + 1))).count() == 0

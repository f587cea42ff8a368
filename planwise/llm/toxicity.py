"""Operator 7: toxicity by a weighted finite-state pattern grammar.

Seven small machines make the grammar.  The lexical transducer is one
character trie over the words of five classes: learned patterns (a word, or
the beginning of a word for inflected stems) are insults, fixed words are
threats, targets, negations and reported speech; its final states carry the
class and a weight, for threats the learned one where a pattern covers the
word.  The clause transducers read classes: ``target`` left to right and
``later_target`` right to left mark matches whose clause names a target,
``negation`` those within reach of one, ``report`` those after reported
speech, and ``decide`` writes the state that prevails.  The four that read
left to right are composed once into one deterministic machine, so a text is
read with one table lookup a word.  A document's score is the logistic value
of its matches' weights, number and clauses by class and state, with
coefficients (the weights of the composed machine's last arcs, so to say)
fitted on labelled rows.

``train_rows`` bounds the labelled rows for learning (the smallest hashes of
their ids among those whose crc32 fold is not 0), and with them the lexicon,
which holds every pattern that passes.  Every row is scored over its whole text.

Defined cases: null and empty texts, and texts without a match, get the value
of no match; null labels are not learned from; a null id is held out by the
fold of an empty one; without labelled rows of both kinds every score is the
smoothed rate of the label; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm.common import stored, table

TRAIN_ROWS = 20_000
LEAST_DOCS = 3
PREFIX = (4, 9)
REACH = 3  # words over which a negation carries

# Closed word classes of the four languages.
TARGET = "you your yours he she they them his her their du dich dir ihr euch er sie tu toi vous il elle ils elles tú usted ustedes él ella ellos"
THREAT = "kill hurt destroy beat burn shoot töten schlagen vernichten tuer frapper brûler matar golpear quemar"
NEGATION = "not no never neither nor isn't aren't don't nicht kein keine nie niemals ne pas jamais nunca jamás ni"
REPORT = "said says say called quoted wrote told sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió"

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.!?;:\n]")
STOP = {**dict.fromkeys(".!?;\n", "end"), ":": "colon"}  # what follows a colon may still be reported
KINDS = ("insult", "threat")
STATES = ("plain", "targeted", "negated", "reported")  # a later one prevails
N_FEATURES = 3 * len(STATES) * len(KINDS) + 1


def held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


# ---- the machines ----------------------------------------------------------------
@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: ``arcs[state][symbol]`` is (next state, written symbol)."""
    start: object
    arcs: dict

    def run(self, symbols: Iterable, state=None) -> tuple[list, object]:
        state, out = self.start if state is None else state, []
        for symbol in symbols:
            state, written = self.arcs[state][symbol]
            out.append(written)
        return out, state


def _machine(start, symbols: Iterable, step: Callable) -> Transducer:
    """The states that ``step(state, symbol)`` reaches from ``start``, written out as arcs."""
    symbols, arcs, todo = list(symbols), {}, deque([start])
    while todo:
        state = todo.popleft()
        if state in arcs:
            continue
        arcs[state] = {symbol: step(state, symbol) for symbol in symbols}
        todo.extend(to for to, _ in arcs[state].values())
    return Transducer(start, arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that writes what ``second`` writes for what ``first`` writes; reachable pairs of states only."""
    def step(pair, symbol):
        a, between = first.arcs[pair[0]][symbol]
        b, written = second.arcs[pair[1]][between]
        return (a, b), written
    return _machine((first.start, second.start), first.arcs[first.start], step)


# A symbol is a class and the marks that machines have set on it; only matches bear marks.
PLAIN = [(c,) for c in ("other", "target", "negation", "report", "end", "colon")]
MATCHES = [(k, *(m for m, bit in zip(STATES[1:], (1, 2, 4)) if bits & bit)) for k in KINDS for bits in range(8)]


def _marked(symbol: tuple, mark: str) -> tuple:
    return (symbol[0], *(s for s in STATES[1:] if s == mark or s in symbol[1:]))


def target() -> Transducer:
    """Marks matches after a target of their clause; read from the clause's end, those before one."""
    def step(seen, symbol):
        if symbol[0] in ("end", "colon"):
            return False, symbol
        if symbol[0] in KINDS:
            return seen, _marked(symbol, "targeted") if seen else symbol
        return seen or symbol[0] == "target", symbol
    return _machine(False, PLAIN + MATCHES, step)


def negation(reach: int = REACH) -> Transducer:
    """Marks matches among the ``reach`` words after a negation of their clause; the state is the words left."""
    def step(left, symbol):
        if symbol[0] in ("end", "colon"):
            return 0, symbol
        if symbol[0] == "negation":
            return reach, symbol
        return max(0, left - 1), _marked(symbol, "negated") if left and symbol[0] in KINDS else symbol
    return _machine(0, PLAIN + MATCHES, step)


def report() -> Transducer:
    """Marks matches after reported speech of their sentence; a colon does not end it."""
    def step(seen, symbol):
        if symbol[0] in KINDS:
            return seen, _marked(symbol, "reported") if seen else symbol
        return symbol[0] == "report" or seen and symbol[0] != "end", symbol
    return _machine(False, PLAIN + MATCHES, step)


def decide() -> Transducer:
    """Writes a match's class and the state that prevails, and nothing for other symbols."""
    return _machine(None, PLAIN + MATCHES, lambda _, s: (None, (s[0], s[-1] if len(s) > 1 else STATES[0]) if s[0] in KINDS else None))


GRAMMAR = compose(compose(compose(target(), negation()), report()), decide())
LATER_TARGET = target()  # run from right to left


class Lexicon(dict):
    """The lexical transducer: word to (symbol, weight); ends of paths are learned once a word, a bounded number is kept."""

    def __init__(self, patterns: dict[str, float], most: int = 400_000):
        super().__init__()
        self.most, self.trie = most, {}
        for kind, words in (("report", REPORT), ("negation", NEGATION), ("target", TARGET)):
            for w in words.split():
                self._node(w).setdefault("word", (kind, 1.0))
        for p, weight in patterns.items():
            if p.endswith("*"):
                self._node(p[:-1])["stem"] = weight
            else:
                self._node(p)["word"] = ("insult", weight)
        for w in THREAT.split():
            kind, weight = self.read(w)
            self._node(w)["word"] = ("threat", weight if kind == "insult" else 1.0)

    def _node(self, path: str) -> dict:
        node = self.trie
        for c in path:
            node = node.setdefault(c, {})
        return node

    def read(self, word: str) -> tuple[str, float]:
        """The class and weight at the end of the word's path: a whole word of a match, else its heaviest stem."""
        node, stem = self.trie, None
        for c in word:
            node = node.get(c)
            if node is None:
                break
            if "stem" in node:
                stem = max(node["stem"], stem or node["stem"])
        end = node.get("word", ("other", 0.0)) if node else ("other", 0.0)
        return end if end[0] in KINDS or stem is None else ("insult", stem)

    def __missing__(self, word: str):
        if len(self) > self.most:
            self.clear()
        kind, weight = (STOP[word], 0.0) if word in STOP else self.read(word)
        out = self[word] = ((kind,), weight)
        return out


def matches(text: str | None, lexicon: Lexicon) -> list[tuple[str, str, float, int]]:
    """(class, state, weight, clause number) of each insult or threat, in the text's order."""
    out, clause, state = [], 0, GRAMMAR.start
    symbols, weights, hit = [], [], False

    def close():
        nonlocal symbols, weights, hit, state
        if hit:
            aimed, _ = LATER_TARGET.run(reversed(symbols))
            symbols = aimed[::-1]
        written, state = GRAMMAR.run(symbols, state)
        if hit:
            out.extend((*w, weight, clause) for w, weight in zip(written, weights) if w)
        symbols, weights, hit = [], [], False

    for token in TOKEN.findall((text or "").lower()):
        symbol, weight = lexicon[token]
        if token in STOP:
            close()
            state, clause = GRAMMAR.arcs[state][symbol][0], clause + 1
            continue
        symbols.append(symbol)
        weights.append(weight)
        hit = hit or symbol[0] in KINDS
    close()
    return out


def features(found: list[tuple[str, str, float, int]]) -> np.ndarray:
    """Weight, number and clauses of the matches by class and state, then the heaviest clause."""
    x = np.zeros(N_FEATURES)
    clauses, heavy = {(k, s): set() for k in KINDS for s in STATES}, Counter()
    for kind, state, weight, clause in found:
        at = 3 * (len(STATES) * KINDS.index(kind) + STATES.index(state))
        x[at] += weight
        x[at + 1] += 1
        clauses[kind, state].add(clause)
        heavy[clause] += weight
    for at, seen in enumerate(clauses.values()):
        x[3 * at + 2] = len(seen)
    x[-1] = max(heavy.values(), default=0.0)
    return np.log1p(np.maximum(x, 0))


def _word_patterns(text: str | None) -> set[str]:
    words = {w for w in TOKEN.findall((text or "").lower()) if w not in STOP}
    return words | {w[:n] + "*" for w in words for n in range(PREFIX[0], min(PREFIX[1], len(w)) + 1)}


def learn_patterns(train: DataFrame, least: int = LEAST_DOCS) -> dict[str, float]:
    """Patterns that toxic rows hold far more often than others, with their log odds; ``train`` is (text, toxic)."""
    def count(batches):
        for b in batches:
            bad, good = Counter(), Counter()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (bad if toxic else good).update(_word_patterns(text))
            every = list(bad | good)
            yield pa.RecordBatch.from_pydict({"pattern": every, "bad": pa.array([bad[p] for p in every], pa.int64()),
                                              "good": pa.array([good[p] for p in every], pa.int64())})
    n = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_bad, n_good = int(n[0]), int(n[1]) - int(n[0])
    if not n_bad or not n_good:
        return {}
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    rows = (train.select("text", "toxic").mapInArrow(count, "pattern string, bad bigint, good bigint")
            .groupBy("pattern").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
            .withColumn("odds", odds).where((F.col("bad") >= least) & (F.col("odds") > 2.0)).collect())  # words of the bounded training rows
    kept: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["pattern"]), r["pattern"])):
        stem = r["pattern"].rstrip("*")
        shorter = [kept[p] for n in range(PREFIX[0], len(stem) + 1) if (p := stem[:n] + "*") in kept]
        if not shorter or r["odds"] > max(shorter) + 0.5:
            kept[r["pattern"]] = float(r["odds"])
    return kept


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(x) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        w[-1] = math.log(rate / (1 - rate)) if len(y) else 0.0
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_model(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
                train_rows: int = TRAIN_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon's patterns and the coefficients, from a bounded sample of the labelled rows outside fold 0."""
    picked = stored(labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
                    .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
                    .orderBy(F.xxhash64("_id"), "_id").limit(train_rows), "toxic-labels")
    train = stored(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
                   .join(F.broadcast(picked), "_id").select("_id", "text", "toxic"), "toxic-train")
    # patterns come from one half and coefficients from the other, so that weights are not trusted too far
    half = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(4)) == 0
    patterns = learn_patterns(train.where(~half))
    lexicon = Lexicon(patterns)

    def read(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({
                "x": pa.array([features(matches(t, lexicon)).tolist() for t in b.column(0).to_pylist()], pa.list_(pa.float64())),
                "y": b.column(1).cast(pa.int32())})
    rows = train.where(half).select("text", "toxic").mapInArrow(read, "x array<double>, y int").collect()  # bounded
    x = np.array([r["x"] for r in rows]).reshape(len(rows), N_FEATURES)
    return learn_all(train, patterns), fit(x, np.array([r["y"] for r in rows], float))


def learn_all(train: DataFrame, patterns: dict[str, float]) -> dict[str, float]:
    """The lexicon of all training rows, with the weights' scale of the half that the coefficients were fitted to."""
    every = learn_patterns(train)
    return {p: patterns.get(p, w) for p, w in every.items()} if every else patterns


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], text: str = "text",
          doc_id: str = "doc_id") -> DataFrame:
    """(doc id, score, n_matches, n_clauses) for every row."""
    patterns, w = model
    kind = docs.schema[doc_id].dataType.simpleString()
    lexicon = Lexicon(patterns)

    def run(batches):
        none = features([])
        for b in batches:
            xs, n, c = [], [], []
            for t in b.column(1).to_pylist():
                found = matches(t, lexicon)
                xs.append(features(found) if found else none)
                n.append(len(found))
                c.append(len({m[3] for m in found}))
            x = np.array(xs).reshape(b.num_rows, N_FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "score": pa.array(p, pa.float64()),
                                              "n_matches": pa.array(n, pa.int64()), "n_clauses": pa.array(c, pa.int64())})
    return (docs.select(F.col(doc_id), F.col(text))
            .mapInArrow(run, f"id {kind}, score double, n_matches bigint, n_clauses bigint").withColumnRenamed("id", doc_id))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_model(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches", "n_clauses")

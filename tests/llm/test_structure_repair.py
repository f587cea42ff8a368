import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from planwise.llm import structure_repair as sr
from planwise.llm.turns import plain_turns
from tests.llm.conftest import SF

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def row_digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def hurt(rows):
    out = []
    for c, t, r, x in rows:
        r, x = r if r is not None else " ", x if x is not None else " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", x)
        out.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, found):
    """Least (cost, audit) with the repaired rows, by a search over (row, roles so far) that knows only the pattern."""
    n = len(rows)
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, roles, kept = heapq.heappop(queue)
        if at == n and GRAMMAR.fullmatch(roles):
            return cost, audit, list(kept)
        state = roles if len(roles) < 3 else ("s" if roles[0] == "s" else "") + "ua" * 1 + roles[-1] * (roles[-1] == "u")
        if (at, state) in done:
            continue
        done.add((at, state))

        def go(edit, price, step, new, row):
            grown = roles + new
            if any(GRAMMAR.fullmatch(grown + rest) for rest in ("", "a", "ua")):
                heapq.heappush(queue, (cost + price, audit + edit, at + step, grown, kept + row))
        if at < n:
            c, t, r, x = rows[at]
            go("D", 2, 1, "", ())
            if found[at] not in ("blank", "duplicate"):
                more = 5 if found[at] == "truncated" else 0
                go("K", more, 1, r[:1] or "?", (f"{r}:{x}",))
                for to in ("user", "assistant"):
                    go("R", 1 + more, 1, to[0], (f"{to}:{x}",))
        for to in ("user", "assistant"):
            go("I", 5, 0, to[0], (f"{to}:",))
    raise AssertionError


def brute(rows, damage=True):
    convs = defaultdict(list)
    for row in hurt(rows) if damage else rows:
        convs[row[0]].append(row)
    out = []
    for c in {r[0] for r in rows}:
        mine = sorted(convs.get(c, []), key=lambda x: (x[1] is not None, x[1] or 0, x[2], row_digest(x[2], x[3])))
        f = faults(mine)
        cost, audit, kept = cheapest(mine, f)
        turns = [x[1] for x in mine if x[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out.append((c, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), bad, cost, audit,
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def made_up(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "no", " \t\n", "", "Why?  ", "é!", None, "a.b", "Yes."])
            rows += [(c, rng.choice([t, t, t + 3, None]), role, text)]
    return rows


def test_op13_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = sr.op13_structure_repair(spark, SF)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_automaton_equals_search():
    rng = random.Random(5)
    automaton, words = sr.SuffixAutomaton(), set()
    while len(words) < 600:
        words.add("".join(rng.choice(sr.LETTERS) for _ in range(rng.randrange(1, 8))))
    suffixes = {w[k:] for w in words for k in range(len(w))}
    for reverse in sorted(w[::-1] for w in words):
        word = reverse[::-1]
        rows = [(0, k, {"o": "tool"}.get(sr.CLASSES[sr.LETTERS.index(x) // 4], sr.CLASSES[sr.LETTERS.index(x) // 4]), "") for k, x in enumerate(word)]
        assert automaton.read(reverse) == cheapest(rows, [sr.FAULTS[sr.LETTERS.index(x) % 4] for x in word])[:2]
    assert automaton.made == len(suffixes)  # a node for each distinct suffix, made once


@pytest.mark.parametrize("audit_bytes", [sr.AUDIT_BYTES, 0])
def test_made_up_conversations(spark, monkeypatch, audit_bytes):
    monkeypatch.setattr(sr, "AUDIT_BYTES", audit_bytes)
    rows = made_up(random.Random(9), 150)
    rows += [(7, 1, "user", "Yes."), (7, 1, "user", "Yes."), (None, 1, "user", "x" * 70_000), (None, 2, "assistant", "Fine.")]
    rows += [(1000, k, "user" if k % 2 else "assistant", f"{k}.") for k in range(300)]  # one with many rows
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"signature": F.lit("x"), "audit": F.lit(1)}).repartition(6)
    turns = plain_turns(df, null=" ")
    found = sr.diagnose(turns)
    repaired = sr.per_row(sr.repair(turns, found), sr._digests, "conv_id bigint, repaired_sha256 string")
    texts = {r[0]: r[1] for r in repaired.collect()}
    none = hashlib.sha256(b"").hexdigest()
    got = sorted(((*r, texts.get(r[0], none)) for r in found.collect()), key=str)
    plain = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    assert got == brute(plain, damage=False)
    assert sr.diagnose(turns.limit(0)).collect() == []
    assert sr.repair(turns.limit(0), found.limit(0)).collect() == []

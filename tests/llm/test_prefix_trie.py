import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from planwise.llm.prefix_trie import NO_ENDS, op11_conversation_trie, prefix_trie, rebuilt, sequences, shared_entries
from tests.llm.conftest import SF

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(seqs):
    """{conv: [(role, text)]} to sorted node rows, by plain prefixes."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))).encode()).hexdigest())
                   for p, m in members.items()), key=str)


def ordered(rows):
    seqs = defaultdict(list)
    for c, _, r, t in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        seqs[c].append((r or "", t or ""))
    return seqs


def rebuild(seqs):
    out = {}
    for c, turns in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = seqs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_op11_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_conversation_trie(spark, SF)) == brute(rebuild(ordered(rows)))


@pytest.mark.parametrize("block_bytes", [1, 700, 8 << 20])
def test_blocks_are_contracted_and_merged(spark, block_bytes):
    rng = random.Random(block_bytes)
    seqs = {}
    for c in range(400):
        old = list(seqs.values())
        head = rng.choice(old)[:rng.randrange(9)] if old and rng.random() < 0.8 else []
        seqs[c] = head + [("user", rng.choice("ab") * rng.randrange(40)) for _ in range(rng.randrange(4))]
    for c in range(1000, 1300):  # a third are copies of one conversation
        seqs[c] = [("user", "copy")] * 3
    rows = [(c, k, r, t) for c, turns in seqs.items() for k, (r, t) in enumerate(turns)]
    df = sequences(spark.createDataFrame(rows, SCHEMA).repartition(5))
    empty = spark.createDataFrame([(c, []) for c, t in seqs.items() if not t], "conv_id bigint, entries array<binary>")
    assert got(prefix_trie(df.unionByName(empty), block_bytes)) == brute(seqs)


def test_edges(spark):
    rows = [(1, None, None, None), (1, 1, "user", "x" * 100_000), (1, 1, "user", "x" * 100_000), (2, 0, "", ""), (None, 0, "user", "no"),
            (-7, 3, "user", "minus"), (300, 0, "user", "a"), (305, 9, "user", "b")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"path": F.lit(1), "entries": F.lit("x"), "at": F.lit(2)})
    assert got(prefix_trie(sequences(df))) == brute(ordered(rows))
    assert got(prefix_trie(rebuilt(sequences(df)))) == brute(rebuild(ordered(rows)))
    assert got(prefix_trie(sequences(df.limit(0)))) == []
    one = spark.createDataFrame([(5, [])], "conv_id bigint, entries array<binary>")
    assert got(prefix_trie(one)) == [(5, 0, None, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest())]
    assert NO_ENDS == hashlib.sha256().hexdigest()


def test_long_conversation(spark):
    turns = [("user", str(k)) for k in range(3000)]
    seqs = {1: turns, 2: turns[:2000] + [("user", "other")], 3: turns[:2999]}
    rows = [(c, k, r, t) for c, s in seqs.items() for k, (r, t) in enumerate(s)]
    out = prefix_trie(sequences(spark.createDataFrame(rows, SCHEMA)), 1)
    want = {(1, d): 3 if d <= 2000 else 2 if d <= 2999 else 1 for d in range(3001)} | {(2, 2001): 1}
    assert {(r.conv_id, r.depth): r.n_convs for r in out.collect()} == want


def test_shared_entries():
    rng = random.Random(3)
    for _ in range(300):
        a = bytes(rng.randrange(2) for _ in range(20 * rng.randrange(40)))
        cut = 20 * rng.randrange(40)
        b = a[:cut] + bytes(rng.randrange(2) for _ in range(20 * rng.randrange(20)))
        plain = 0
        while plain < min(len(a), len(b)) // 20 and a[20 * plain:20 * plain + 20] == b[20 * plain:20 * plain + 20]:
            plain += 1
        assert shared_entries(a, b) == plain

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from planwise.llm.packing import (END_ID, WordTokenizer, first_fit_decreasing, op2_packing, pack, pack_documents,
                                  public_tokenizer)
from tests.llm.conftest import SF


def _check(rows, ids_of):
    """Each id in one piece, sequences gapless, checksums right; returns the padding."""
    from collections import defaultdict
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, pieces in docs.items():
        ids, at = ids_of[doc], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_op2_on_the_table(spark, documents):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizer())
    rows = documents.select("doc_id", "text").collect()
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [END_ID] for r in rows}
    assert _check(op2_packing(spark, SF).collect(), ids) == 0


def test_tokenizer_by_words_equals_whole_texts():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizer())
    texts = ["", " ", "It's HERE now, don't stop", "é ́x", "a<|endoftext|>b <|startoftext|> c",
             "İstanbul ΣΣ Σ", "x\u0085y​z q r\x1cs\x1ft", "99 1234 ½ ﬁ",
             "﻿b ᠎ c", "👩‍🚀 ok",
             "ÀÉß ÿØ×÷ Straße! 12a3$$$x, y.\n(z)\t--w", "<| a |> <x", "%%%A***b### 7,5", "ª º ² µ ¿qué?", "x\x1cy\x00z \x7f~"]
    w = WordTokenizer(public_tokenizer())
    got = [np.frombuffer(x, "<u4").tolist() for x in w.encode(texts)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_plain_texts_in_parts_and_generations(monkeypatch):
    rng = random.Random(5)
    letters = "aZé ß×÷ \t\n\x0b09,.(-'ÀÿÞÐ "
    texts = ["".join(rng.choice(letters[:rng.randint(2, len(letters))]) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "x" * 500, " " * 300, "ab " * 200]
    want = [x.tobytes() for x in WordTokenizer(public_tokenizer())._ids(texts)]
    assert WordTokenizer(public_tokenizer()).encode(texts) == want
    monkeypatch.setattr("planwise.llm.packing.BATCH", 50)
    few = WordTokenizer(public_tokenizer(), cache_words=100)
    assert few.encode(texts) == want and few.older
    assert not few.whole


def test_first_fit_equals_a_plain_scan():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        room, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            at = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
            if at is None:
                at = len(room)
                room.append(100)
                want.append([])
            room[at] -= sizes[i]
            want[at].append(i)
        assert first_fit_decreasing(sizes, 100) == want


def test_pack_leaves_no_padding_and_loses_nothing():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.choice([1, 3, 64, 100, 640, rng.randint(1, 300)]) for _ in range(rng.randint(0, 40))]
        sequences = pack(sizes, 128)
        got = sorted(p for s in sequences for p in s)
        at = dict.fromkeys(range(len(sizes)), 0)
        for item, start, n in got:
            assert start == at[item] and n > 0
            at[item] += n
        assert list(at.values()) == sizes
        for s in sequences:
            n = sum(p[2] for p in s)
            assert n <= 128 and n & (n - 1) == 0


def test_edge_cases(spark):
    schema = "doc_id bigint, text string, length int"
    rows = [(1, None, 0), (2, "", 0), (None, "x y", 0), (4, "one " * 30_000, 0), (5, "same", 0), (5, "same", 0)]
    out = pack_documents(spark.createDataFrame(rows, schema), public_tokenizer()).collect()
    assert sum(r.length for r in out) == 1 + 1 + 3 + 30_001 + 2 + 2
    assert all(len(r.ids) == r.length for r in out)
    assert sum(r.doc_tokens == 2 for r in out) == 2
    assert pack_documents(spark.createDataFrame([], schema), public_tokenizer()).count() == 0
    assert F is not None


def test_equal_rows_spread_over_groups(spark):
    text = "same words again " * 6
    rows = spark.range(30_000).select(F.lit(1).alias("doc_id"), F.lit(text).alias("text")).repartition(2)
    out = pack_documents(rows, public_tokenizer(), group_bytes=100_000, with_ids=False)
    whole = out.groupBy(F.shiftright("sequence_id", 32).alias("g")).agg(F.sum("length").alias("n")).collect()
    tokens = len(WordTokenizer(public_tokenizer()).encode([text])[0]) // 4 + 1
    assert sum(r.n for r in whole) == 30_000 * tokens
    assert max(r.n for r in whole) * len(text) / tokens <= 2 * 100_000


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["It's HERE  now", "ÀÉ ok", "x y", ""]
    w = WordTokenizer(path)
    assert w.whole and not WordTokenizer(public_tokenizer()).whole
    got = [np.frombuffer(x, "<u4").tolist() for x in w.encode(texts)]
    assert got == [Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids for x in texts]

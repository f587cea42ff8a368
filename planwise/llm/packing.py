"""Operator 2: packing token sequences by first-fit decreasing.

Documents fall into randomised groups of bounded text; each group packs on its
own.  A document longer than a sequence fills whole ones; the rest goes, in
decreasing order, into the first open sequence with room, found by descending
a tournament tree of the sequences' free room.  What first fit leaves open is
closed by cutting: the emptiest sequences are dissolved into the gaps of the
fullest.  The at most one sequence of a group that stays open is laid out as
sequences whose lengths are powers of two, which need no padding.

Defined cases: null and empty texts are the end mark alone; repeated rows and
null ids are packed as documents of their own; an empty table packs nothing;
a text of any length is cut, never shortened.  Rows are dealt to groups by
their place in the stored table, so any number of equal rows spreads evenly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm.common import table, text_bytes
from planwise.llm.tokens import word_keys

LENGTH = 2048
GROUP_BYTES = 8 << 20
CACHE_WORDS = 400_000  # of each of two generations
END_ID = 1
BATCH = 1 << 20  # characters of plain texts encoded together


# Texts of these characters alone are cut into the tokenizer's words here: white
# space, printable ASCII but the apostrophe, and the Latin-1 letters.  They have
# one form under normalisation, and lower-case one by one.
PLAIN = re.compile(r"[\t\n\x0b\x0c\r -&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
# Kinds of their characters after lower-casing: a word is a run of letters, one digit, or a run of others.
SPACE, LETTER, DIGIT, OTHER = range(4)
_LATIN = [chr(i) for i in range(256)]
_KIND = np.array([SPACE if c in " \t\n\x0b\x0c\r" else DIGIT if "0" <= c <= "9" else
                  LETTER if "a" <= c <= "z" or "\u00df" <= c <= "\u00ff" and c != "\u00f7" else OTHER for c in _LATIN], np.uint8)
_LOWER = np.array([ord(c.lower()) if PLAIN.fullmatch(c) else i for i, c in enumerate(_LATIN)], np.uint8)
# Byte-level models write each byte as a letter: printable Latin-1 bytes as themselves, the n-th other one as 256 + n.
_OWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = [chr(i if i in _OWN else 256 + sum(b not in _OWN for b in range(i))) for i in range(256)]
BYTE_LETTERS = {i: "".join(_LETTERS[b] for b in chr(i).encode()) for i in range(128, 256)}
BREAK = re.compile(r"[ \t\n\x0b\x0c\r]")
# A tokenizer file is taken word by word only if these come out as from whole texts.
PROBES = ["It's HERE now, don't  stop.\n\nNext line\tand 12 3a4 $5.60 (x)!", "Straße ÀÉß, naïve café — ½ ﬁ 中文 e\u0301x", " leading and trailing ",
          "MiXeD CASE words-with/joins_and 'quotes' \"double\"", "a", "é", "\x1cb\u200bc 👩\u200d🚀 ok"]


class WordTokenizer:
    """Ids of texts by a tokenizer that splits at white space and between letters, digits and other characters.

    Each distinct word is encoded once while it is remembered.  Plain texts
    are cut into the tokenizer's own words, about a megabyte at a time as
    arrays, in which equal words are told by 64-bit keys; of other texts, the
    runs between ASCII white space are looked up whole; a text that holds the
    string of a special token goes to the tokenizer as it is.  Any other
    tokenizer, told by probe texts, gets whole texts.

    Words are remembered in two generations: when the younger is full it
    becomes the older, and a word found there moves to the younger.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.limit, self.known, self.older = cache_words, {}, {}
        self.whole = False
        self.whole = self.encode(PROBES) != [x.tobytes() for x in self._ids(PROBES)]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        """Encode the tokenizer's own words by its model alone; they need no normalising and no cutting."""
        tokens = self.tokenizer.model.tokenize
        ids = [[t.id for t in tokens(w if w.isascii() else w.translate(BYTE_LETTERS))] for w in words]
        cuts = (np.cumsum([0, *map(len, ids)]) * 4).tolist()
        data = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        self.known.update(zip(words, [data[a:b] for a, b in zip(cuts, cuts[1:])]))

    def _learn_runs(self, runs: list[bytes]) -> None:
        for a in range(0, len(runs), 5000):
            part = runs[a:a + 5000]
            self.known.update(zip(part, [x.tobytes() for x in self._ids([w.decode() for w in part])]))

    def _recall(self, words: list, learn: Callable[[list], None]) -> list[bytes]:
        """Ids of distinct words; those not remembered are learnt."""
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = list(map(known.get, words))
        gone = [i for i, x in enumerate(found) if x is None]
        fresh = []
        for i in gone:
            x = older.get(words[i])
            if x is None:
                fresh.append(words[i])
            else:
                known[words[i]] = x
        learn(fresh)
        for i in gone:
            found[i] = known[words[i]]
        return found

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts, by arrays over all their characters."""
        data = _LOWER[np.frombuffer("\n".join([*texts, ""]).encode("latin-1"), np.uint8)]
        kind = _KIND[data]
        start = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) + 1
        start = np.concatenate([[0], start])
        end = np.concatenate([start[1:], [len(data)]])
        words = kind[start] != SPACE
        start, end = start[words], end[words]
        if not len(start):
            return [b""] * len(texts)
        keys = word_keys(data, start, end)
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        first, which = order[new], np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        lower = data.tobytes().decode("latin-1")
        found = self._recall([lower[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())], self._learn_words)
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        counts = sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], counts) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        cuts = ends[np.searchsorted(start, bounds)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.whole:
            return [x.tobytes() for x in self._ids(texts)]
        out: list[list[bytes]] = [[] for _ in texts]
        parts, at, size = [], [], 0
        runs: dict[int, list[bytes]] = {}

        def flush() -> None:
            for i, ids in zip(at, self._plain_ids(parts) if parts else ()):
                out[i].append(ids)
            parts.clear()
            at.clear()

        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i].append(self._ids([t])[0].tobytes())
            elif PLAIN.fullmatch(t):
                for part in _parts(t):
                    if size + len(part) > BATCH:
                        flush()
                        size = 0
                    parts.append(part)
                    at.append(i)
                    size += len(part)
            else:
                # bytes split at ASCII white space only; other white space stays inside a run and is the tokenizer's
                runs[i] = t.encode().split()
        flush()
        distinct = list(set().union(*runs.values()))
        ids_of = dict(zip(distinct, self._recall(distinct, self._learn_runs)))
        for i, found in runs.items():
            out[i] = [b"".join(map(ids_of.__getitem__, found))]
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def _parts(text: str) -> Iterator[str]:
    """A text cut at white space into parts of about ``BATCH`` characters."""
    a = 0
    while len(text) - a > BATCH:
        stop = BREAK.search(text, a + BATCH)
        if not stop:
            break
        yield text[a:stop.start()]
        a = stop.start()
    yield text[a:]


class Tournament:
    """Free room of sequences in a binary tree; finds the first sequence with enough room."""

    def __init__(self, n: int):
        self.width = 1 << max(0, (n - 1).bit_length())
        self.room = [0] * (2 * self.width)

    def put(self, i: int, room: int) -> None:
        i += self.width
        self.room[i] = room
        while i > 1:
            i >>= 1
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def first(self, need: int) -> int:
        """The leftmost sequence with at least ``need`` room, -1 if there is none."""
        if self.room[1] < need:
            return -1
        i = 1
        while i < self.width:
            i *= 2
            if self.room[i] < need:
                i += 1
        return i - self.width


def first_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Items of each sequence."""
    tree, bins, room = Tournament(max(1, len(sizes))), [], []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = tree.first(sizes[item])
        if at < 0:
            at = len(bins)
            bins.append([])
            room.append(length)
        bins[at].append(item)
        room[at] -= sizes[item]
        tree.put(at, room[at])
    return bins


def pack(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length) pieces; each id of each item lies in exactly one piece."""
    sequences, rest, lead = [], [], []
    for item, n in enumerate(sizes):
        whole = n // length * length
        sequences += [[(item, a, length)] for a in range(0, whole, length)]
        if n > whole:
            rest.append(n - whole)
            lead.append((item, whole))
    open_ = []
    for items in first_fit_decreasing(rest, length):
        pieces = [(*lead[i], rest[i]) for i in items]
        (sequences if sum(p[2] for p in pieces) == length else open_).append(pieces)
    open_.sort(key=lambda pieces: -sum(p[2] for p in pieces))
    spare = []  # pieces of dissolved sequences, the next to place last
    low, high = 0, len(open_) - 1
    last: list[tuple[int, int, int]] = []
    while low <= high:
        pieces = open_[low]
        gap = length - sum(p[2] for p in pieces)
        while gap:
            if not spare:
                if high <= low:
                    break
                spare, high = open_[high], high - 1
            item, start, n = spare.pop()
            take = min(n, gap)
            pieces.append((item, start, take))
            gap -= take
            if take < n:
                spare.append((item, start + take, n - take))
        if gap:
            last = pieces
        else:
            sequences.append(pieces)
        low += 1
    last = last + spare
    while sum(p[2] for p in last) >= length:  # what was dissolved may fill sequences of its own
        taken, last = _cut(last, length)
        sequences.append(taken)
    total = sum(p[2] for p in last)
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            taken, last = _cut(last, 1 << bit)
            sequences.append(taken)
    return sequences


def _cut(pieces, length):
    """The first ``length`` ids of the pieces, and the others."""
    taken, left = [], []
    for item, start, n in pieces:
        take = min(n, length)
        if take:
            taken.append((item, start, take))
        if take < n:
            left.append((item, start + take, n - take))
        length -= take
    return taken, left


SCHEMA = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
          "sequence_length bigint, ids array<int>")


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH,
                   seed: int = 17, group_bytes: int = GROUP_BYTES, with_ids: bool = True) -> DataFrame:
    """One row per piece: (doc id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, ids)."""
    picked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    n_groups = max(8, -(-text_bytes(picked, "_text") // group_bytes))
    # a row's place tells it from equal ones, so no content makes a large group; stored files are read again in the same order
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(n_groups))
    id_type = picked.schema["_id"].dataType.simpleString()
    state: dict[str, WordTokenizer] = {}

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        encoder = state.setdefault(tokenizer, None) or WordTokenizer(tokenizer)
        state[tokenizer] = encoder
        mark = np.asarray([END_ID], "<u4").tobytes()
        texts, ids = [t or "" for t in rows["_text"].to_pylist()], []
        at = 0
        while at < len(texts):  # bounded batches
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) < (1 << 20)):
                size += len(texts[stop])
                stop += 1
            ids += [x + mark for x in encoder.encode(texts[at:stop])]
            at = stop
        sizes = [len(x) // 4 for x in ids]
        out = {name: [] for name in ("row", "start", "length", "crc", "tokens", "sequence", "offset", "full")}
        cut = []
        for s, pieces in enumerate(pack(sizes, length)):
            offset, full = 0, sum(p[2] for p in pieces)
            for row, start, n in pieces:
                data = ids[row][4 * start:4 * (start + n)]
                for name, value in zip(out, (row, start, n, zlib.crc32(data), sizes[row],
                                             (key[0].as_py() << 32) | s, offset, full)):
                    out[name].append(value)
                if with_ids:
                    cut.append(np.frombuffer(data, "<i4"))
                offset += n
        n = len(out["row"])
        if with_ids:
            flat = np.concatenate(cut) if cut else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(out["length"])]).astype(np.int32)),
                                             pa.array(flat, pa.int32()))
        else:
            lists = pa.nulls(n, pa.list_(pa.int32()))
        return pa.table({"id": rows["_id"].combine_chunks().take(pa.array(out["row"], pa.int64())),
                         **{to: pa.array(out[name], pa.int64()) for to, name in (
                             ("start", "start"), ("length", "length"), ("ids_crc32", "crc"), ("doc_tokens", "tokens"),
                             ("sequence_id", "sequence"), ("offset", "offset"), ("sequence_length", "full"))},
                         "ids": lists})

    return (picked.withColumn("_group", group).groupBy("_group")
            .applyInArrow(run, f"id {id_type}, {SCHEMA}").withColumnRenamed("id", doc_id))


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizer(), with_ids=False).drop("ids")

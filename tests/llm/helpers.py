"""Brute-force versions that the operators are compared with."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def near(rows, width, percent=80):
    """{id: (n, component)} by comparing every pair that shares a shingle."""
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            n, m = len(sets[a]), len(sets[b])
            if not n or not m or 100 * min(n, m) < percent * max(n, m):
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (n + m - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(rows, width):
    """[(id, n_words, n_removed, sha256)] by counting every window."""
    seen = {}
    for _, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k:k + width])] > 1:
                gone.update(range(k, k + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out

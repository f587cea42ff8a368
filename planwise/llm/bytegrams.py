"""Byte windows of token streams and the count tables of their contexts.

A window is a byte with the ``order`` bytes before it, packed into a long.
0xFF, which UTF-8 never uses, stands before the start of a text and ends it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planwise.llm.common import KeyMap


def windows(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The window of every byte of the streams that begin at ``starts``."""
    parts, width = {1: data.astype(np.uint64)}, 1
    while width * 2 <= order + 1:  # doubling: the window of 2w bytes from two of w
        half = parts[width]
        both = half.copy()
        both[width:] |= half[:-width] << np.uint64(8 * width)
        parts[width * 2], width = both, width * 2
    keys, have = parts[width], width
    for w in sorted(parts, reverse=True):
        while have + w <= order + 1:
            keys = keys.copy()
            keys[have:] |= parts[w][:-have] << np.uint64(8 * have)
            have += w
    keys &= np.uint64((1 << (8 * (order + 1))) - 1)
    ends = np.append(starts[1:], len(data))
    for j in range(order):
        at = starts[starts + j < ends] + j
        blank = ((1 << (8 * (order + 1))) - 1) ^ ((1 << (8 * (j + 1))) - 1)
        keys[at] |= np.uint64(blank)
    return keys


def window_sums(found: KeyMap, vals: np.ndarray, data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """For each stream, the sum of the values of its windows."""
    if not len(starts):
        return np.zeros(0)
    at = found.find(windows(data, starts, order))
    if at.min() < 0:
        raise RuntimeError("a window has no value: the input changed between two reads of it")
    return np.add.reduceat(vals[at], starts)


def suffix_bits(k: int) -> int:
    return (1 << (8 * (k + 1))) - 1


def with_levels(keys: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Join each window with the counts of all its suffixes.

    ``levels[k]`` is (grams, contexts) of order k: grams has ``g`` and
    ``c{k}``, contexts ``ctx`` and further columns named by order.
    """
    out = keys
    for k in reversed(range(len(levels))):
        grams, contexts = levels[k]
        out = (out.withColumn("_g", F.col("key").bitwiseAND(F.lit(suffix_bits(k))))
               .join(grams.withColumnRenamed("g", "_g"), "_g", "left")
               .withColumn("_ctx", F.shiftright("_g", 8))
               .join(contexts.withColumnRenamed("ctx", "_ctx"), "_ctx", "left")
               .drop("_g", "_ctx"))
    return out

"""Operator 11: prefix trie of conversations by union-find over sorted neighbours.

A conversation is a sequence of turn *entries* of 20 bytes: 16 bytes of the
SHA-256 of (role, text) and the text's code points.  Its path is their
concatenation, so paths in byte order are conversations in trie order and a
node is a prefix of whole entries.

Equal paths collapse first: a range sort by (path, conversation) deals even
copies of one conversation over many tasks, each of which hands on one run of
ids.  Distinct paths are then sorted and cut into blocks.  In a block the
edges between neighbours carry the entries they share (LCP).  Union-find takes
the edges in descending depth; a merge makes the branching node of that depth
and the merged parts its children.  A node that reaches neither end of its
block is closed: its counts are final.  The others lie on the paths of the
block's first and last conversation; the block is contracted to these two
paths with what hangs off them at each depth.  Contracted blocks are sorted
and merged by the same function, level by level, until one block holds the
root.  Children closed below an open parent learn its smallest member by a
join on (block, side, depth).

Defined cases: turns come in order of (turn, null first; entry); a null role
or text is empty; repeated rows are turns like others; rows without a
conversation id belong to no conversation; an empty table gives no nodes, not
even a root.  Texts are told apart by 128 bits.  A path is one value of 20
bytes a turn, so a single conversation may have up to 100 million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm.common import release, stored, table

ENTRY = 20
BLOCK_BYTES = 8 << 20
CHUNK_IDS = 1 << 16
LEAST_ITEMS = 16  # contracted paths that a block takes at least, so that each level shrinks
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
        "saved_tokens bigint, ends_sha256 string")
LEVEL = (f"kind int, block bigint, side int, at bigint, path binary, hung binary, ends array<string>, {NODE}, "
         "open_block bigint, open_side int, open_depth bigint")
NODE_ROW, ITEM_ROW, LINK_ROW = 0, 1, 2


# ------------------------------------------------------------------ sequences
def turn_entry(role: Column, text: Column) -> Column:
    """20 bytes that stand for a turn."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16),
                    F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """(conv_id, entries): each conversation's turns in order."""
    return (turns.where(F.col(conv_id).isNotNull())
            .select(F.col(conv_id).cast("bigint").alias("conv_id"), F.struct(F.col(turn).alias("turn"), turn_entry(F.col(role), F.col(text)).alias("entry")).alias("at"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns"))
            .select("conv_id", F.col("turns.entry").alias("entries")))


# ------------------------------------------------------------------ one block
def shared_entries(a: bytes, b: bytes) -> int:
    """Entries that two paths share from the start."""
    most = min(len(a), len(b)) // ENTRY
    low, step = 0, 1
    while low < most:
        high = min(most, low + step)
        if a[low * ENTRY:high * ENTRY] == b[low * ENTRY:high * ENTRY]:
            low, step = high, step * 2
        elif high == low + 1:
            break
        else:
            step = max(1, (high - low) // 2)
    return low


class Block:
    """Sorted distinct paths and what hangs off them; ``hung[i]`` has rows
    (depth, convs, smallest id, leaves, saved, children) and ``ends[i]`` their hashes of ending conversations."""

    def __init__(self, paths: list[bytes], hung: list[np.ndarray], ends: list[list], block: int, top: bool):
        self.paths, self.block, self.top = paths, block, top
        self.hung, self.ends = hung, ends
        n = len(paths)
        flat = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, ENTRY)[:, 16:]
        sizes = np.ascontiguousarray(flat).view(">u4").ravel().astype(np.int64)
        self.size_sums = np.concatenate([[0], np.cumsum(sizes)])
        self.base = np.concatenate([[0], np.cumsum([len(p) // ENTRY for p in paths])]).astype(np.int64)
        # compact nodes: depth, counts, parent, a path that runs through, and the side on which the node is open
        self.depth, self.convs, self.least, self.leaves, self.saved, self.kids = [], [], [], [], [], []
        self.end, self.parent, self.via, self.side = [], [], [], []
        self.owner = list(range(n))  # union-find over paths
        self.low, self.high, self.tops = list(range(n)), list(range(n)), [-1] * n
        self.placed: list[tuple[int, int, int]] = []  # (path, row of its hung, node)
        self._merge()

    def _find(self, i: int) -> int:
        owner = self.owner
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    def _node(self, depth: int, via: int) -> int:
        self.depth.append(depth)
        self.convs.append(0)
        self.least.append(None)
        self.leaves.append(0)
        self.saved.append(0)
        self.kids.append(0)
        self.end.append(None)
        self.parent.append(-1)
        self.via.append(via)
        self.side.append(-1)
        return len(self.depth) - 1

    def _settle(self, part: int, node: int) -> bool:
        """All below ``node`` is known; True if it is closed."""
        if not self.top and (self.low[part] == 0 or self.high[part] == len(self.paths) - 1):
            self.side[node] = 0 if self.low[part] == 0 else 1
            return False
        if not self.kids[node]:
            self.leaves[node] = 1
        if self.depth[node]:
            self.saved[node] += (self.convs[node] - 1) * self._chars(self.via[node], self.depth[node] - 1, self.depth[node])
        return True

    def _chars(self, path: int, low: int, high: int) -> int:
        """Code points of the turns after the first ``low`` up to the first ``high`` of a path."""
        at = self.base[path]
        return int(self.size_sums[at + high] - self.size_sums[at + low])

    def _add(self, node: int, convs: int, least: int, leaves: int, saved: int, kids: int) -> None:
        self.convs[node] += convs
        if least is not None and (self.least[node] is None or least < self.least[node]):
            self.least[node] = least
        self.leaves[node] += leaves
        self.saved[node] += saved
        self.kids[node] += kids

    def _hang(self, part: int, child: int, node: int) -> None:
        """``child``, the top of ``part``, gets the parent ``node``."""
        self.parent[child] = node
        if self._settle(part, child):
            chain = (self.convs[child] - 1) * self._chars(self.via[child], self.depth[node], self.depth[child] - 1)
            self._add(node, self.convs[child], self.least[child], self.leaves[child], self.saved[child] + chain, 1)

    def _raised(self, part: int, depth: int) -> int:
        """The node of ``part`` at ``depth``, made if there is none."""
        top = self.tops[part]
        if top >= 0 and self.depth[top] == depth:
            return top
        node = self._node(depth, self.low[part])
        if top >= 0:
            self._hang(part, top, node)
        self.tops[part] = node
        return node

    def _join(self, left: int, right: int, depth: int) -> None:
        a, b = self._find(left), self._find(right)
        node = self._raised(a, depth)  # equal edges run from left to right: only the left part can have this node
        if self.tops[b] >= 0:
            self._hang(b, self.tops[b], node)
        if self.high[a] - self.low[a] < self.high[b] - self.low[b]:
            a, b = b, a
        self.owner[b] = a
        self.low[a], self.high[a] = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])
        self.tops[a] = node

    def _merge(self) -> None:
        n = len(self.paths)
        edges = np.array([shared_entries(a, b) for a, b in zip(self.paths, self.paths[1:])], np.int64)
        rows = np.array([len(h) for h in self.hung], np.int64)
        of = np.repeat(np.arange(n), rows)
        row = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
        at = np.concatenate(self.hung)[:, 0]
        depth = np.concatenate([edges, at])
        kind = np.concatenate([np.zeros(len(edges), np.int8), np.ones(len(at), np.int8)])
        place = np.concatenate([np.arange(len(edges)), np.arange(len(at))])
        for e in np.lexsort((place, kind, -depth)).tolist():
            d, p = int(depth[e]), int(place[e])
            if not kind[e]:
                self._join(p, p + 1, d)
                continue
            path, r = int(of[p]), int(row[p])
            node = self._raised(self._find(path), d)
            self._add(node, *self.hung[path][r, 1:].tolist())
            if self.ends[path][r] is not None:
                self.end[node] = self.ends[path][r]
            self.placed.append((path, r, node))
        part = self._find(0)
        if self.top:
            self._raised(part, 0)
        self._settle(part, self.tops[part])

    # ---------------------------------------------------------------- output
    def nodes(self) -> pa.Table:
        """Rows of all closed nodes, those between two compact nodes included."""
        depth, parent, side = (np.array(x, np.int64) for x in (self.depth, self.parent, self.side))
        closed = np.flatnonzero(side < 0)
        above = np.where(parent[closed] >= 0, depth[parent[closed]], -1)
        count = depth[closed] - above
        node = np.repeat(closed, count)
        first = np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(above, count) + 1 + np.arange(len(node)) - first
        convs, saved, kids, leaves = (np.array(x, np.int64)[node] for x in (self.convs, self.saved, self.kids, self.leaves))
        least = np.array([0 if x is None else x for x in self.least], np.int64)
        base = self.base[np.array(self.via, np.int64)[node]]
        low = np.maximum(at - 1, 0)
        chain = np.where(at < depth[node], self.size_sums[base + np.maximum(depth[node] - 1, 0)] - self.size_sums[base + low], 0)
        bottom, head = at == depth[node], at == np.repeat(above, count) + 1
        over = parent[node]
        waits = head & (over >= 0) & (side[over] >= 0)
        root = head & (over < 0)
        parent_id = np.where(head, least[over], least[node])
        ends = [self.end[c] or NO_ENDS if b else NO_ENDS for c, b in zip(node.tolist(), bottom.tolist())]
        return _rows(len(node), kind=NODE_ROW, conv_id=least[node], depth=at,
                     parent_conv_id=pa.array(parent_id, mask=root | waits), n_convs=convs,
                     n_children=np.where(bottom, kids, 1), n_leaves=leaves, saved_tokens=saved + (convs - 1) * chain,
                     ends_sha256=ends, open_block=pa.array(np.full(len(node), self.block), mask=~waits),
                     open_side=pa.array(side[over].astype(np.int32), mask=~waits),
                     open_depth=pa.array(at - 1, mask=~waits))

    def contracted(self) -> pa.Table:
        """The first and the last path with what hangs off them."""
        paths, hung, ends, sides = [], [], [], []
        for side, path in ((0, self.paths[0]), (1, self.paths[-1])):
            mine = [k for k, s in enumerate(self.side) if s == side and self.convs[k]]
            if mine:
                paths.append(path)
                sides.append(side)
                hung.append(np.array([[self.depth[k], self.convs[k], self.least[k], self.leaves[k], self.saved[k], self.kids[k]]
                                      for k in mine], "<i8").tobytes())
                ends.append([self.end[k] for k in mine])
        return _rows(len(paths), kind=ITEM_ROW, block=np.full(len(paths), self.block), side=np.array(sides, np.int32),
                     path=paths, hung=hung, ends=ends)

    def links(self, origin: list[tuple[int, int]]) -> pa.Table:
        """Where the open nodes of the level below have gone: to a smallest member, or to an open node of this block."""
        found = [(*origin[p], int(self.hung[p][r, 0]), k) for p, r, k in self.placed if self.hung[p][r, 5]]
        node = np.array([f[3] for f in found], np.int64)
        side = np.array(self.side, np.int64)[node] if len(node) else node
        waits = side >= 0
        return _rows(len(found), kind=LINK_ROW, block=np.array([f[0] for f in found], np.int64),
                     side=np.array([f[1] for f in found], np.int32), at=np.array([f[2] for f in found], np.int64),
                     conv_id=pa.array([0 if w else self.least[k] for k, w in zip(node.tolist(), waits.tolist())], pa.int64(),
                                      mask=waits),
                     open_block=pa.array(np.full(len(node), self.block), mask=~waits),
                     open_side=pa.array(side.astype(np.int32), mask=~waits),
                     open_depth=pa.array(np.array([f[2] for f in found], np.int64), mask=~waits))


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
          "array<string>": pa.list_(pa.string())}
_FIELDS = {f.split()[0]: _ARROW[f.split()[1]] for f in LEVEL.split(", ")}


def _rows(n: int, kind: int, **columns) -> pa.Table:
    columns["kind"] = np.full(n, kind, np.int32)
    filled = []
    for name, t in _FIELDS.items():
        value = columns.get(name)
        filled.append(pa.nulls(n, t) if value is None else value.cast(t) if isinstance(value, pa.Array) else pa.array(value, t))
    return pa.Table.from_arrays(filled, names=list(_FIELDS))


# ------------------------------------------------------------------ levels
def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path, conv_id) to runs of at most CHUNK_IDS conversations with equal paths."""
    def out(path, ids):
        return pa.RecordBatch.from_pydict({
            "path": pa.array([path], pa.binary()), "first": pa.array([ids[0]], pa.int64()),
            "n": pa.array([len(ids)], pa.int64()), "ids": pa.array([",".join(map(str, ids)).encode()], pa.binary())})
    held, ids, done = None, [], []
    for b in batches:
        for path, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if path != held or len(ids) >= CHUNK_IDS:
                if ids:
                    done.append(out(held, ids))
                held, ids = path, []
            ids.append(conv)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            done = []
    if ids:
        yield out(held, ids)


def _distinct_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted runs to (path, hung, ends, origin), one for each distinct path; ids are hashed run by run."""
    path = None
    n = least = digest = None
    for b in batches:
        for p, first, count, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
            if p != path:
                if path is not None:
                    yield path, np.array([[len(path) // ENTRY, n, least, 0, 0, 0]], np.int64), [digest.hexdigest()], None
                path, n, least, digest = p, count, first, hashlib.sha256(ids)
            else:
                n += count
                digest.update(b"," + ids)
    if path is not None:
        yield path, np.array([[len(path) // ENTRY, n, least, 0, 0, 0]], np.int64), [digest.hexdigest()], None


def _contracted_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for path, hung, ends, block, side in zip(*(b.column(i).to_pylist() for i in range(5))):
            yield path, np.frombuffer(hung, "<i8").reshape(-1, 6), ends, (block, side)


def _level(sorted_rows: DataFrame, read, block_bytes: int, top: bool) -> DataFrame:
    """Forests of the blocks of sorted paths."""
    def run(batches):
        base, k, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def close():
            paths, hung, ends, origin = (list(x) for x in zip(*held))
            forest = Block(paths, hung, ends, base | k, top)
            tables = [forest.nodes()]
            if not top:
                tables.append(forest.contracted())
            if origin[0] is not None:
                tables.append(forest.links(origin))
            for t in tables:
                yield from t.to_batches(max_chunksize=1 << 16)
        for item in read(batches):
            if not top and size >= block_bytes and len(held) >= LEAST_ITEMS:
                yield from close()
                k, held, size = k + 1, [], 0
                release()
            held.append(item)
            size += len(item[0]) + 96 * len(item[1])
        if held:
            yield from close()
    return sorted_rows.mapInArrow(run, LEVEL)


def _placed(rows: DataFrame, known: DataFrame, out: list[str], fill: str) -> DataFrame:
    """``rows`` with ``fill`` set: at hand, or by the open node of the level above that they wait for."""
    waiting = (rows.where("open_block IS NOT NULL").drop(fill)
               .join(known.select(F.col("block").alias("open_block"), F.col("side").alias("open_side"),
                                  F.col("at").alias("open_depth"), F.col("conv_id").alias("_found")),
                     ["open_block", "open_side", "open_depth"], "left").withColumnRenamed("_found", fill))
    return rows.where("open_block IS NULL").select(out).unionByName(waiting.select(out))


def prefix_trie(paths: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Nodes of the trie over (conv_id, entries): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256."""
    spark = paths.sparkSession
    flat = paths.select(F.expr("unhex(array_join(transform(entries, e -> hex(e)), ''))").alias("path"), "conv_id")
    flat = stored(flat, "trie-paths")
    runs = stored(flat.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
                  .mapInArrow(_runs, "path binary, first bigint, n bigint, ids binary"), "trie-runs")
    levels = [stored(_level(runs.repartitionByRange("path").sortWithinPartitions("path", "first"), _distinct_paths,
                            block_bytes, False), "trie-level-0")]
    while True:
        items = levels[-1].where(F.col("kind") == ITEM_ROW).select("path", "hung", "ends", "block", "side")
        n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("path") + 2 * F.length("hung")), F.lit(0))).first()
        if not n:
            return spark.createDataFrame([], NODE)
        top = size <= block_bytes or n <= LEAST_ITEMS
        dealt = items.repartition(1) if top else items.repartitionByRange("path")
        levels.append(stored(_level(dealt.sortWithinPartitions("path"), _contracted_paths, block_bytes, top),
                             f"trie-level-{len(levels)}"))
        if top:
            break
    names = [f.split()[0] for f in NODE.split(", ")]
    out, known = None, None
    for level in reversed(levels):
        nodes = level.where(F.col("kind") == NODE_ROW)
        links = level.where(F.col("kind") == LINK_ROW).select("block", "side", "at", "conv_id", "open_block", "open_side", "open_depth")
        if known is None:
            done, known = nodes.select(names), links
        else:
            done = _placed(nodes, known, names, "parent_conv_id")
            known = _placed(links, known, ["block", "side", "at", "conv_id"], "conv_id")
        out = done if out is None else out.unionByName(done)
    return out


# ------------------------------------------------------------------ query
def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % 100 in place of its own; h = crc32(c) % 6."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    heads = (convs.where(F.col("conv_id") % 100 == 0)
             .select(F.col("conv_id").alias("_donor"), F.slice("entries", 1, 5).alias("_head")))
    own = convs.withColumn("_donor", F.col("conv_id") - F.col("conv_id") % 100).withColumn("_h", h)
    empty = F.array().cast("array<binary>")
    tail = F.when(F.size("entries") > F.col("_h"), F.expr("slice(entries, _h + 1, size(entries) - _h)")).otherwise(empty)
    head = F.expr("slice(_head, 1, _h)")
    return (own.join(heads, "_donor", "left")
            .select("conv_id", F.concat(F.coalesce(head, empty), tail).alias("entries")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = stored(sequences(table(spark, sf_dir, "conversations")), "conversations")
    return prefix_trie(rebuilt(convs))


_CRC32 = ("xor(list_reduce(list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: CAST('0x' || x AS BIGINT)), "
          "lambda crc, byte: list_reduce([xor(crc, byte), 1, 1, 1, 1, 1, 1, 1, 1], "
          "lambda c, one: xor(c >> 1, 3988292384 * (c & one))), 4294967295), 4294967295)")


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a SQL text expression of at least one character."""
    return _CRC32.format(text)


ORACLE_OP11 = f"""
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
                  length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
     own AS (SELECT conv_id, list({{'k': k, 'chars': chars}} ORDER BY turn NULLS FIRST, k, chars) AS turns FROM t GROUP BY conv_id),
     h AS (SELECT conv_id, turns, conv_id - conv_id % 100 AS donor,
                  CAST({crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS BIGINT) AS h FROM own),
     r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(d.turns, 1, h.h), []), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns
           FROM h LEFT JOIN own d ON d.conv_id = h.donor),
     p AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
     m AS (SELECT conv_id, n, depth, CASE WHEN depth = 0 THEN 0 ELSE turns[depth].chars END AS chars,
                  array_to_string(list_transform(list_slice(turns, 1, depth), lambda x: x.k), ',') AS key,
                  array_to_string(list_transform(list_slice(turns, 1, depth - 1), lambda x: x.k), ',') AS up FROM p),
     nodes AS (SELECT depth, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
                      (count(*) - 1) * any_value(chars) AS own_saved,
                      sha256(coalesce(string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), ''))
                        AS ends_sha256 FROM m GROUP BY depth, key),
     kids AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
     full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, key)),
     anc AS (SELECT unnest(range(0, depth + 1)) AS depth, key AS whole, own_saved, n_children FROM full_nodes),
     sums AS (SELECT depth, left(whole, greatest(65 * depth - 1, 0)) AS key, sum(own_saved) AS saved_tokens,
                     count(*) FILTER (n_children = 0) AS n_leaves FROM anc GROUP BY ALL)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s USING (depth, key) LEFT JOIN full_nodes u ON u.depth = f.depth - 1 AND u.key = f.up AND f.depth > 0
"""

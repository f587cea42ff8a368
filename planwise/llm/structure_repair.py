"""Operator 13: cheapest repair of conversation structure over a suffix-shared automaton.

Every row of a conversation becomes one letter for its role class and first
fault; a conversation becomes a *signature*.  Equal signatures of all
conversations collapse first.  Sorted from their ends, the distinct signatures
of a task form an automaton whose nodes are distinct suffixes: neighbours share
the nodes of the suffix they have in common, which is the minimal automaton as
each node spells one suffix.  A node is made once and holds, for each state of
the role grammar, the cost-to-go and the letter that begins the best audit.
At a state, Delete, Insert, Keep and Rerole lead to one state each, so of
equal costs the least letter begins the least audit, and the best audit suffix
is followed through the nodes instead of being copied into each.  Audits come
back to the conversations by a join on the signature, and the rows of each
conversation are repaired in one pass over their sorted stream.

Grammar of the repaired roles: ``(s?(ua)+)?`` over the initials.  Costs: Keep 0,
Rerole 1, Delete 2 (the only choice for blank and duplicate rows), Insert 5; a
truncated row that is not deleted adds 5.

Hot keys: signatures are pieced together from a range sort by conversation and
turn, so a conversation with a third of all rows spreads over many tasks; equal
signatures collapse before the shuffle; the join back broadcasts audits only up
to a checked size and is salted beyond it.  Only the repaired rows of one
conversation, whose text must be read in order, stream through one task, which
holds one row at a time.

Defined cases: null roles and texts are what the caller puts in their place
(the query: one space); rows come in order of (turn, null first; role; digest
of the text); of identical rows of a turn the first may stay; rows without a
conversation id are one conversation; conversations without rows have zeros and
an empty audit; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwise.llm.common import stored, table
from planwise.llm.prefix_trie import crc32_sql
from planwise.llm.turns import PLACE, digest, grouped_rows, per_row, plain_turns

SPACE = " \t\n\x0b\f\r"
CLASSES, FAULTS = "suao", ("", "blank", "duplicate", "truncated")
LETTERS = "ABCDEFGHIJKLMNOP"  # class * 4 + fault
FORCED = (2, 2, 3, 2)  # state after one more user or assistant turn, whichever the state asks for
ENDS = (True, False, False, True)
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
AUDIT_BYTES = 8 << 20
SALTS = 16


# ------------------------------------------------------------------ automaton
def _inserted(costs: list, letters: list) -> tuple[tuple, tuple]:
    """With insertions allowed before whatever comes next."""
    base = costs[:]
    for state in (2, 3, 0, 1):  # states 0 and 1 insert into 2
        to = FORCED[state]
        other = INSERT + (base[to] if state in (2, 3) else costs[to])
        if other < costs[state] or other == costs[state] and "I" < letters[state]:
            costs[state], letters[state] = other, "I"
    return tuple(costs), tuple(letters)


NEVER = 1 << 60
END = _inserted([0 if e else NEVER for e in ENDS], ["" if e else "~" for e in ENDS])


def node(letter: str, after: tuple[tuple, tuple]) -> tuple[tuple, tuple]:
    """Cost-to-go and first audit letter of each state before a row, given those after it."""
    kind, fault = divmod(LETTERS.index(letter), 4)
    initial, more = CLASSES[kind], TRUNCATED if FAULTS[fault] == "truncated" else 0
    costs, letters = [], []
    for state in range(4):
        best = (DELETE + after[0][state], "D")
        if FAULTS[fault] not in ("blank", "duplicate"):
            to = KEEP[state].get(initial)
            if to is not None:
                best = min(best, (more + after[0][to], "K"))
            best = min(best, (REROLE + more + after[0][FORCED[state]], "R"))
        costs.append(best[0])
        letters.append(best[1])
    return _inserted(costs, letters)


class SuffixAutomaton:
    """Nodes of the suffixes of one signature after another, read from the end; sorted ones share their nodes."""

    def __init__(self):
        self.spelled, self.nodes, self.made = "", [END], 0

    def read(self, reverse: str) -> tuple[int, str]:
        """Cost and audit of a signature given from its end."""
        low, high = 0, min(len(reverse), len(self.spelled))
        while low < high:  # letters shared with the signature before
            middle = (low + high + 1) // 2
            if reverse[low:middle] == self.spelled[low:middle]:
                low = middle
            else:
                high = middle - 1
        del self.nodes[low + 1:]
        for letter in reverse[low:]:
            self.nodes.append(node(letter, self.nodes[-1]))
        self.made += len(reverse) - low
        self.spelled = reverse
        return self.nodes[-1][0][0], self._follow()

    def _follow(self) -> str:
        at, state, audit = len(self.spelled), 0, []
        while at or not ENDS[state]:
            edit = self.nodes[at][1][state]
            audit.append(edit)
            if edit == "I":
                state = FORCED[state]
                continue
            at -= 1
            if edit == "K":
                state = KEEP[state][CLASSES[LETTERS.index(self.spelled[at]) // 4]]
            elif edit == "R":
                state = FORCED[state]
        return "".join(audit)


def _judged(batches) -> Iterator[tuple]:
    """Sorted reversed signatures to (signature, blank, duplicate, truncated, illegal, cost, audit)."""
    automaton = SuffixAutomaton()
    for b in batches:
        for reverse in b.column(0).to_pylist():
            cost, audit = automaton.read(reverse)
            signature = reverse[::-1]
            faults = [sum(signature.count(LETTERS[4 * c + f]) for c in range(4)) for f in (1, 2, 3)]
            initials = signature.translate(_INITIALS)
            pairs = len(signature) - 1 if signature else 0
            legal = initials.count("su") + initials.count("ua") + initials.count("au")
            yield (signature, *faults, pairs - legal, cost, audit)


_INITIALS = {ord(x): CLASSES[k // 4] for k, x in enumerate(LETTERS)}


def judged_signatures(signatures: DataFrame) -> DataFrame:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) of every distinct signature."""
    distinct = signatures.select(F.reverse("signature").alias("reverse")).distinct()
    return per_row(distinct.repartitionByRange("reverse").sortWithinPartitions("reverse"), _judged,
                   "signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


# ------------------------------------------------------------------ signatures
def _faulty_rows(turns: DataFrame) -> DataFrame:
    """(place columns, class, blank, cut): what the faults of a row hang on, without its text."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    first = F.substring("role", 1, 1)
    return turns.select("conv_id", "turn", "role", digest().alias("digest"),
                        F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o")).alias("class"),
                        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))


def _pieces(batches) -> Iterator[tuple]:
    """Sorted rows to (conv_id, part of the signature), one for each run of a conversation."""
    conv, letters, held, place = None, [], None, TaskContext.get().partitionId()
    for _, fresh, row in grouped_rows(batches, "conv_id"):
        if fresh:
            if letters:
                yield conv, place, "".join(letters)
            conv, letters, held = row["conv_id"], [], None
        here = (row["turn"], row["digest"])
        again = row["repeats"] and (here == held or row["first_turn"] != row["turn"])
        fault = 1 if row["blank"] else 2 if again else 3 if row["cut"] else 0
        letters.append(LETTERS[4 * CLASSES.index(row["class"]) + fault])
        held = here
    if letters:
        yield conv, place, "".join(letters)


def signatures(turns: DataFrame) -> DataFrame:
    """(conv_id, signature) of each conversation."""
    rows = _faulty_rows(turns)
    keys = [F.col("conv_id").alias("_c"), F.col("digest").alias("_d")]
    twice = (rows.groupBy(*keys).agg(F.min(F.struct("turn")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
             .select("_c", "_d", F.col("_first.turn").alias("first_turn"), F.lit(True).alias("repeats")))
    known = (rows.join(twice, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")), "left")
             .select("conv_id", "turn", "role", "digest", "class", "blank", "cut", "first_turn",
                     F.coalesce("repeats", F.lit(False)).alias("repeats")))
    pieces = per_row(known.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE), _pieces,
                     f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place int, piece string")
    return (pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("p"))
            .select("conv_id", F.array_join("p.piece", "").alias("signature")))


def turn_gaps(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps): turn numbers that are missing between a conversation's first and last."""
    return (turns.select("conv_id", "turn").distinct().groupBy("conv_id")
            .agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps")))


def _with_audits(convs: DataFrame, judged: DataFrame) -> DataFrame:
    """``convs`` with what is known of their signatures, many of which are equal."""
    size = judged.agg(F.coalesce(F.sum(2 * F.length("signature") + F.length("audit") + 80), F.lit(0))).first()[0]
    if size <= AUDIT_BYTES:
        return convs.join(F.broadcast(judged), "signature")
    salted = convs.withColumn("_salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    copies = judged.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["signature", "_salt"]).drop("_salt")


# ------------------------------------------------------------------ repair
def diagnose(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of plain turns."""
    convs = stored(signatures(turns), "signatures")
    judged = stored(judged_signatures(convs), "judged-signatures")
    gaps = turn_gaps(turns).withColumnRenamed("conv_id", "_c")
    return (_with_audits(convs, judged).join(gaps, F.col("conv_id").eqNullSafe(F.col("_c")))
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))


def _repaired(batches) -> Iterator[tuple]:
    """Each conversation's audit row and then its rows in order to its repaired turns."""
    conv, audit, state, at, place = None, "", 0, 0, 0

    def inserts():
        nonlocal state, at, place
        while at < len(audit) and audit[at] == "I":
            yield conv, place, None, "assistant" if state == 2 else "user", "", "I"
            state, at, place = FORCED[state], at + 1, place + 1
    for _, _, row in grouped_rows(batches, "conv_id"):
        if row["audit"] is not None:
            yield from inserts()
            conv, audit, state, at, place = row["conv_id"], row["audit"], 0, 0, 0
            continue
        yield from inserts()
        edit, role = audit[at], row["role"]
        at += 1
        if edit == "D":
            continue
        if edit == "R":
            role, state = "assistant" if state == 2 else "user", FORCED[state]
        else:
            state = KEEP[state][role[0]]
        yield conv, place, row["turn"], role, row["text"], edit
        place += 1
    yield from inserts()


def repair(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): repaired turns.  A conversation's turns lie in one partition, in order."""
    id_type = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("bigint").alias("turn"), "role",
                        digest().alias("digest"), "text", F.lit(None).cast("string").alias("audit"))
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
                         F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"), "audit")
    both = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return per_row(both, _repaired, f"conv_id {id_type}, place bigint, turn bigint, role string, text string, edit string")


def _digests(batches) -> Iterator[tuple]:
    conv, h = None, None
    for key, fresh, row in grouped_rows(batches, "conv_id"):
        if fresh:
            if h:
                yield conv, h.hexdigest()
            conv, h = key, hashlib.sha256()
        else:
            h.update(b"\n")
        h.update(f"{row['role']}:".encode())
        h.update(row["text"].encode())
    if h:
        yield conv, h.hexdigest()


# ------------------------------------------------------------------ query
def damaged(turns: DataFrame) -> DataFrame:
    """Plain turns with the faults that crc32(conv_id:turn) % 20 asks for."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hurt = turns.withColumn("_hurt", F.crc32(key.cast("binary")) % 20).where("_hurt <> 0")
    return hurt.select("conv_id", "turn", F.when(F.col("_hurt") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(F.col("_hurt") == 1, F.lit("")).when(F.col("_hurt") == 2, F.translate("text", ".!?", ""))
                       .otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("_hurt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_k")).drop("_k")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = plain_turns(table(spark, sf_dir, "conversations"), null=" ")
    turns = damaged(whole)
    found = stored(diagnose(turns), "diagnosed")
    id_type = whole.schema["conv_id"].dataType.simpleString()
    hashed = per_row(repair(turns, found), _digests, f"conv_id {id_type}, repaired_sha256 string")
    all_ids = whole.select("conv_id").distinct()
    facts, texts = found.withColumnRenamed("conv_id", "_f"), hashed.withColumnRenamed("conv_id", "_h")
    out = (all_ids.join(facts, F.col("conv_id").eqNullSafe(F.col("_f")), "left")
           .join(texts, F.col("conv_id").eqNullSafe(F.col("_h")), "left"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


_PLACE_SQL = "(PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), k)"


def _least(options: list[tuple[str, str, str]]) -> str:
    """SQL of the best (cost, audit) among (condition, cost, audit) triples as a struct."""
    parts = [f"CASE WHEN {c} THEN {{'c': {cost}, 'a': {audit}}} END" for c, cost, audit in options]
    return f"list_min(list_filter([{', '.join(parts)}], lambda o: o IS NOT NULL))"


def _step_sql(state: int) -> str:
    keep = {0: "CASE r.i WHEN 's' THEN x.s1 WHEN 'u' THEN x.s2 END", 1: "CASE r.i WHEN 'u' THEN x.s2 END",
            2: "CASE r.i WHEN 'a' THEN x.s3 END", 3: "CASE r.i WHEN 'u' THEN x.s2 END"}[state]
    to = f"x.s{FORCED[state]}"
    return _least([("TRUE", f"2 + x.s{state}.c", f"'D' || x.s{state}.a"),
                   (f"NOT r.gone AND ({keep}) IS NOT NULL", f"r.more + ({keep}).c", f"'K' || ({keep}).a"),
                   ("NOT r.gone", f"1 + r.more + {to}.c", f"'R' || {to}.a")])


def _insert_sql(prefix: str) -> str:
    """States with an insertion before what comes next, from the states without one."""
    two = _least([("TRUE", "b2.c", "b2.a"), ("TRUE", "5 + b3.c", "'I' || b3.a")])
    three = _least([("TRUE", "b3.c", "b3.a"), ("TRUE", "5 + b2.c", "'I' || b2.a")])
    zero, one = (_least([("TRUE", f"b{s}.c", f"b{s}.a"), ("TRUE", "5 + b2.c", "'I' || b2.a"),
                         ("TRUE", "10 + b3.c", "'II' || b3.a")]) for s in (0, 1))
    return f"SELECT {prefix}, {zero} AS s0, {one} AS s1, {two} AS s2, {three} AS s3"


ORACLE_OP13 = rf"""
WITH RECURSIVE w AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS hurt
                  FROM conversations),
     d AS (SELECT conv_id, turn, CASE WHEN hurt = 4 THEN 'user' ELSE role END AS role,
                  CASE hurt WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                  unnest(CASE WHEN hurt = 3 THEN [0, 1] ELSE [0] END) AS k FROM w WHERE hurt <> 0),
     o AS (SELECT *, row_number() OVER {_PLACE_SQL} AS pos,
                  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) AS seen,
                  right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last FROM d),
     f AS (SELECT *, left(role, 1) AS i, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                  WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
     facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (pos > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
     r AS (SELECT conv_id, pos, i, role, text, fault IN ('blank', 'duplicate') AS gone,
                  CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM f),
     dp AS (SELECT conv_id, n AS pos, {{'c': 0, 'a': ''}} AS s0, {{'c': 10, 'a': 'II'}} AS s1, {{'c': 5, 'a': 'I'}} AS s2,
                   {{'c': 0, 'a': ''}} AS s3 FROM facts
            UNION ALL
            {_insert_sql("conv_id, pos")} FROM (
              SELECT x.conv_id, x.pos - 1 AS pos, {_step_sql(0)} AS b0, {_step_sql(1)} AS b1, {_step_sql(2)} AS b2, {_step_sql(3)} AS b3
              FROM dp x JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.pos = x.pos) steps),
     best AS (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM dp WHERE pos = 0),
     walk AS (SELECT conv_id, 0 AS taken, 0 AS pos, 0 AS state, CAST([] AS VARCHAR[]) AS lines, audit FROM best
              UNION ALL
              SELECT z.conv_id, z.taken + 1, z.pos + CASE WHEN z.e = 'I' THEN 0 ELSE 1 END,
                     CASE WHEN z.e = 'D' THEN z.state WHEN z.e = 'K' AND z.i = 's' THEN 1 WHEN z.state = 2 THEN 3 ELSE 2 END,
                     CASE z.e WHEN 'D' THEN z.lines WHEN 'I' THEN list_append(z.lines, z.forced || ':')
                       WHEN 'K' THEN list_append(z.lines, z.role || ':' || z.text) ELSE list_append(z.lines, z.forced || ':' || z.text) END,
                     z.audit
              FROM (SELECT y.*, substr(y.audit, y.taken + 1, 1) AS e, CASE WHEN y.state = 2 THEN 'assistant' ELSE 'user' END AS forced,
                           r.i, r.role, r.text FROM walk y LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM y.conv_id AND r.pos = y.pos + 1
                    WHERE y.taken < length(y.audit)) z),
     fixed AS (SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM walk WHERE taken = length(audit))
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM a.conv_id
"""

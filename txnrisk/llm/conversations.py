"""Repair of the structure of conversations: an optional system turn, then user and assistant in turn, ended by the assistant.

Every turn of a conversation is kept, given another role or deleted, and empty turns may be put in, at the smallest total cost; among the
cheapest repairs that with the smallest audit (the edits' initials in order) is taken. A partial repair has one integer as its weight: the high digits carry the
cost, the low digits hold one octal digit for each letter of the audit, from the left, and zeros up to a fixed width. Integers of this
form compare like (cost, audit), so an ordinary integer minimum over the paths of a small graph, turns by roles, decides everything.

Conversations are solved in one pass over rows sorted by conversation. Those of more turns or bytes than a task should hold
are cut into segments of turns; each segment's weights from every state to every state are found in tasks of their own, and only those are put
together, from the last segment to the first. Two equally cheap repairs of the same turns between the same states never have one audit as
the start of the other (the longer one would have cost more), so the best parts make the best whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import table, text_slices
from txnrisk.session import materialise

BLANKS = " \t\n\x0b\x0c\r"
#: Edits and their octal digits; the order of the digits is the order of the letters.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
_DECODE = str.maketrans("1234", "DIKR")
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after system, after user, after assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
#: The state after a user or assistant turn in each state, and that turn's role; nothing else may follow but a first system turn.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "user", "assistant", "user")
#: A conversation of more turns or bytes is cut into segments of so many turns (a power of two).
LONG_TURNS, LONG_BYTES, SEGMENT = 4_096, 32_000_000, 1_024
#: Bytes of text read at once.
SLICE_BYTES = 2_000_000

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, edit string, role string, text string"

#: (first letter of the role, whether the turn must go, whether it is cut short)
Turn = tuple[str, bool, bool]


def solve(turns: list[Turn], ends: Iterable[int] = ENDS) -> list[tuple[int, str] | None]:
    """(cost, audit) of the best repair from each state to one of the ends; None where there is none."""
    width = 3 * (3 * len(turns) + 2)  # at most two insertions before each turn and at the end pay
    top, shift, mask = 1 << width, width - 3, (1 << width) - 1
    never = top << 64

    def put(cost: int, letter: str, rest: int) -> int:
        """The weight of a repair that begins with this edit: its audit moves on by one digit."""
        low = rest & mask
        return rest - low + cost * top + (DIGIT[letter] << shift) + (low >> 3)

    def inserted(best: list[int]) -> list[int]:
        for _ in range(2):
            best = [min(best[s], put(INSERT, "I", best[NEXT[s]])) for s in range(4)]
        return best

    ends = set(ends)
    best = inserted([0 if s in ends else never for s in range(4)])
    for initial, gone, short in reversed(turns):
        after = [put(DELETE, "D", best[s]) for s in range(4)]
        if not gone:
            more = TRUNCATED if short else 0
            for s in range(4):
                after[s] = min(after[s], put(REROLE + more, "R", best[NEXT[s]]))
                if initial == ROLES[s][0]:
                    after[s] = min(after[s], put(more, "K", best[NEXT[s]]))
            if initial == "s":
                after[NONE] = min(after[NONE], put(more, "K", best[SYSTEM]))
        best = inserted(after)
    audits = [format(w & mask, f"0{width // 3}o").rstrip("0").translate(_DECODE) for w in best]
    return [None if w >= never else (w >> width, audit) for w, audit in zip(best, audits, strict=True)]


def replay(audit: str, initials: Iterable[str], state: int = NONE) -> Iterator[tuple[str, str | None]]:
    """(edit, new role) of each edit; the role is None for deleted turns and for kept ones, which have their own."""
    initials = iter(initials)
    for edit in audit:
        initial = None if edit == "I" else next(initials)
        if edit == "D":
            yield edit, None
        elif edit == "K" and initial == "s":
            yield edit, None
            state = SYSTEM
        else:
            yield edit, None if edit == "K" else ROLES[state]
            state = NEXT[state]


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _marked(rows: list[tuple]) -> tuple[list[Turn], int, int, int]:
    """(turns, blank, duplicate, truncated) of a conversation's (turn, role, text) rows in order."""
    seen, turns, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        shown = text.rstrip(BLANKS)
        fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        turns.append((role[:1], fault in (0, 1), fault == 2))
    return turns, *counts


def repaired(rows: list[tuple]) -> tuple[tuple, list[tuple]]:
    """(report, turns) of one conversation's (turn, role, text) rows in order."""
    turns, blank, duplicate, truncated = _marked(rows)
    initials = [t[0] for t in turns]
    cost, audit = solve(turns)[NONE]
    left, own = [], iter(rows)
    for place, (edit, role) in enumerate(replay(audit, initials)):
        _, old, text = (None, None, "") if edit == "I" else next(own)
        if edit != "D":
            left.append((place, edit, role or old, text))
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text in left).encode()).hexdigest()
    report = (gaps, blank, duplicate, truncated, illegal_pairs(initials), cost, audit, digest)
    return report, left


def _order(*first: str) -> list:
    return [*first, F.asc_nulls_first("turn"), "role", "text"]


def _given(turns: DataFrame) -> DataFrame:
    """Only the columns used; null roles and texts count as one space."""
    blank = F.lit(" ")
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))


def _split(turns: DataFrame, long_turns: int, long_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """(turns of ordinary conversations, turns of long ones or None)."""
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = materialise(size.filter((F.col("n") > long_turns) | (F.col("bytes") > long_bytes)).select(F.col("conv_id").alias("long_id")), "conv-long")
    if long.isEmpty():
        return turns, None
    same = turns["conv_id"].eqNullSafe(long["long_id"])
    return turns.join(long, same, "left_anti"), turns.join(long, same, "left_semi")


def _schema(conv: T.StructField, more: str) -> T.StructType:
    return T.StructType([conv, *T.StructType.fromDDL(more)])


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]


def _batches(schema: T.StructType, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded length."""
    kinds, held = [_arrow(f.dataType) for f in schema], []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.fieldNames())

    for row in rows:
        held.append(row)
        if len(held) == 500:
            yield batch()
            held = []
    if held:
        yield batch()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _passed(turns: DataFrame, each: bool) -> DataFrame:
    """Reports (or, with `each`, repaired turns) of conversations that fit a task, by one sorted pass."""
    schema = _schema(turns.schema["conv_id"], TURNS if each else REPORT)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for part in text_slices(batch, SLICE_BYTES):
                    yield from zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True)

        def solved():
            for conv, own in groupby(rows(), key=lambda r: r[0]):
                report, left = repaired([r[1:] for r in own])
                yield from ((conv, *turn) for turn in left) if each else [(conv, *report)]

        yield from _batches(schema, solved())

    return turns.repartition("conv_id").sortWithinPartitions(*_order("conv_id")).mapInArrow(repair, schema)


class LongConversations:
    """Repair of conversations that no task should hold; see the module's docstring.

    Rows get their order from a range partitioning by (conversation, turn, role, text), ties dealt by their place in the input: a conversation may lie in
    any number of partitions. Only the reported cells themselves (an audit) and the running hash of a repaired text belong to one task.
    """

    def __init__(self, turns: DataFrame):
        self.conv = turns.schema["conv_id"]
        order = [*_order("conv_id"), "tie"]
        tied = turns.withColumn("tie", F.monotonically_increasing_id())
        placed = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
        self.placed = materialise(placed.withColumn("pos", F.monotonically_increasing_id()), "conv-placed")
        self.flagged = materialise(self._flagged(), "conv-flagged")
        self.paths = materialise(self._paths(self._matrices()), "conv-paths")

    def _flagged(self) -> DataFrame:
        shown = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
        same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
        initial = F.substring("role", 1, 1)
        rows = self.placed.select("conv_id", "turn", "pos", initial.alias("initial"), same.alias("same"), (shown == "").alias("blank"), F.substring(shown, -1, 1).isin(".", "!", "?").alias("ended"))
        # First turns of their role and text; a conversation may hold one of them any number of times.
        firsts = rows.groupBy("conv_id", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("fresh"))
        out = rows.join(firsts, "pos", "left")
        repeat = ~F.col("blank") & F.col("fresh").isNull()
        return out.select("conv_id", "turn", "pos", "initial", "blank", repeat.alias("repeat"), (~F.col("blank") & ~repeat & ~F.col("ended")).alias("short"))

    def _matrices(self) -> DataFrame:
        """conv_id, seg, pos (first), initials of the segment's turns, costs and audits from every state to every state."""
        schema = _schema(self.conv, "seg long, pos long, initials array<string>, costs array<long>, audits array<string>")
        seg = F.shiftright("pos", SEGMENT.bit_length() - 1)
        gone = F.col("blank") | F.col("repeat")
        rows = self.flagged.select("conv_id", seg.alias("seg"), "pos", "initial", gone.alias("gone"), "short")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def segments():
                for (conv, seg), own in groupby(_read(batches), key=lambda r: r[:2]):
                    own = list(own)
                    turns = [r[3:] for r in own]
                    ways = [solve(turns, [end]) for end in range(4)]
                    cells = [ways[end][start] or (None, None) for start in range(4) for end in range(4)]
                    yield conv, seg, own[0][2], [t[0] for t in turns], [c for c, _ in cells], [a for _, a in cells]

            yield from _batches(schema, segments())

        return rows.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "pos").mapInArrow(cut, schema)

    def _paths(self, matrices: DataFrame) -> DataFrame:
        """conv_id, seg, pos, initials, state before the segment, its part of the audit, its cost and illegal pairs that end in it."""
        schema = _schema(self.conv, "seg long, pos long, initials array<string>, state int, audit string, cost long, illegal long")

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def paths():
                for conv, own in groupby(_read(batches), key=lambda r: r[0]):
                    own, chosen = list(own), []
                    best = [(0, "") if s in ENDS else None for s in range(4)]
                    for _, _, _, _, costs, audits in own:  # from the last segment to the first
                        ways = [
                            min(((costs[4 * s + e] + best[e][0], audits[4 * s + e] + best[e][1], e) for e in range(4) if best[e] and costs[4 * s + e] is not None), default=None)
                            for s in range(4)
                        ]
                        best = [w and w[:2] for w in ways]
                        chosen.append([w and w[2] for w in ways])
                    state, last = NONE, []
                    for row, ends in zip(reversed(own), reversed(chosen), strict=True):
                        _, seg, pos, initials, costs, audits = row
                        cell = 4 * state + ends[state]
                        yield conv, seg, pos, initials, state, audits[cell], costs[cell], illegal_pairs([*last, *initials])
                        state, last = ends[state], initials[-1:]

            yield from _batches(schema, paths())

        return matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg")).mapInArrow(fold, schema)

    def _edited(self) -> DataFrame:
        """The rows with their edit, new role (null: own), and the roles of turns put in before and after."""
        schema = T.StructType.fromDDL("pos long, edit string, new_role string, before array<string>, after array<string>")

        def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for pos, initials, state, audit in _read(batches):
                    before, own = [], []
                    for edit, role in replay(audit, initials, state):
                        if edit == "I":
                            before.append(role)
                        else:
                            own.append([pos + len(own), edit, role, before, []])
                            before = []
                    own[-1][4] = before
                    yield from map(tuple, own)

            yield from _batches(schema, rows())

        return self.placed.join(self.paths.select("pos", "initials", "state", "audit").mapInArrow(edits, schema), "pos")

    def turns(self) -> DataFrame:
        def put_in(roles: str):
            return F.transform(roles, lambda r: F.struct(F.lit("I").alias("edit"), r.alias("role"), F.lit("").alias("text")))

        own = F.struct("edit", F.coalesce("new_role", "role").alias("role"), "text")
        lines = F.concat(put_in("before"), F.when(F.col("edit") != "D", F.array(own)).otherwise(F.slice(F.array(own), 1, 0)), put_in("after"))
        rows = self._edited().select("conv_id", "pos", F.posexplode(lines).alias("nth", "line"))
        # Places grow with the order of the turns; unlike those of ordinary conversations they leave numbers out.
        return rows.select("conv_id", (F.col("pos") * 8 + F.col("nth")).alias("place"), "line.edit", "line.role", "line.text")

    def _hashes(self) -> DataFrame:
        schema = _schema(self.conv, "repaired_sha256 string")

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def lines():
                for batch in batches:
                    for part in text_slices(batch, SLICE_BYTES):
                        yield from zip(part.column("conv_id").to_pylist(), part.column("text").to_pylist(), strict=True)

            def hashes():
                for conv, own in groupby(lines(), key=lambda r: r[0]):
                    whole, first = hashlib.sha256(), True
                    for _, text in own:
                        whole.update(("" if first else "\n").encode() + text.encode())
                        first = False
                    yield conv, whole.hexdigest()

            yield from _batches(schema, hashes())

        rows = self.turns().select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("text"))
        return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "text").mapInArrow(digest, schema)

    def reports(self) -> DataFrame:
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0).cast("long"))
        flags = [F.count_if(c).alias(n) for c, n in (("blank", "blank"), ("repeat", "duplicate"), ("short", "truncated"))]
        counts = self.flagged.groupBy("conv_id").agg(gaps.alias("gaps"), *flags)
        parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda p: p["audit"]), "")
        paths = self.paths.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), parts.alias("audit"))
        # One row of each kind per conversation, null ids included.
        both = counts.unionByName(paths, allowMissingColumns=True).unionByName(self._hashes(), allowMissingColumns=True)
        names = [f.split()[0] for f in REPORT.split(", ")]
        out = both.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in names])
        return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def repair_reports(turns: DataFrame, long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken in order of turn (null first), role and text. Null roles and texts count as one space, a null conv_id is a conversation of its own, and turns
    without a number leave no gap. Repeated rows are duplicates of the first. Texts are read whole. An empty table gives an empty result. Only conv_id, turn,
    role and text are read, so other columns may have any name.
    """
    plain, long = _split(_given(turns), long_turns, long_bytes)
    out = _passed(plain, each=False)
    return out if long is None else out.unionByName(LongConversations(long).reports())


def repaired_turns(turns: DataFrame, long_turns: int = LONG_TURNS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired conversations: conv_id, place (their order), edit (K, R or I), role, text."""
    plain, long = _split(_given(turns), long_turns, long_bytes)
    out = _passed(plain, each=True)
    return out if long is None else out.unionByName(LongConversations(long).turns())


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults drawn by a checksum of `conv_id:turn`; nulls count as one space."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = _given(turns).withColumn("fault", F.pmod(F.crc32(name.cast("binary")), F.lit(20)))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    kept = rows.filter("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("copy"))
    return kept.drop("copy")


def op13_conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    found = repair_reports(damaged(turns))
    ids = turns.select(F.col("conv_id").alias("own_id")).distinct()
    whole = ids.join(found, ids["own_id"].eqNullSafe(found["conv_id"]), "left")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return whole.select(F.col("own_id").alias("conv_id"), *[F.coalesce(c, nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns[1:]])


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLE = {
    "op13_conversation_repair": r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
drawn AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(0, length(k) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ord(substr(k, i, 1)) END::UBIGINT),
         lambda c, b: xor(c >> 8, list_reduce(list_transform(range(0, 9), lambda j: CASE WHEN j = 0 THEN xor(c, b) & 255 ELSE 0 END::UBIGINT),
                                         lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))), 4294967295::UBIGINT) % 20 AS f FROM given),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn WHERE f <> 0),
placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM damaged),
marked AS (
  SELECT conv_id, turn, role, text, i, ending = '' AS blank, ending <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, ending, left(role, 1) AS r,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
turns AS (SELECT *, NOT blank AND NOT dup AND ending NOT IN ('.', '!', '?') AS short FROM marked),
totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
         count(*) FILTER (short) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM turns GROUP BY conv_id),
puts(s, t, c, a, l) AS (
  SELECT * FROM (VALUES ('', '', 0, '', []::VARCHAR[]), ('', 'u', 2, 'I', ['user:']), ('', 'a', 4, 'II', ['user:', 'assistant:']),
                        ('s', 's', 0, '', []), ('s', 'u', 2, 'I', ['user:']), ('s', 'a', 4, 'II', ['user:', 'assistant:']),
                        ('u', 'u', 0, '', []), ('u', 'a', 2, 'I', ['assistant:']), ('u', 'u', 4, 'II', ['assistant:', 'user:']),
                        ('a', 'a', 0, '', []), ('a', 'u', 2, 'I', ['user:']), ('a', 'a', 4, 'II', ['user:', 'assistant:'])) v(s, t, c, a, l)),
steps(s, t, role) AS (SELECT * FROM (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')) v(s, t, role)),
ways(conv_id, i, s, v) AS (
  SELECT conv_id, 0::BIGINT, '', {'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]} FROM totals
  UNION ALL
  SELECT conv_id, i, s, min(v) FROM (
    SELECT w.conv_id, x.i, e.s, {'c': w.v.c + p.c + e.c, 'a': w.v.a || p.a || e.a, 'l': w.v.l || p.l || e.l} AS v
    FROM ways w JOIN turns x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1 JOIN puts p ON p.s = w.s JOIN LATERAL (
      SELECT p.t AS s, 3 AS c, 'D' AS a, []::VARCHAR[] AS l
      UNION ALL SELECT steps.t, 2 + x.short::INT, 'R', [steps.role || ':' || x.text] FROM steps WHERE steps.s = p.t AND NOT x.blank AND NOT x.dup
      UNION ALL SELECT steps.t, x.short::INT, 'K', [x.role || ':' || x.text] FROM steps WHERE steps.s = p.t AND NOT x.blank AND NOT x.dup AND x.r = left(steps.role, 1)
      UNION ALL SELECT 's', x.short::INT, 'K', [x.role || ':' || x.text] WHERE p.t = '' AND NOT x.blank AND NOT x.dup AND x.r = 's') e ON true)
  GROUP BY conv_id, i, s),
best AS (
  SELECT w.conv_id, min({'c': w.v.c + p.c, 'a': w.v.a || p.a, 'l': w.v.l || p.l}) AS v
  FROM ways w JOIN totals USING (conv_id) JOIN puts p ON p.s = w.s WHERE w.i = totals.n AND p.t IN ('', 'a') GROUP BY w.conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(v.c, 0) AS cost, coalesce(v.a, '') AS audit, sha256(coalesce(array_to_string(v.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN totals USING (conv_id) LEFT JOIN best USING (conv_id)
""",
}

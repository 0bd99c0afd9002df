"""Repair of role structure: cheapest edits by a dynamic program with square-root checkpoints.

The roles of a conversation should read ``(s?(ua)+)?`` by their initials.  A state
says what the rows so far end with; its backward cost is that of the cheapest edits
of the rows still to come.  The rows of a conversation pass through a task in order
and are never held together:

1. Backward: the rows from the last to the first update one vector of four costs.
   Every ``stride`` rows the vector is kept; once there are more vectors than that,
   every other one goes and the stride doubles, so that both stay near the square
   root of the number of rows.
2. Forward: the rows come again from the first on, with the kept vectors.  Of one
   block of ``stride`` rows at a time the vectors are computed anew, and the walk
   takes the edit that is least in ASCII among those whose costs are tight.

Duplicates are found before by a window over equal rows, so no task remembers the
texts of a conversation.  The audit and the digest of the repaired text are one
value per conversation over its rows in order, which is why one task sees all rows
of a conversation; it holds one block of them, the vectors and the audit.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STRIDE = 32
#: States: nothing yet, after s, after u, after a.
_REPLY = (2, 2, 3, 2)  # state after the role that a reroled or inserted row takes
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_NAMES = {2: "user", 3: "assistant"}
_END = (0, 2 * INSERT, INSERT, 0)
_SPACE = "\t\n\x0b\x0c\r "
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
OUTPUT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) after the planted damage; null roles and texts are one space.

    By crc32 of ``conv_id:turn`` modulo 20 a row is dropped (0), emptied (1), robbed of
    its sentence ends (2), repeated (3) or given the role user (4).
    """
    number = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *number).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("__times"),
    )
    times = F.explode(F.sequence(F.lit(1), "__times"))
    return rows.filter("__times > 0").select("conv_id", "turn", "role", "text", times.alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` (blank, duplicate, truncated or null: the first that applies) and ``tie``, the order of rows of one turn."""
    bare = F.rtrim("text", F.lit(_SPACE))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    fault = (
        F.when(bare == "", "blank").when(again, "duplicate")
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return rows.withColumn("fault", fault).withColumn("tie", F.concat_ws(":", "role", F.md5("text")))


@lru_cache(maxsize=100_000)
def _before(after: tuple[int, int, int, int], initial: str, fault: str | None) -> tuple[int, int, int, int]:
    """Costs in front of a row, by state, from those behind it."""
    least = []
    for state in range(4):
        best = DELETE + after[state]
        if fault not in ("blank", "duplicate"):
            extra = TRUNCATED if fault == "truncated" else 0
            best = min(best, REROLE + extra + after[_REPLY[state]])
            if state in _KEEP.get(initial, ()):
                best = min(best, extra + after[_KEEP[initial][state]])
        least.append(best)
    least[2], least[3] = min(least[2], INSERT + least[3]), min(least[3], INSERT + least[2])
    return min(least[0], INSERT + least[2]), min(least[1], INSERT + least[2]), least[2], least[3]


def costs_before(after: tuple[int, int, int, int], initial: str, fault: str | None) -> tuple[int, int, int, int]:
    """As ``_before``, for costs of any height: only their differences are remembered."""
    low = min(after)
    return tuple(c + low for c in _before(tuple(c - low for c in after), initial, fault))


class Marks:
    """Backward costs at every ``stride``-th row from the end, about as many as the stride is long."""

    def __init__(self):
        self.n, self.stride, self.now, self.kept = 0, STRIDE, _END, [_END]

    def add(self, initial: str, fault: str | None) -> None:
        self.now = costs_before(self.now, initial, fault)
        self.n += 1
        if self.n % self.stride == 0:
            self.kept.append(self.now)
            if len(self.kept) > self.stride:
                self.kept, self.stride = self.kept[::2], 2 * self.stride


class Walk:
    """Forward walk over the rows of one conversation, block by block."""

    def __init__(self, n: int, stride: int, kept: list[tuple[int, int, int, int]]):
        self.left, self.stride, self.kept = n, stride, kept
        self.state, self.cost, self.block, self.audit = 0, None, [], []
        self.sha, self.rows_out = hashlib.sha256(), 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.last, self.low, self.turn, self.turns = 0, None, None, None, 0

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.turn, self.turns = turn, self.turns + 1
        self.block.append((role, text, fault))
        self.left -= 1
        if self.left % self.stride == 0:
            self._emit()

    def _emit(self) -> None:
        costs = [self.kept[self.left // self.stride]]
        for role, _, fault in reversed(self.block):
            costs.append(costs_before(costs[-1], role[:1], fault))
        costs.reverse()
        self.cost = costs[0][0] if self.cost is None else self.cost
        for i, (role, text, fault) in enumerate(self.block):
            here, after = costs[i], costs[i + 1]
            bound = fault in ("blank", "duplicate")
            extra = TRUNCATED if fault == "truncated" else 0
            while True:
                if DELETE + after[self.state] == here[self.state]:
                    self.audit.append("D")
                    break
                nearer = _REPLY[self.state]
                if INSERT + here[nearer] == here[self.state]:
                    self._out("I", nearer, _NAMES[nearer], "")
                    continue
                kept = _KEEP.get(role[:1], {}).get(self.state)
                if not bound and kept is not None and extra + after[kept] == here[self.state]:
                    self._out("K", kept, role, text)
                else:
                    self._out("R", nearer, _NAMES[nearer], text)
                break
        self.block = []

    def _out(self, edit: str, state: int, role: str, text: str) -> None:
        self.audit.append(edit)
        self.state = state
        line = f"{role}:{text}" if not self.rows_out else f"\n{role}:{text}"
        self.sha.update(line.encode("utf-8", "surrogatepass"))
        self.rows_out += 1

    def result(self) -> list:
        while _END[self.state]:
            nearer = _REPLY[self.state]
            self._out("I", nearer, _NAMES[nearer], "")
        gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
        return [gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()]


def _by_conversation(batches, columns: list[str]):
    """(conv_id, rows) of a stream sorted by conversation; the rows come as they are read."""
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        yield from zip(ids, zip(*[batch.column(c).to_pylist() for c in columns]))


def _marked(kind: str):
    def run(batches):
        marks, own, out = None, None, []

        def table(rows):
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (kind, pa.int64(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n", "stride", "marks"])

        for conv, (initial, fault) in _by_conversation(batches, ["initial", "fault"]):
            if marks is None or conv != own:
                if marks is not None:
                    out.append((own, marks.n, marks.stride, [c for m in marks.kept for c in m]))
                marks, own = Marks(), conv
                if len(out) >= 10_000:
                    yield table(out)
                    out = []
            marks.add(initial, fault)
        if marks is not None:
            out.append((own, marks.n, marks.stride, [c for m in marks.kept for c in m]))
        yield table(out)

    return run


def _walked(kind: str):
    def run(batches):
        walk, own, out = None, None, []

        def table(rows):
            columns = list(zip(*rows)) or [()] * 9
            kinds = (kind, *[pa.int64()] * 6, pa.string(), pa.string())
            names = ["conv_id", *[c.split()[0] for c in OUTPUT.split(", ")]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for conv, (n, stride, marks, turn, role, text, fault) in _by_conversation(
            batches, ["n", "stride", "marks", "turn", "role", "text", "fault"]
        ):
            if n is not None:  # the marks come before the rows
                if walk is not None:
                    out.append([own, *walk.result()])
                    if len(out) >= 10_000:
                        yield table(out)
                        out = []
                walk, own = Walk(n, stride, [tuple(marks[i: i + 4]) for i in range(0, len(marks), 4)]), conv
            else:
                walk.add(turn, role, text, fault)
        if walk is not None:
            out.append([own, *walk.result()])
        yield table(out)

    return run


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text, copy): gaps, faults, cost, audit and digest of the repair.

    The rows of a conversation are taken by turn, those without one first; of one turn
    by role and the MD5 of the text.  Roles and texts are not null.  An empty role has
    no initial and fits nowhere.  A null conv_id is a conversation like any other.
    """
    held = materialised(faults(rows))
    arrow = pa.int64() if dict(held.dtypes)["conv_id"] == "bigint" else pa.string()
    kind = "bigint" if arrow == pa.int64() else "string"
    held = held.withColumn("conv_id", F.col("conv_id").cast(kind))
    back = held.select("conv_id", "turn", "tie", "copy", F.substring("role", 1, 1).alias("initial"), "fault")
    back = back.repartition("conv_id").sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("tie"), F.desc("copy"))
    marks = materialised(
        back.select("conv_id", "initial", "fault").mapInArrow(_marked(arrow), f"conv_id {kind}, n bigint, stride bigint, marks array<bigint>")
    )
    both = held.withColumn("part", F.lit(1)).unionByName(marks.withColumn("part", F.lit(0)), allowMissingColumns=True)
    forward = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "tie", "copy")
    return forward.select("conv_id", "n", "stride", "marks", "turn", "role", "text", "fault").mapInArrow(
        _walked(arrow), f"conv_id {kind}, {OUTPUT}"
    )


def repair(conversations: DataFrame) -> DataFrame:
    """``repaired`` over the damaged rows, for every original conv_id; without a row all is zero or empty."""
    found = repaired(damaged(conversations))
    ids = conversations.select(F.col("conv_id").alias("__id")).distinct()
    out = ids.join(found, ids["__id"].eqNullSafe(found["conv_id"].cast(ids.schema["__id"].dataType)), "left")
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(_EMPTY_SHA)}
    return out.select(
        F.col("__id").alias("conv_id"),
        *[F.coalesce(n, empty.get(n, F.lit(0).cast("bigint"))).alias(n) for n in names],
    )


#: DuckDB twin of ``repair`` over conversations: a forward program that keeps, per state, the
#: least (cost, audit) of all rows so far.  CRC-32 is spelled out, DuckDB has none.
SQL = r"""
WITH RECURSIVE bits(i, k, v) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''),
                          lambda c: CAST(ord(c) AS BIGINT)) AS codes
    FROM conversations),
kinds AS (
    SELECT conv_id, turn, role, text,
           xor(list_reduce(codes, lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
    FROM keyed, crc),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds),
cut AS (
    SELECT *, rtrim(text, concat(chr(9), chr(10), chr(11), chr(12), chr(13), ' ')) AS bare,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, concat(role, ':', md5(text)), copy) AS i
    FROM damaged),
faults AS (
    SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
           CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated'
                ELSE 'none' END AS fault
    FROM cut),
facts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (before IS NOT NULL AND concat(before, initial) NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faults)
    GROUP BY conv_id),
steps(st, op, initial, nxt, role, cost) AS (
    VALUES (0, 'D', NULL, 0, NULL, 2), (1, 'D', NULL, 1, NULL, 2), (2, 'D', NULL, 2, NULL, 2), (3, 'D', NULL, 3, NULL, 2),
           (0, 'K', 's', 1, NULL, 0), (0, 'K', 'u', 2, NULL, 0), (1, 'K', 'u', 2, NULL, 0), (3, 'K', 'u', 2, NULL, 0),
           (2, 'K', 'a', 3, NULL, 0),
           (0, 'R', NULL, 2, 'user', 1), (1, 'R', NULL, 2, 'user', 1), (3, 'R', NULL, 2, 'user', 1), (2, 'R', NULL, 3, 'assistant', 1)),
inserts(st, nxt, edits, lines, cost) AS (
    VALUES (0, 0, '', NULL, 0), (1, 1, '', NULL, 0), (2, 2, '', NULL, 0), (3, 3, '', NULL, 0),
           (0, 2, 'I', 'user:', 5), (1, 2, 'I', 'user:', 5), (3, 2, 'I', 'user:', 5), (2, 3, 'I', 'assistant:', 5),
           (0, 3, 'II', concat('user:', chr(10), 'assistant:'), 10), (1, 3, 'II', concat('user:', chr(10), 'assistant:'), 10),
           (2, 2, 'II', concat('assistant:', chr(10), 'user:'), 10)),
best(conv_id, i, st, cost, audit, lines) AS (
    SELECT f.conv_id, CAST(0 AS BIGINT), n.nxt, CAST(n.cost AS BIGINT), n.edits, n.lines
    FROM facts f, inserts n WHERE n.st = 0
    UNION ALL
    SELECT conv_id, i, st, cost, audit, lines FROM (
        SELECT b.conv_id, b.i + 1 AS i, n.nxt AS st,
               b.cost + s.cost + n.cost + CASE WHEN f.fault = 'truncated' AND s.op <> 'D' THEN 5 ELSE 0 END AS cost,
               concat(b.audit, s.op, n.edits) AS audit,
               nullif(concat_ws(chr(10), b.lines, CASE WHEN s.op <> 'D' THEN concat(coalesce(s.role, f.role), ':', f.text) END,
                                n.lines), '') AS lines
        FROM best b
        JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1
        JOIN steps s ON s.st = b.st AND (s.op = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (s.op <> 'K' OR s.initial = f.initial)
        JOIN inserts n ON n.st = s.nxt)
    QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
done AS (
    SELECT f.*, b.cost, b.audit, b.lines
    FROM facts f JOIN best b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = f.n AND b.st IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY f.conv_id ORDER BY b.cost, b.audit) = 1)
SELECT c.conv_id, coalesce(d.gaps, 0) AS gaps, coalesce(d.blank, 0) AS blank, coalesce(d.duplicate, 0) AS duplicate,
       coalesce(d.truncated, 0) AS truncated, coalesce(d.illegal, 0) AS illegal, CAST(coalesce(d.cost, 0) AS BIGINT) AS cost,
       coalesce(d.audit, '') AS audit,
       sha256(coalesce(d.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""

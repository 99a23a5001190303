"""Cheapest repair of a conversation's structure by a scan of min-plus matrices.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Every row may be kept (0),
given the role user or assistant (3), or deleted (4); an empty turn of either role may be
inserted anywhere (3); a truncated row that stays costs 3 more; blank rows and repeats of an
earlier row must be deleted. Over the states "nothing yet, after s, after u, after a" a row is a
4 x 4 matrix of (cost, audit) elements, closed under insertions before it; elements are added by
the lesser (cost, then audit in ASCII order) and multiplied by adding costs and joining audits.
The product is associative, so rows are multiplied in segments of ``SEGMENT`` neighbours,
pairwise, and segments in a tree of fan-in ``FAN``: no conversation, however long, is
one task's work. Copies of one row are one row with a count; their matrix is a power.

The chosen audit is then cut into pieces and read back as edits, each joined to its row.

Two things are sequential by what they are: an audit is one value of one row (and up to 16 of its
parts' length while segments are joined), and the digest of a repaired conversation is one stream,
which one task reads row by row in constant memory.

Edge cases: a null role or text is one space; a null conv_id is a conversation of its own. Rows go
by turn, nulls first, then by role and text (UTF-8 order), so ties have one order and repeated rows are
adjacent. An empty role has no initial. Very long texts take part by their digests and flags and
are moved only to be written. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, ship

#: Rows of a segment (a power of two), segments joined by one task, letters of an audit read together.
SEGMENT = 4096
FAN = 16
PIECE = 4096

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK_CHARS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {"su", "ua", "au"}
INITIALS = ("s", "u", "a")
#: Where a row of an initial leads from a state, if it may stand there.
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}

Element = tuple[int, str] | None
Matrix = list[Element]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: best way through ``a``, then ``b``."""
    out: Matrix = [None] * 16
    for i in range(0, 16, 4):
        for k in range(4):
            x = a[i + k]
            if x is None:
                continue
            for j in range(4):
                y = b[4 * k + j]
                if y is not None:
                    both = (x[0] + y[0], x[1] + y[1])
                    if out[i + j] is None or both < out[i + j]:
                        out[i + j] = both
    return out


def plus(a: Matrix, b: Matrix) -> Matrix:
    return [min((x for x in xs if x is not None), default=None) for xs in zip(a, b, strict=True)]


ONE: Matrix = [(0, "") if i == j else None for i in range(4) for j in range(4)]


def _arcs(*arcs: tuple[int, int, Element]) -> Matrix:
    out: Matrix = [None] * 16
    for i, j, e in arcs:
        out = plus(out, [e if at == 4 * i + j else None for at in range(16)])
    return out


_INSERTED = _arcs(*((i, NEXT[r][i], (INSERT, "I")) for r in "ua" for i in NEXT[r]))
#: Any number of insertions; more than two never lead anywhere more cheaply.
CLOSURE = plus(plus(ONE, _INSERTED), times(_INSERTED, _INSERTED))

MUST_GO, CUT_OFF, FINE = range(3)


def _turn(kind: int) -> Matrix:
    """The matrix of one row; ``kind`` is 3 * initial (3: any other) + its state."""
    initial, state = divmod(kind, 3)
    own = _arcs(*((i, i, (DELETE, "D")) for i in range(4)))
    if state != MUST_GO:
        more = TRUNCATED if state == CUT_OFF else 0
        if initial < 3:
            own = plus(own, _arcs(*((i, j, (more, "K")) for i, j in NEXT[INITIALS[initial]].items())))
        own = plus(own, _arcs(*((i, NEXT[r][i], (REROLE + more, "R")) for r in "ua" for i in NEXT[r])))
    return times(CLOSURE, own)


TURNS = [_turn(kind) for kind in range(12)]


def power(m: Matrix, n: int) -> Matrix:
    out = ONE
    while n:
        if n & 1:
            out = times(out, m)
        m, n = times(m, m) if n > 1 else m, n >> 1
    return out


def product(ms: list[Matrix]) -> Matrix:
    """Neighbours are multiplied pairwise, so that audits are copied a logarithmic number of times."""
    while len(ms) > 1:
        ms = [times(*ms[i : i + 2]) if i + 1 < len(ms) else ms[i] for i in range(0, len(ms), 2)]
    return ms[0] if ms else ONE


def answer(m: Matrix) -> tuple[int, str]:
    """Cost and audit of a whole conversation with this product."""
    done = times(m, CLOSURE)
    return min(e for e in (done[START], done[ASSISTANT]) if e is not None)


@dataclass
class Segment:
    """A run of neighbouring rows; ``head`` and ``tail`` are its first and last initials."""

    rows: int
    illegal: int
    head: str
    tail: str
    matrix: Matrix


def join(parts: list[Segment]) -> Segment:
    seams = sum(a.tail + b.head not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
    return Segment(sum(p.rows for p in parts), sum(p.illegal for p in parts) + seams, parts[0].head, parts[-1].tail, product([p.matrix for p in parts]))


def of_row(kind: int, copies: int, initial: str) -> Segment:
    matrix = TURNS[kind]
    if copies > 1:  # the others repeat the first
        matrix = times(matrix, power(TURNS[kind - kind % 3 + MUST_GO], copies - 1))
    return Segment(copies, copies - 1 if initial + initial not in LEGAL else 0, initial, initial, matrix)


_FIELDS = ["rows", "illegal", "head", "tail", "costs", "audits"]
_SCHEMA = "ck string, at long, rows long, illegal long, head string, tail string, costs array<long>, audits array<string>"


def _to_arrow(found: list[tuple[str, int, Segment]]) -> pa.RecordBatch:
    costs = [[e and e[0] for e in s.matrix] for _, _, s in found]
    audits = [[e and e[1] for e in s.matrix] for _, _, s in found]
    plain = [pa.array(x, t) for x, t in zip(zip(*((c, a, s.rows, s.illegal, s.head, s.tail) for c, a, s in found), strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
    return pa.RecordBatch.from_arrays([*plain, pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], ["ck", "at", *_FIELDS])


def _read(b: pa.RecordBatch, first: int) -> Iterator[Segment]:
    for *own, costs, audits in zip(*(b.column(first + i).to_pylist() for i in range(6)), strict=True):
        yield Segment(*own, [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)])


def _grouped(batches: Iterator[pa.RecordBatch], read, many: int = 512) -> Iterator[pa.RecordBatch]:
    """Join the runs of equal (ck, at) in a sorted stream; a run is held only while it lasts."""
    key, run, done, size = None, [], [], 0
    for b in batches:
        for ck, at, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), read(b), strict=True):
            if (ck, at) != key:
                if run:
                    done.append((*key, join(run)))
                    size += done[-1][2].rows
                key, run = (ck, at), []
                if len(done) >= many or size > 64 * SEGMENT:
                    yield _to_arrow(done)
                    done, size = [], 0
            run.append(part)
    if run:
        done.append((*key, join(run)))
    if done:
        yield _to_arrow(done)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _grouped(batches, lambda b: (of_row(*x) for x in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True)))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _grouped(batches, lambda b: _read(b, 3))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(s, *answer(s.matrix)) for s in _read(b, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.illegal for s, _, _ in found], pa.int64()), pa.array([c for _, c, _ in found], pa.int64()), pa.array([a for _, _, a in found], pa.string())], ["ck", "illegal", "cost", "audit"])


def _pieces(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """Slices of the audits, with the rows consumed and the turns kept before each."""
    for b in batches:
        for ck, audit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            letters = np.frombuffer(audit.encode(), np.uint8)
            kept = letters != ord("D")
            system = bool(kept.sum() % 2)  # the rest are pairs of user and assistant
            row = turn = 0
            out = []
            for at in range(0, len(letters), piece):
                part = letters[at : at + piece]
                out.append((ck, at, row, turn, system, audit[at : at + piece]))
                row += int((part != ord("I")).sum())
                turn += int(kept[at : at + piece].sum())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["ck", "at", "row", "turn", "system", "letters"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each turn of the repaired conversation: its place, the row it comes from (null: inserted) and its new role (null: kept)."""
    for b in batches:
        for ck, at, row, turn, system, letters in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            out = []
            for place, letter in enumerate(letters, at):
                if letter != "D":
                    role = None if letter == "K" else ("user", "assistant")[(turn - system) % 2]
                    out.append((ck, place, None if letter == "I" else row, role))
                    turn += 1
                row += letter != "I"
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["ck", "place", "row", "new_role"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each ck, which arrive in order."""
    key, state = None, None
    for b in batches:
        done = []
        for ck, line in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if ck != key or state is None:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = ck, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], ["ck", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["ck", "sha"])


def _key(conv_id: str | Column) -> Column:
    c = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by a hash of conversation and turn: of 20 values,
    0 drops the row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times_ = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times_)).alias("copy")).drop("copy")


@dataclass
class Repair:
    #: (ck, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows.
    summary: DataFrame
    #: (ck, place, role, text) of every turn of the repaired conversations, in the order of place.
    turns: DataFrame


def repair(turns: DataFrame, segment: int = SEGMENT, fan: int = FAN, piece: int = PIECE) -> Repair:
    """Faults, cheapest edits and the repaired turns of every conversation of (conv_id, turn, role, text).

    ``ck`` is the conversation's id behind "=", or "null"."""
    spark = turns.sparkSession
    ship(spark)
    space = F.lit(" ")
    rows = turns.select(_key("conv_id").alias("ck"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    # copies meet here, added up before the shuffle
    rows = rows.groupBy("ck", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    stripped = F.rtrim("text", F.lit(BLANK_CHARS))
    rows = cut(
        rows.select(
            "ck", "turn", "role", "text", "n",
            F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("same"),
            (stripped == "").alias("blank"),
            (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut_off"),
        )
    )
    first = rows.groupBy("ck", "same").agg(F.bool_or(F.col("turn").isNull()).alias("some_null"), F.min("turn").alias("turn"))
    first = first.select("ck", "same", F.when(~F.col("some_null"), F.col("turn")).alias("turn"), F.lit(True).alias("first"))
    f = first.select(*(F.col(c).alias(f"f_{c}") for c in first.columns))
    placed = rows.join(f, (F.col("ck") == F.col("f_ck")) & (F.col("same") == F.col("f_same")) & F.col("turn").eqNullSafe(F.col("f_turn")), "left")
    repeat = F.coalesce(~F.col("f_first"), F.lit(True))
    initial = F.substring("role", 1, 1)
    state = F.when(F.col("blank") | repeat, MUST_GO).when(F.col("cut_off"), CUT_OFF).otherwise(FINE)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    placed = placed.select("ck", "turn", "role", "text", "n", "blank", repeat.alias("repeat"), initial.alias("initial"), (letter * 3 + state).alias("kind"), F.substring("text", 1, 64).alias("start"))
    order = [F.col("ck"), F.col("turn").asc_nulls_first(), F.col("role")]
    placed = placed.repartitionByRange(*order, F.col("start")).sortWithinPartitions(*order, "text").drop("start")
    # a place in the order of all rows: partitions are ranges, and the number rises within each
    placed = cut(placed.withColumn("mid", F.monotonically_increasing_id()))

    small = placed.select("ck", F.shiftright("mid", segment.bit_length() - 1).alias("at"), "mid", "kind", "n", "initial")
    parts = cut(small.repartition("ck", "at").sortWithinPartitions("ck", "at", "mid").mapInArrow(_segments, _SCHEMA))
    # segments numbered within their conversation; only ids and counts meet in a conversation's window
    before = Window.partitionBy("ck").orderBy("at")
    numbered = cut(parts.select("ck", "at", (F.row_number().over(before) - 1).cast("long").alias("no"), (F.sum("rows").over(before) - F.col("rows")).alias("starts")))
    whole = parts.join(numbered.select("ck", "at", "no"), ["ck", "at"]).select("ck", F.col("no").alias("at"), *_FIELDS)
    widest = numbered.agg(F.max("no")).first()[0] or 0
    while widest:
        group = F.floor(F.col("at") / fan)
        whole = cut(whole.select("ck", group.alias("up"), "at", *_FIELDS).repartition("ck", "up").sortWithinPartitions("ck", "up", "at").mapInArrow(_joined, _SCHEMA))
        widest //= fan
    answers = cut(whole.select("ck", *_FIELDS).mapInArrow(_answers, "ck string, illegal long, cost long, audit string"))

    counted = placed.groupBy("ck").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("repeat"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum((F.col("kind") % 3 == CUT_OFF).cast("long")).alias("truncated"),
    )
    far = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count("turn").cast("decimal(38,0)")
    gaps = rows.select("ck", "turn").distinct().groupBy("ck").agg(F.least(F.coalesce(far, F.lit(0)), F.lit((1 << 63) - 1)).cast("long").alias("gaps"))
    summary = answers.join(counted, "ck").join(gaps, "ck").select("ck", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    cuts = answers.select("ck", "audit").mapInArrow(lambda it: _pieces(it, piece), "ck string, at long, row long, turn long, system boolean, letters string")
    edits = cuts.repartition("ck", "at").mapInArrow(_edits, "ck string, place long, row long, new_role string")
    within = Window.partitionBy("ck", "at").orderBy("mid")  # a segment at most
    at_row = small.select("ck", "at", "mid", (F.sum("n").over(within) - F.col("n")).alias("inside")).join(numbered.select("ck", "at", "starts"), ["ck", "at"])
    at_row = at_row.select("ck", "mid", (F.col("starts") + F.col("inside")).alias("row"))
    e = edits.join(at_row, ["ck", "row"], "left")
    known = placed.select(F.col("ck").alias("p_ck"), F.col("mid").alias("p_mid"), "role", "text")
    done = e.join(known, (F.col("ck") == F.col("p_ck")) & (F.col("mid") == F.col("p_mid")), "left")
    repaired = done.select("ck", "place", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return Repair(summary, repaired)


def text_digests(turns: DataFrame) -> DataFrame:
    """(ck, sha): SHA-256 of each conversation's ``role:text`` lines."""
    lines = turns.select("ck", F.concat("role", F.lit(":"), "text").alias("line"), "place")
    return lines.repartition("ck").sortWithinPartitions("ck", "place").select("ck", F.col("line").cast("binary")).mapInArrow(_digests, "ck string, sha string")


def report(original: DataFrame, turns: DataFrame, **kw) -> DataFrame:
    """One row for every conv_id of ``original``, by the rows ``turns`` that are left of it."""
    done = repair(turns, **kw)
    ids = original.select("conv_id").distinct().withColumn("ck", _key("conv_id"))
    out = ids.join(done.summary, "ck", "left").join(text_digests(done.turns), "ck", "left")
    counts = (F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(nothing)).alias("repaired_sha256"))


def oracle() -> str:
    """The same in SQL, row by row, with the digest's lines carried along."""
    cost = "{'c': %s, 'a': %s, 'l': %s}"
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  [ascii(c) for c in string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')] AS b FROM conversations),
h AS (SELECT * EXCLUDE (b), xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(x AS BIGINT) for x in b]), lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p FROM d),
f AS (SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) || left(role, 1) AS pair FROM o),
cl(st, too, c, a, l) AS (VALUES ('', '', 0, '', CAST([] AS VARCHAR[])), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []), ('', 'u', 3, 'I', ['user:']), ('s', 'u', 3, 'I', ['user:']), ('a', 'u', 3, 'I', ['user:']), ('u', 'a', 3, 'I', ['assistant:']), ('', 'a', 6, 'II', ['user:', 'assistant:']), ('s', 'a', 6, 'II', ['user:', 'assistant:'])),
ar(st, too, c, op, who) AS (VALUES ('', '', 4, 'D', ''), ('s', 's', 4, 'D', ''), ('u', 'u', 4, 'D', ''), ('a', 'a', 4, 'D', ''), ('', 's', 0, 'K', 's'), ('', 'u', 0, 'K', 'u'), ('s', 'u', 0, 'K', 'u'), ('a', 'u', 0, 'K', 'u'), ('u', 'a', 0, 'K', 'a'),
  ('', 'u', 3, 'R', 'user'), ('s', 'u', 3, 'R', 'user'), ('a', 'u', 3, 'R', 'user'), ('u', 'a', 3, 'R', 'assistant')),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS p, '' AS st, {cost % ("0", "''", "CAST([] AS VARCHAR[])")} AS e FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL SELECT w.conv_id, w.p + 1, ar.too, min({cost % ("e.c + cl.c + ar.c + CASE WHEN op <> 'D' AND fault = 't' THEN 3 ELSE 0 END", "e.a || cl.a || op", "e.l || cl.l || CASE op WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [who || ':' || text] ELSE CAST([] AS VARCHAR[]) END")})
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.p = w.p + 1 JOIN cl ON cl.st = w.st JOIN ar ON ar.st = cl.too AND (op = 'D' OR (fault NOT IN ('b', 'd') AND (op = 'R' OR who = ini))) GROUP BY w.conv_id, w.p, ar.too),
n AS (SELECT conv_id, max(p) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
z AS (SELECT w.conv_id, any_value(n) AS n, min({cost % ("e.c + cl.c", "e.a || cl.a", "e.l || cl.l")}) AS e FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.p JOIN cl ON cl.st = w.st AND cl.too IN ('', 'a') GROUP BY w.conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit,
  sha256(coalesce(array_to_string(e.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM i.conv_id"""

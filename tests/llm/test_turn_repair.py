"""Conversation repair against a search over all edits, row by row."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import queries, turn_repair as R

SF = "/root/testdata/sf0.001"

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    """One conversation's result, from its (turn, role, text) rows after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    # the cheapest (cost, audit, lines) for each last initial, before each row
    ways = {"": (0, "", [])}
    for (_, role, text), fault in zip([*rows, (None, None, None)], [*faults, None], strict=True):
        for _ in range(3):
            for last, (cost, audit, lines) in list(ways.items()):
                for new, name in (("u", "user"), ("a", "assistant")):
                    if new in follows[last]:
                        way = (cost + 3, audit + "I", [*lines, f"{name}:"])
                        ways[new] = min(ways.get(new, way), way)
        if role is None:
            break
        after = {}
        for last, (cost, audit, lines) in ways.items():
            found = [(last, (cost + 4, audit + "D", lines))]
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                if role[:1] and role[:1] in follows[last]:
                    found.append((role[:1], (cost + more, audit + "K", [*lines, f"{role}:{text}"])))
                for new, name in (("u", "user"), ("a", "assistant")):
                    if new in follows[last]:
                        found.append((new, (cost + 3 + more, audit + "R", [*lines, f"{name}:{text}"])))
            for new, way in found:
                after[new] = min(after.get(new, way), way)
        ways = after
    cost, audit, lines = min(ways[k] for k in ("", "a") if k in ways)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def brute(rows):
    left = damaged(rows)
    return {c: expected([r[1:] for r in left if r[0] == c]) for c in {r[0] for r in rows}}


def got(frame):
    return {r[0]: tuple(r[1:]) for r in frame.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def made(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No", "", " \t\n", None, "What?", "Is it?  \n", "é!", "One more word", "x" * 70 + "a.", "x" * 70 + "b."]
    rows = []
    for c in range(conversations):
        rows += [(c, rng.choice([t, t, t, t // 2, None]), rng.choice(roles), rng.choice(texts)) for t in range(rng.randint(1, longest))]
    return rows + [(None, 1, "user", "Hello."), (None, 1, "user", "Hello."), (None, None, "assistant", "Hi.")]


@pytest.mark.parametrize("segment,fan,piece", [(R.SEGMENT, R.FAN, R.PIECE), (4, 2, 3)])
def test_random_conversations_equal_the_search(spark, segment, fan, piece):
    rows = made(segment, 40, 9) + [(100, t, ("user", "assistant", "tool")[t % 3 if t % 7 else 0], f"{t // 2}." if t % 5 else "cut") for t in range(150)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("ck", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    assert got(R.report(table, R.damage(table), segment=segment, fan=fan, piece=piece)) == brute(rows)


def test_many_copies_of_one_row_are_a_power(spark):
    rows = [(1, 0, "user", "Hi.")] * 300 + [(1, 1, "assistant", "Yes.")] + [(1, 2, "user", "")] * 50
    plain = spark.createDataFrame(rows, SCHEMA)
    assert got(R.report(plain, plain, segment=16))[1] == expected([r[1:] for r in rows])


def test_products_are_associative():
    rng = random.Random(3)
    kinds = [rng.randrange(12) for _ in range(60)]
    left = R.ONE
    for k in kinds:
        left = R.times(left, R.TURNS[k])
    assert R.product([R.TURNS[k] for k in kinds]) == left
    assert R.power(R.TURNS[5], 13) == R.product([R.TURNS[5]] * 13)


def test_repaired_turns_read_as_they_should(spark):
    table = spark.createDataFrame(made(9, 30, 8), SCHEMA)
    by = {}
    for r in R.repair(R.damage(table)).turns.orderBy("ck", "place").collect():
        by.setdefault(r["ck"], []).append(r["role"][:1])
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in by.values())


def test_dropped_and_empty(spark):
    conv = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA)
    assert got(R.report(table, R.damage(table))) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert R.report(table.limit(0), R.damage(table.limit(0))).count() == 0


def test_query_equals_the_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_conversation_repair(spark, SF)) == brute(rows)

import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from nimbusops.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def plain(rows):
    """(faults, illegal, cost, audit, repaired lines) of ordered (role, text) rows, by best-first search over whole edit lists."""
    faults, seen = [], set()
    for role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        faults.append(1 if not last else 2 if (role, text) in seen else 0 if last in ".!?" else 3)
        seen.add((role, text))
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, made, lines = heapq.heappop(queue)
        if i == len(rows) and GOOD.match(made):
            return [faults.count(f) for f in (1, 2, 3)], illegal, cost, audit, list(lines)
        if (i, made[-1:], len(made) and made[0] == "s") in done:  # cheaper and lesser lists came first
            continue
        done.add((i, made[-1:], len(made) and made[0] == "s"))
        due = "assistant" if made.endswith("u") else "user"
        heapq.heappush(queue, (cost + 5, audit + "I", i, made + due[0], (*lines, due + ":")))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, made, lines))
            if faults[i] in (0, 3):
                more = 5 * (faults[i] == 3)
                if role[:1] == due[0] or role[:1] == "s" and not made:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, made + role[:1], (*lines, f"{role}:{text}")))
                heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, made + due[0], (*lines, f"{due}:{text}")))


def draw_rows(draw, n):
    return [(draw.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), draw.choice(["a.", "b!", "c?", "cut", " ", "", f"{i}. "])) for i in range(n)]


@pytest.mark.parametrize("block", [1, 3, repair.BLOCK])
def test_cheapest(block):
    draw = random.Random(block)
    for _ in range(400):
        rows = draw_rows(draw, draw.randint(0, 14))
        _, _, cost, audit, _ = plain(rows)
        codes, seen = bytearray(), set()
        for role, text in rows:
            last = text.strip()[-1:]
            fault = 1 if not last else 2 if (role, text) in seen else 0 if last in ".!?" else 3
            seen.add((role, text))
            codes.append(4 * {"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + fault)
        assert repair.cheapest(bytes(codes), block) == (cost, audit)


def test_long_conversation():
    draw = random.Random(3)
    codes = bytes(draw.randrange(16) for _ in range(20_000))
    cost, audit = repair.cheapest(codes)
    assert len(audit) - audit.count("I") == len(codes)
    assert cost == 2 * audit.count("D") + 5 * audit.count("I") + audit.count("R") + 5 * sum(
        code % 4 == 3 and edit != "D" for code, edit in zip(codes, audit.replace("I", "")))
    assert (cost, audit) == repair.cheapest(codes, 7)


def results(spark, df, keep=None):
    found, turns = repair.repair(df, keep)
    digest = {r.conv_id: r.repaired_sha256 for r in repair.repaired_digests(turns).collect()}
    return {r.conv_id: (r.gaps, [r.blank, r.duplicate, r.truncated], r.illegal, r.cost, r.audit, digest[r.conv_id]) for r in found.collect()}


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_against_search(spark):
    draw = random.Random(11)
    convs = {c: draw_rows(draw, draw.randint(1, 9)) for c in range(150)}
    turns = {c: sorted(draw.sample(range(-20, 20), len(rows))) for c, rows in convs.items()}
    df = spark.createDataFrame([(c, t, *row) for c, rows in convs.items() for t, row in zip(turns[c], rows)], SCHEMA).repartition(5)
    expected = {}
    for c, rows in convs.items():
        faults, illegal, cost, audit, lines = plain(rows)
        expected[c] = (turns[c][-1] - turns[c][0] + 1 - len(rows), faults, illegal, cost, audit, sha(lines))
    assert results(spark, df) == expected


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "system", "x."), (1, 1, "assistant", "y."), (1, 3, "user", "z."), (1, 4, "assistant", "w")], SCHEMA)
    _, turns = repair.repair(df)
    got = [(r.pos, r.role, r.text, r.edit) for r in turns.where("pos > 0").orderBy("pos").collect()]
    # reroling one turn is cheaper than inserting; the truncated last one goes
    assert got == [(1, "system", "x.", "K"), (2, "user", "y.", "R"), (3, "assistant", "z.", "R")]


def test_odd_rows(spark, with_clashes):
    long = "ab " * 100_000 + "."
    rows = [(1, None, None, None), (1, 5, "user", long), (1, 5, "assistant", long), (1, 5, "user", long),
            (2, 1, "user", "gone."), (None, None, "user", "no id."), (3, None, "user", "x ."), (3, None, "assistant", "é. ")]
    got = results(spark, with_clashes(spark.createDataFrame(rows, SCHEMA)), F.coalesce(F.col("conv_id") != 2, F.lit(True)))
    empty = sha([])
    assert got[2] == (0, [0, 0, 0], 0, 0, "", empty)
    assert got[1][0] == 0 and got[1][1] == [1, 1, 0] and got[1][3] in (4, 5, 6)
    assert got[None] == (0, [0, 0, 0], 0, 2, "D", empty)
    assert got[3][1] == [0, 0, 1]  # a no-break space is no white space here, so the text has no end
    found, turns = repair.repair(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and turns.count() == 0

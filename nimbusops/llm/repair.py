"""Cheapest repair of the order of roles in conversations: an optional system turn, then user and assistant in
turn, `(s?(ua)+)?` by the roles' initials.

Edits along a conversation, by cost: K keeps a turn (0), R gives it the role user or assistant (1), D deletes it
(2), I inserts an empty user or assistant turn (5). Blank turns and duplicates must be deleted; a truncated
turn that stays costs 5 more. Of equally cheap lists of edits the ASCII-least is taken.

The edits are arcs of a lattice whose nodes are a place in the conversation and what the repaired part
ends with (nothing, s, u, a). The auction algorithm searches it: every node has a price, no higher than
the cost to the end; the path from the origin is extended over an arc whose cost is the difference of
prices (a tight one), of several over the one whose letter comes first. Where none is tight the node's price is raised until one is, and the
path gives the node up. Prices at the end of the path found are exact, all its arcs are tight, and arcs of lesser letters are not,
so it is the least of the cheapest paths.

The lattice is searched from its last `BLOCK` turns to its first: a block's far side has exact prices already, its own
start from the least of them, and the auction runs from each of the four nodes on its near side. Then
the block's paths are put together from the first turn on. A block depends on its turns' codes and the prices
behind it alone, so blocks that were met before (most are) are looked up in a bounded table.

A task sees the turns of a conversation in a row, as a byte each (with the edits' letters, the only thing that grows with a
conversation here), and then again with role and text, which it edits and passes on one by one; neither needs a
conversation's texts together. Duplicates are numbered by conversation and digest, not gathered.

Turns are in the order of `turn`, null ones first, equal ones in the order of their MD5. Null roles and
texts count as one space. Rows with a null conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbusops.llm.batches import bounded, tidy
from nimbusops.session import Staging

BLOCK = 16
KNOWN = 1 << 14  # blocks that a worker remembers
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, S, U, A = range(4)  # what the repaired part ends with; as role initials START means any other
FOLLOWS = (U, U, A, U)
FINE, BLANK, DUPLICATE, CUT = range(4)  # first faults
SPACES = " \t\n\x0b\x0c\r"
END = (0, 2 * INSERT, INSERT, 0)  # cost behind the last turn: `ua`, `a` or nothing is missing
TAIL = ("", "II", "I", "")


def arcs(code: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, turns on, state) of the edits before a turn, in the order of letters."""
    role, fault = divmod(code, 4)
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, FOLLOWS[state])]
    if fault in (FINE, CUT):
        more = TRUNCATED if fault == CUT else 0
        if role == FOLLOWS[state] or role == S and state == START:
            out.append(("K", KEEP + more, 1, role))
        out.append(("R", REROLE + more, 1, FOLLOWS[state]))
    return out


@lru_cache(KNOWN)
def auction(codes: bytes, behind: tuple[int, ...]) -> tuple[tuple[int, str, int], ...]:
    """For each state in front of a block of turns: the cost from there, the edits in the block and the state
    behind it. `behind` has the costs from each state behind the block."""
    out = [[(letter, cost, 4 * (i + on) + to) for letter, cost, on, to in arcs(code, state)] for i, code in enumerate(codes) for state in range(4)]
    last = 4 * len(codes)
    price = [min(behind)] * last + list(behind)
    found = []
    for origin in range(4):
        path, letters = [origin], []
        while path[-1] < last:
            node = path[-1]
            best, letter, to = None, "", 0
            for arc in out[node]:
                ahead = arc[1] + price[arc[2]]
                if best is None or ahead < best:
                    best, letter, to = ahead, arc[0], arc[2]
            if price[node] < best:  # contract
                price[node] = best
                if len(path) > 1:
                    path.pop()
                    letters.pop()
            else:  # extend
                path.append(to)
                letters.append(letter)
        found.append((price[origin], "".join(letters), path[-1] - last))
    return tuple(found)


def cheapest(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Cost and edits of a conversation, from a code (4 x role + fault) per turn."""
    starts = range(0, len(codes), block)
    behind = np.zeros((len(starts) + 1, 4), np.int64)
    least = np.zeros(len(starts) + 1, np.int64)  # taken off, so that blocks meet again with other costs behind them
    behind[-1] = END
    for i in reversed(range(len(starts))):
        costs = [x[0] for x in auction(bytes(codes[starts[i]:starts[i] + block]), tuple(behind[i + 1].tolist()))]
        least[i] = least[i + 1] + min(costs)
        behind[i] = np.array(costs) - min(costs)
    edits, state = [], START
    for i, at in enumerate(starts):
        _, letters, state = auction(bytes(codes[at:at + block]), tuple(behind[i + 1].tolist()))[state]
        edits.append(letters)
    return int(behind[0, START] + least[0]), "".join(edits) + TAIL[state]


def coded(rows: DataFrame, keep: Column) -> DataFrame:
    """conv_id, turn, `digest` and `code` of each row, role and text without nulls; of rows that take no part
    the code is null. `again` numbers equal turns of a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    plain = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.coalesce(keep, F.lit(False)).alias("kept"))
    tail = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(START)
    fault = F.when(tail == "", BLANK).when(F.right(tail, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT)
    return plain.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.md5(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text")).alias("digest"),
        F.when(F.col("kept"), kind * 4 + fault).cast("int").alias("code"), "role", "text")


def _summary(codes: bytearray, distinct: int, span: tuple[int, int] | None) -> tuple:
    role, fault = (np.frombuffer(codes, np.uint8) >> 2), (np.frombuffer(codes, np.uint8) & 3)
    legal = (role[:-1] != START) & (role[1:] == np.array(FOLLOWS)[role[:-1]])
    cost, edits = cheapest(bytes(codes))
    return (span[1] - span[0] + 1 - distinct if span else 0, *(int((fault == f).sum()) for f in (BLANK, DUPLICATE, CUT)),
            int((~legal).sum()), cost, edits)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, size = [], 0
    conv_id, codes, distinct, span, begun = None, bytearray(), 0, None, False
    for batch in batches:
        for c, turn, code in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "code")), strict=True):
            if not begun or c != conv_id:
                if begun:
                    size += len(codes)
                    done.append((conv_id, *_summary(codes, distinct, span)))
                conv_id, codes, distinct, span, begun = c, bytearray(), 0, None, True
            if code is None:
                continue
            codes.append(code)
            if turn is not None and (span is None or turn != span[1]):
                span, distinct = (turn if span is None else span[0], turn), distinct + 1
        if size >= 1 << 20:
            yield _batch(AUDITS, done)
            done, size = [], 0
    if begun:
        yield _batch(AUDITS, [*done, (conv_id, *_summary(codes, distinct, span))])


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


AUDITS = pa.schema([*((n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
AUDITS_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("sha", pa.string())])


def audits(marked: DataFrame) -> DataFrame:
    """A row per conversation: the counts of its faults, the cost of its repair and the edits' letters."""
    same = Window.partitionBy("conv_id", "digest", F.col("code").isNull()).orderBy(F.asc_nulls_first("turn"))
    fault = F.col("code").bitwiseAND(3)
    numbered = marked.select("conv_id", "turn", "digest", "code", F.row_number().over(same).alias("again")).withColumn(
        "code", F.when((F.col("again") > 1) & (fault != BLANK), F.col("code") - fault + DUPLICATE).otherwise(F.col("code")))
    ordered = numbered.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "digest", "again")
    return bounded(ordered).select("conv_id", "turn", "code").mapInArrow(tidy(_audits), AUDITS_SQL)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with position 0 and the audit for each conversation, then its repaired turns."""
    rows, size, edits, at, pos, head, conv_id = [], 0, "", 0, 0, False, None

    def add(role: str, text: str, edit: str) -> None:
        nonlocal pos, size
        pos, size = pos + 1, size + len(text) + 100
        rows.append((conv_id, pos, role, text, edit))

    def due() -> str:  # the role that user and assistant turns in turn give to the next position
        return "assistant" if (pos - head) % 2 else "user"

    def inserts() -> None:
        nonlocal at
        while at < len(edits) and edits[at] == "I":
            add(due(), "", "I")
            at += 1

    for batch in batches:
        for conv_id, audit, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text")), strict=True):  # noqa: B007
            if audit is not None:
                edits, at, pos, head = audit, 0, 0, False
                rows.append((conv_id, 0, None, None, None))
            else:
                letter, at = edits[at], at + 1
                if letter == "K":
                    head = head or pos == 0 and role[:1] == "s"
                    add(role, text, letter)
                elif letter == "R":
                    add(due(), text, letter)
            inserts()
            if size >= 1 << 20:
                yield _batch(REPAIRED, rows)
                rows, size = [], 0
    if rows:
        yield _batch(REPAIRED, rows)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, of = None, None
    for batch in batches:
        done = []
        for conv_id, pos, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "pos", "role", "text")), strict=True):
            if not pos:
                if digest:
                    done.append((of, digest.hexdigest()))
                digest, of = hashlib.sha256(), conv_id
            else:
                digest.update(("\n" * (pos > 1) + f"{role}:{text}").encode())
        if done:
            yield _batch(DIGESTS, done)
    if digest:
        yield _batch(DIGESTS, [(of, digest.hexdigest())])


def edited(marked: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, pos from 1, role, text, edit: K, R or I), in order within their partition,
    behind a row with pos 0 for every conversation."""
    none = F.lit(None).cast("string")
    heads = found.select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), none.alias("digest"), "audit", none.alias("role"), none.alias("text"))
    turns = marked.where("code IS NOT NULL").select("conv_id", F.lit(True).alias("is_row"), "turn", "digest", none.alias("audit"), "role", "text")
    ordered = heads.union(turns).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", F.asc_nulls_first("turn"), "digest")
    return bounded(ordered).select("conv_id", "audit", "role", "text").mapInArrow(
        tidy(_edit), "conv_id long, pos long, role string, text string, edit string")


def repair(rows: DataFrame, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Audits, and repaired turns as in `edited`, of conversations (conv_id, turn, role, text). Rows for which `keep`
    is not true take no part, but their conversations are listed."""
    marked = coded(rows, F.lit(True) if keep is None else keep)
    found = Staging(rows.sparkSession).write("audits", audits(marked))
    return found, edited(marked, found)


def repaired_digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its repaired turns as lines `role:text`, from `edited` as it is."""
    return turns.mapInArrow(tidy(_digests), "conv_id long, repaired_sha256 string")

"""Prefix tree of conversations: every distinct beginning is a node, with counts over what continues it.

1. A turn becomes 16 bytes, the MD5 of its role and text, and a conversation the bytes of its turns in a
   row, so a beginning of d turns is a beginning of 16 d bytes. Texts travel no further.
2. Conversations are sorted by these bytes and conv_id into ranges. Neighbours share some number of
   turns, their edge. Within a piece of a range, union-find takes the edges in descending depth: what it
   merges at depth d is a branching node there (or more of one), and a part that reaches deeper than d
   is closed first: its top and the turns down to it, a chain without branches, are final.
3. The first and the last part of a piece may go on beyond it, so they and the parts whose edges to them
   remain are not closed. They are the contracted forest of the piece: a few weighted parts, with depths
   falling from the first and rising to the last. It stands in front of the next piece of the range;
   forests of `FAN` ranges are merged the same way, and so on until one is left.
4. Chains learn their parent's least conv_id by one join and are unrolled into nodes.

Members that end at a node are neighbours, in the order of conv_id. Their ids are hashed as they
stream by; only a group that touches the edge of a range is sent on, as joined pieces of text.

A task holds a piece of `PIECE_BYTES` and one conversation's digests (16 bytes a turn), whatever the
number of members of a node. Rows without a conv_id belong to no conversation. Null turns come first,
turns of one number in the order of their digests; null roles and texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbusops.llm.batches import bounded, tidy
from nimbusops.session import Staging

WIDTH = 16
FAN = 256
PIECE_BYTES = 8 << 20
ROW_BYTES = 200  # of a part in Python, beside its turns
IDS_BYTES = 1 << 20

CHAIN, PART, ENDS, IDS = range(4)
ROW = pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("no", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()),
                 ("depth", pa.int64()), ("body", pa.binary()), ("chars", pa.list_(pa.int64())), ("conv_id", pa.int64()),
                 ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ids", pa.string())])
ROW_SQL = ("kind int, at long, no long, key binary, parent binary, depth long, body binary, chars array<long>, conv_id long, "
           "n_convs long, n_children long, n_leaves long, saved long, ids string")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, an array of (digest, chars)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text))
    one = F.struct("turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("x")).groupBy(
        "conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.dropFields("turn")).alias("turns"))


def with_heads(listed: DataFrame, base: Column, head: Column, longest: int) -> DataFrame:
    """Conversations whose first `head` turns (at most `longest`) are replaced by those of conversation
    `base`: by all it has if it is shorter, by none if there is no such conversation."""
    own = listed.select("conv_id", "turns", base.alias("base"), head.alias("head"))
    heads = listed.where(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), F.slice("turns", 1, longest).alias("first"))
    none = F.slice("turns", 1, 0)
    rest = F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns") - F.col("head"), F.lit(0)))
    return own.join(heads, "base", "left").select(
        "conv_id", F.concat(F.coalesce(F.slice("first", F.lit(1), F.col("head")), none), rest).alias("turns"))


def sequences(listed: DataFrame) -> DataFrame:
    """conv_id, `body`, the digests in a row, and the chars of each turn."""
    return listed.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("body"), F.col("turns.chars").alias("chars"))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two conversations have in common from the start on."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    low, high = 0, n  # bytes known to be equal, bytes known to hold a difference
    while high - low > WIDTH:
        middle = (low + high) // 2 // WIDTH * WIDTH
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low // WIDTH


class Part:
    """Neighbouring conversations that share the first `depth` turns, which `body` and `chars` hold.
    Counts are of the node at that depth; `saved` is the sum over its children's subtrees."""

    __slots__ = ("body", "chars", "conv_id", "depth", "n_children", "n_convs", "n_leaves", "open", "saved")

    def __init__(self, body, chars, conv_id, n_convs=1, n_children=0, n_leaves=0, saved=0):
        self.body, self.chars, self.depth = body, chars, len(body) // WIDTH
        self.conv_id, self.n_convs, self.n_children, self.n_leaves, self.saved = conv_id, n_convs, n_children, n_leaves, saved
        self.open = False

    def join(self, other: Part) -> None:
        self.conv_id, self.open = min(self.conv_id, other.conv_id), self.open or other.open
        self.n_convs += other.n_convs
        self.n_children += other.n_children
        self.n_leaves += other.n_leaves
        self.saved += other.saved


class Rows:
    """Output rows, gathered into batches."""

    def __init__(self):
        self.rows, self.size = [], 0

    def __call__(self, **row) -> None:
        self.rows.append(row)
        self.size += ROW_BYTES + 8 * len(row.get("chars", ())) + len(row.get("body", b"")) + len(row.get("ids") or "")

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in self.rows], f.type) for f in ROW], schema=ROW)
            self.rows, self.size = [], 0


def close(part: Part, depth: int, emit: Rows) -> None:
    """The part's node and the chain above it, down from a node at `depth` (-1: none), are final. The part
    becomes that node's, with one child."""
    chars = np.concatenate([[0], part.chars])[depth + 1:]  # of the nodes' last turns; the root has none
    saved = part.saved + (part.n_convs - 1) * np.cumsum(chars[::-1])[::-1]
    leaves = part.n_leaves if part.n_children else 1
    emit(kind=CHAIN, key=hashlib.md5(part.body).digest(), parent=hashlib.md5(part.body[:WIDTH * depth]).digest() if depth >= 0 else None,
         depth=depth + 1, chars=saved, conv_id=part.conv_id, n_convs=part.n_convs, n_children=part.n_children, n_leaves=leaves)
    if depth >= 0:
        part.body, part.chars, part.depth = part.body[:WIDTH * depth], part.chars[:depth], depth
        part.n_children, part.n_leaves, part.saved = 1, leaves, int(saved[0])


def contract(parts: list[Part], emit: Rows) -> list[Part]:
    """Merge sorted parts over their edges in descending depth; returns those that stay apart."""
    edges = np.array([shared(a.body, b.body) for a, b in pairwise(parts)], np.int64)
    up = list(range(len(parts)))  # union-find; the least number of a group is its root

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in np.argsort(-edges, kind="stable").tolist():
        depth, left, right = int(edges[i]), find(i), find(i + 1)
        a, b = parts[left], parts[right]
        for part in (a, b):
            if part.depth > depth and not part.open:
                close(part, depth, emit)
        if a.depth == b.depth == depth:
            a.join(b)
            up[right] = left
        else:  # one goes on beyond this piece at a greater depth
            a.open = b.open = True
    return [p for i, p in enumerate(parts) if up[i] == i]


def _settle(parts: Iterator[Part], emit: Rows, at: int, whole: bool, piece: int) -> Iterator[pa.RecordBatch]:
    """Contract a sorted run of parts piece by piece. `whole`: the run is all there is, so the root is closed."""
    held, size, limit = [], 0, piece

    def contracted(more: bool) -> list[Part]:
        for p in held:
            p.open = False
        held[0].open = not whole
        if more or not whole:
            held[-1].open = True
        return contract(held, emit)

    for part in parts:
        held.append(part)
        size += 2 * len(part.body) + ROW_BYTES
        if size >= limit:
            held = contracted(True)
            size = sum(2 * len(p.body) + ROW_BYTES for p in held)
            limit = max(piece, 2 * size)
            yield from emit.batches(IDS_BYTES)
    if held:
        for no, p in enumerate(contracted(False)):
            if whole:
                close(p, -1, emit)
            else:
                emit(kind=PART, at=at, no=no, body=p.body, chars=p.chars, conv_id=p.conv_id, n_convs=p.n_convs,
                     n_children=p.n_children, n_leaves=p.n_leaves, saved=p.saved)
    yield from emit.batches()


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """body, chars and the named columns of each row."""
    bounds = batch.column("chars").offsets.to_numpy()
    values = batch.column("chars").values.to_numpy()
    others = [batch.column(n).to_pylist() for n in names]
    for body, a, b, *row in zip(batch.column("body").to_pylist(), bounds[:-1], bounds[1:], *others, strict=True):
        yield body, values[a:b], *row


class _Ends:
    """The ids that end at one node. They come in a row and in order; a group that may go on in another
    range, or is long, leaves in pieces, others as their digest."""

    def __init__(self, emit: Rows, at: int):
        self.emit, self.at, self.no = emit, at, 0
        self.body, self.ids, self.sent = None, [], True

    def add(self, body: bytes, conv_id: int) -> None:
        if body != self.body:
            if self.body is not None:
                self.finish()
            self.sent = self.body is None  # the first of a range
            self.body = body
        self.ids.append(conv_id)
        if len(self.ids) >= IDS_BYTES // 8:
            self.send()

    def send(self) -> None:
        self.emit(kind=IDS, at=self.at, no=self.no, key=hashlib.md5(self.body).digest(), ids=",".join(map(str, self.ids)))
        self.no, self.ids, self.sent = self.no + 1, [], True

    def finish(self, last: bool = False) -> None:
        if self.body is None or not self.ids:
            return
        if last or self.sent:
            self.send()
        else:
            self.emit(kind=ENDS, key=hashlib.md5(self.body).digest(), ids=hashlib.sha256(",".join(map(str, self.ids)).encode()).hexdigest())
            self.ids = []


def _first_forests(piece: int):
    """Sorted sequences of a range: its closed chains, its contracted forest and its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, at = Rows(), TaskContext.get().partitionId()
        ends = _Ends(emit, at)

        def parts() -> Iterator[Part]:
            for batch in batches:
                for body, chars, conv_id in _columns(batch, "conv_id"):
                    ends.add(body, conv_id)
                    yield Part(body, chars, conv_id)
            ends.finish(last=True)

        yield from _settle(parts(), emit, at, False, piece)

    return run


def _merged_forests(whole: bool, piece: int, fan: int):
    """Forests of `fan` ranges as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = Rows()
        names = "at", "conv_id", "n_convs", "n_children", "n_leaves", "saved"
        rows = (row for batch in batches for row in _columns(batch, *names))
        for group, own in groupby(rows, lambda row: row[2] // fan):
            yield from _settle((Part(body, chars, *counts) for body, chars, _, *counts in own), emit, group, whole, piece)

    return run


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest per key of pieces that come in order; no more than a piece is held."""

    def rows() -> Iterator[tuple[bytes, str]]:
        for batch in batches:
            yield from zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True)

    for key, pieces in groupby(rows(), lambda row: row[0]):
        digest = hashlib.sha256()
        for i, (_, ids) in enumerate(pieces):
            digest.update(("," * (i > 0) + ids).encode())
        yield pa.RecordBatch.from_pylist([{"key": key, "ids": digest.hexdigest()}], pa.schema([("key", pa.binary()), ("ids", pa.string())]))


def prefix_trie(listed: DataFrame, piece: int = PIECE_BYTES, fan: int = FAN) -> DataFrame:
    """A row per node of the prefix tree of conversations (conv_id, turns: see `turns`): conv_id, the least
    member, depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (over the
    subtree, the last turn's chars times the members but one) and ends_sha256 (of the ids, ascending and
    joined by commas, of members that end there). No row without a conversation; conversations without
    turns are members of the root alone."""
    staging = Staging(listed.sparkSession)
    stored = staging.write("sequences", sequences(listed))
    ranged = bounded(stored).repartitionByRange("body", "conv_id").sortWithinPartitions("body", "conv_id")
    found = staging.write("ranges", ranged.mapInArrow(tidy(_first_forests(piece)), ROW_SQL))
    chains, parts, whole, level = found.where(F.col("kind") == CHAIN), found.where(F.col("kind") == PART), False, 0
    while not whole:
        last = parts.agg(F.max("at")).first()[0]  # one number; ranges, then groups of them
        whole, level = last is None or last < fan, level + 1
        dealt = parts.repartition(F.floor(F.col("at") / fan)).sortWithinPartitions("at", "no")
        more = staging.write(f"forests-{level}", dealt.mapInArrow(tidy(_merged_forests(whole, piece, fan)), ROW_SQL))
        chains, parts = chains.union(more.where(F.col("kind") == CHAIN)), more.where(F.col("kind") == PART)
    pieces = found.where(F.col("kind") == IDS).select("key", "at", "no", "ids")
    ends = found.where(F.col("kind") == ENDS).select("key", "ids").union(
        pieces.repartition("key").sortWithinPartitions("key", "at", "no").mapInArrow(tidy(_joined_ends), "key binary, ids string"))
    parents = chains.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv"))
    nodes = chains.select("key", "parent", "depth", "chars", "conv_id", "n_convs", "n_children", "n_leaves").join(ends, "key", "left").join(
        parents, "parent", "left").select("*", F.size("chars").alias("length"), F.posexplode("chars").alias("i", "saved_tokens"))
    bottom = F.col("i") == F.col("length") - 1
    none = hashlib.sha256().hexdigest()
    return nodes.select(
        "conv_id", (F.col("depth") + F.col("i")).alias("depth"), F.when(F.col("i") > 0, F.col("conv_id")).otherwise(F.col("parent_conv")).alias("parent_conv_id"),
        "n_convs", F.when(bottom, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", "saved_tokens",
        F.when(bottom, F.coalesce("ids", F.lit(none))).otherwise(none).alias("ends_sha256"))

"""Token ids packed into fixed-length rows by best-fit decreasing, written as binary matrices.

Texts are encoded with a SentencePiece model (begin and end ids included). A text longer than a row is
split into full rows and a rest, so no id is lost. Rests wait in a buffer of at most `buffer_tokens`
ids, are sorted by falling length and put into the open row with the least sufficient room; a segment
tree over room sizes finds it in logarithmic time. Each full buffer becomes one shard of three files
in the shared folder, readable with numpy.load:

    *.ids.npy          rows x length ids, padded with the pad id
    *.cu_seqlens.npy   for all rows in turn, 0 and the running ends of the row's segments
    *.resets.npy       rows x length / 8 bytes of bits, set where positions start again from 0

An index table names shard, row, doc_ids and parts. File names hold the task attempt; only what a
finished attempt returned is in the index. Everything is local to a task, nothing is shuffled.

Null and empty texts have their begin and end ids. Equal lengths keep the order of rows. Rows that
repeat a document are packed as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbusops.llm import sentencepieces
from nimbusops.llm import text as T
from nimbusops.llm.batches import bounded, tidy
from nimbusops.llm.files import open_folder

LENGTH = 2048
BUFFER_TOKENS = 1 << 21


class RoomTree:
    """Open rows by the room they have left; finds the least room that is enough."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and row of the best fit, which is taken out."""
        count, node = self.count, need + self.size
        while not count[node]:
            while node & 1:  # a right child: what lies further right is above
                node >>= 1
                if node <= 1:
                    return None
            if node <= 1:
                return None
            node += 1
        while node < self.size:
            node <<= 1
            if not count[node]:
                node += 1
        room = node - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Rows as lists of item numbers; items are no longer than a row."""
    tree, rows = RoomTree(length), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        found = tree.take(need)
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(item)
        tree.add(room - need, row)
    return rows


def _segments(ids: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, part, ids) of all texts in order."""
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for part, at in enumerate(range(a, b, length)):
            yield i, part, ids[at:min(at + length, b)]


def write(docs: DataFrame, folder: str, model_path: str, length: int = LENGTH, pad_id: int = 0,
          buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """Write shards; the index table with a row per packed row: shard, row, doc_ids, parts, n_tokens."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sentencepieces.load(model_path)
        table = sentencepieces.ChunkTable(model)
        dtype = np.uint16 if model.get_piece_size() <= 1 << 16 else np.uint32
        system, path = open_folder(folder)
        held: list[tuple[object, int, np.ndarray]] = []
        tokens, number, kind = 0, 0, None

        def flush() -> pa.RecordBatch:
            nonlocal tokens, number
            lengths = np.array([len(x[2]) for x in held])
            rows = best_fit(lengths, length)
            matrix = np.full((len(rows), length), pad_id, dtype)
            resets = np.zeros((len(rows), length), bool)
            ends = []
            for r, items in enumerate(rows):
                at = np.concatenate([[0], np.cumsum(lengths[items])])
                matrix[r, :at[-1]] = np.concatenate([held[i][2] for i in items])
                resets[r, at[:-1]] = True
                ends.append(at.astype(np.int32))
            shard = f"{path}/shard-{TaskContext.get().taskAttemptId()}-{number}"
            for name, body in (("ids", matrix), ("cu_seqlens", np.concatenate(ends)), ("resets", np.packbits(resets, axis=1))):
                with system.open_output_stream(f"{shard}.{name}.npy") as out:
                    np.lib.format.write_array(_Plain(out), body, allow_pickle=False)
            done = pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(rows)), pa.array(np.arange(len(rows), dtype=np.int32)),
                 pa.array([[held[i][0] for i in items] for items in rows], pa.list_(kind)),
                 pa.array([[held[i][1] for i in items] for items in rows], pa.list_(pa.int32())),
                 pa.array([int(e[-1]) for e in ends], pa.int64())], ["shard", "row", "doc_ids", "parts", "n_tokens"])
            held.clear()
            tokens, number = 0, number + 1
            return done

        for batch in batches:
            column, doc_ids = batch.column("text"), batch.column("doc_id")
            kind = doc_ids.type
            _, offsets = T.flat(column)
            for a, b in T.pieces(offsets, 4 * T.PIECE_BYTES):
                ids, bounds = sentencepieces.encode_batch(table, column[a:b])
                names = doc_ids[a:b].to_pylist()
                for i, part, segment in _segments(ids.astype(dtype), bounds, length):
                    held.append((names[i], part, segment))
                    tokens += len(segment)
                    if tokens >= buffer_tokens:
                        yield flush()
        if held:
            yield flush()

    return bounded(docs).select("doc_id", "text").mapInArrow(
        tidy(run), f"shard string, row int, doc_ids array<{id_type}>, parts array<int>, n_tokens long")


class _Plain:
    """An Arrow stream as the plain file that numpy writes to."""

    def __init__(self, out):
        self.write = out.write


def read(index: DataFrame, folder: str) -> DataFrame:
    """The index with what the files hold: ids (of the row, without padding, little-endian unsigned
    32-bit integers) and cu_seqlens. Position resets are checked against the segment ends."""

    def load(system, name):
        with system.open_input_stream(name) as source:
            version = np.lib.format.read_magic(source)
            shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(source)
            return np.frombuffer(source.read(), dtype).reshape(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            shards, rows, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "row", "n_tokens"))
            for shard in dict.fromkeys(shards):
                at = np.flatnonzero(shards == shard)
                matrix, ends, resets = (load(system, f"{shard}.{x}.npy") for x in ("ids", "cu_seqlens", "resets"))
                starts = np.append(np.flatnonzero(ends == 0), len(ends))
                ids, cu = [], []
                for i in at:
                    own = ends[starts[rows[i]]:starts[rows[i] + 1]]
                    if own[-1] != n[i] or (np.flatnonzero(np.unpackbits(resets[rows[i]])) != own[:-1]).any():
                        raise ValueError(f"{shard} differs from its index")
                    ids.append(matrix[rows[i], :n[i]].astype("<u4").tobytes())
                    cu.append(own)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.binary()), pa.array(cu, pa.list_(pa.int32()))],
                    [*part.schema.names, "ids", "cu_seqlens"])

    return index.mapInArrow(tidy(run), f"{index.schema.toDDL()}, ids binary, cu_seqlens array<int>")

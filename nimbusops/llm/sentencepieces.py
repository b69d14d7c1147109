"""Encoding and decoding with a SentencePiece BPE model by a table of distinct marked words.

No piece of such a model holds the white space mark behind another character, so no merge crosses the
start of a run of marks. A text is therefore cut before each run; every distinct chunk is segmented
once per task (the table is emptied when it holds `TABLE_ROWS` chunks, which bounds its memory) and
the ids are joined back by position with one gather. Nothing is shuffled: a task needs only its own
texts, and a table for the whole corpus would have to be joined to every word position.

Null texts count as empty. A text without characters yields the begin and end ids only. Rows repeat
as they come in; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbusops.llm import text as T
from nimbusops.llm.batches import bounded, tidy

TABLE_ROWS = 400_000
MARK = "▁"


def load(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model; refuses one whose pieces could cross a white space mark."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece holds a white space mark behind another character")
    if model.encode("  a  b ", out_type=str)[0][0] != MARK or model.normalize("a  ﬁ ") != "▁a▁▁ﬁ▁":
        raise ValueError("the model must add a mark in front and leave text and spaces as they are")
    return model


class ChunkTable:
    """Distinct chunks and their ids; grows batch by batch up to a bound."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, rows: int = TABLE_ROWS):
        self.model, self.rows = model, rows
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 14, np.int64)

    def look_up(self, chunks: list[str]) -> np.ndarray:
        """Table row of each of some distinct chunks; unknown ones are segmented and added."""
        if len(self.row) + len(chunks) > self.rows:
            self.clear()
        new = [c for c in chunks if c not in self.row]
        if new:
            mark = [self.model.piece_to_id(MARK)]
            found = [ids if c else mark for c, ids in zip(new, self.model.encode(new, num_threads=1), strict=True)]
            n, sizes = len(self.row), np.fromiter(map(len, found), np.int64, len(found))
            end = self.bounds[n] + np.cumsum(sizes)
            if n + len(new) + 1 > len(self.bounds):
                self.bounds = np.resize(self.bounds, 2 * (n + len(new) + 1))
            if end[-1] > len(self.ids):
                self.ids = np.resize(self.ids, 2 * int(end[-1]))
            self.ids[self.bounds[n]:end[-1]] = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
            self.bounds[n + 1:n + 1 + len(new)] = end
            self.row.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.row.__getitem__, chunks), np.int64, len(chunks))


def encode_batch(table: ChunkTable, texts: pa.Array, begin: bool = True, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the bounds of each text's ids."""
    out, sizes = [], []
    data, offsets = T.flat(pa.compute.replace_substring(pa.compute.fill_null(texts, ""), MARK, " "))
    for a, b in T.pieces(offsets, 4 * T.PIECE_BYTES):  # fewer look-ups of words that pieces share
        ids, counts = _encode(table, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], begin, end)
        out.append(ids)
        sizes.append(counts)
    bounds = np.zeros(len(offsets), np.int64)
    if sizes:
        np.cumsum(np.concatenate(sizes), out=bounds[1:])
    return (np.concatenate(out) if out else np.empty(0, np.uint32)), bounds


def _encode(table, data, offsets, begin, end):
    model, n = table.model, len(offsets) - 1
    full = np.flatnonzero(np.diff(offsets))
    firsts = offsets[full]
    run = data == 32
    run[1:] &= data[:-1] != 32
    run[firsts] = False  # a run in front of a text belongs to its first chunk
    cuts = np.flatnonzero(run)
    is_cut = np.zeros(len(data) + 1, bool)
    is_cut[cuts] = True
    starts = np.sort(np.concatenate([firsts, cuts]))
    ends = np.append(starts[1:], len(data))
    starts_in = starts + is_cut[starts]  # the run's first mark is the one that the model itself puts in front
    chunks = T.strings(data, starts_in, ends, text=True).dictionary_encode()
    rows = table.look_up(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
    at, size = table.bounds[rows], table.bounds[rows + 1] - table.bounds[rows]
    counts = np.zeros(n, np.int64)
    if len(full):
        counts[full] = np.add.reduceat(size, np.searchsorted(starts, firsts))
    total = counts + begin + end
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(total, out=bounds[1:])
    ids = np.empty(int(bounds[-1]), np.uint32)
    own = np.ones(len(ids), bool)
    if begin:
        ids[bounds[:-1]], own[bounds[:-1]] = model.bos_id(), False
    if end:
        ids[bounds[1:] - 1], own[bounds[1:] - 1] = model.eos_id(), False
    before = np.cumsum(size) - size
    ids[own] = table.ids[np.repeat(at - before, size) + np.arange(int(size.sum()))]
    return ids, total


def encode_decode(docs: DataFrame, model_path: str, begin: bool = True, end: bool = True) -> DataFrame:
    """doc_id, `ids` (little-endian unsigned 32-bit integers, in a binary) and `decoded`, the text that
    the library's decode gives for exactly these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        table = ChunkTable(model)
        for batch in batches:
            column = batch.column("text")
            _, offsets = T.flat(column)
            for a, b in T.pieces(offsets, 4 * T.PIECE_BYTES):
                ids, bounds = encode_batch(table, column[a:b], begin, end)
                parts = [ids[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                decoded = [model.decode(p.tolist()) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()),
                     pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return bounded(docs).select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Row per document: number of ids, and SHA-256 of the ids and of the decoded text."""
    return encoded.select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

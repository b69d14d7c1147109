"""Language identification with language-bitmask n-gram filters.

Text becomes lower-case letter bytes with single spaces between words; its byte n-grams are hashed to
64 bits. A bit-sliced Bloom filter keeps one bitmask of languages per slot; an n-gram sets its
language's bit in three slots, and the bitwise AND of three slots names all languages that hold the
n-gram. Per language, the count of a text's n-grams found is corrected for the filter's false
positives (the cube of the share of slots with the language's bit); the greatest share decides.

Learning is from a bounded sample: of each language the `each` labelled rows whose doc_id hashes lowest
(rows that share the last hash stay), with `each` as great as `sample` rows in all allow, but never under
a 64th of `sample`. So every language is learned, however rare. An n-gram enters a language's filter when
at least `least_docs` sample documents of that language hold it, or all, if there are fewer. What comes
to the driver is the hashes near the sample's bounds and one bitmask per slot, whatever the input's size.
Any number of languages fits; the mask has a byte per eight.

Texts that are null or have no letter get `und` with score 0, as do all when nothing was learned.
Ties go to the language with more sample rows, then to the smaller name. Whole texts are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbusops.llm import text as T
from nimbusops.llm.batches import bounded, tidy

SAMPLE = 8192
SIZES = (3, 5)
LOG_SLOTS = 21
PROBES = 3
UNKNOWN = "und"
LETTERED = "has_any_letter__"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    languages: list[str]  # by falling number of sample rows
    masks: np.ndarray  # slots x bytes of languages
    false_rate: np.ndarray  # per language


def grams(data: np.ndarray, offsets: np.ndarray, sizes=SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the hashes of the n-grams of all texts, in order of texts, and the bounds of each text's."""
    n = len(offsets) - 1
    # One space in front of each text and one behind, so that short words have n-grams as well.
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    shift = np.repeat(2 * np.arange(n) + 1, np.diff(offsets))
    body = T.LOWER[data]
    body[~_LETTER[body]] = 32
    padded[np.arange(len(data)) + shift] = body
    edges = offsets + 2 * np.arange(n + 1)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    keep[edges[:-1]] = True
    kept_before = np.zeros(len(padded) + 1, np.int64)
    np.cumsum(keep, out=kept_before[1:])
    clean, edges = padded[keep].astype(np.uint64), kept_before[edges]
    owner = np.repeat(np.arange(n), np.diff(edges))
    for size in sizes:
        value = np.full(max(0, len(clean) - size + 1), size, np.uint64)
        for i in range(size):
            value = (value << np.uint64(8)) | clean[i:len(value) + i]
        inside = owner[:len(value)] == owner[len(owner) - len(value):]
        value = value[inside] * _MIX
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
        yield value, np.searchsorted(owner[:len(inside)][inside], np.arange(n + 1))


def slots(hashes: np.ndarray, log_slots: int) -> Iterator[np.ndarray]:
    for i in range(PROBES):
        yield ((hashes >> np.uint64(i * log_slots)) & np.uint64((1 << log_slots) - 1)).astype(np.int64)


def _counted(of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return of[at], hashes[at], np.diff(np.append(at, len(of)))


def rows_each(counts: list[int], sample: int) -> int:
    """Rows of each language that make `sample` rows in all at most, but a 64th of `sample` at least."""
    left, each = sample, sample
    for i, n in enumerate(sorted(counts)):
        each = left // (len(counts) - i)
        if n > each:
            break
        left, each = left - n, sample
    return max(each, -(-sample // 64), 2)


def _bounds(labelled: DataFrame, sample: int) -> dict[str, int]:
    """Per language the greatest hash of its sample. Rows are counted by the bits of their hash's distance
    from the least long; only the hashes of the bits that hold the bound, some `each` of a language, come
    to the driver."""
    hashed = labelled.select("lang", F.xxhash64("doc_id").alias("h"))
    size = F.length(F.bin(F.col("h").bitwiseXOR(F.lit(-(1 << 63)))))
    per_size = defaultdict(dict)
    for r in hashed.groupBy("lang", size.alias("size")).agg(F.count("*").alias("n")).collect():  # 64 rows a language at most
        per_size[r["lang"]][r["size"]] = r["n"]
    each = rows_each([sum(x.values()) for x in per_size.values()], sample)
    before, edges = {}, []
    for lang, x in per_size.items():
        before[lang] = 0
        for s in sorted(x):
            if before[lang] + x[s] >= each or s == max(x):
                edges.append((lang, s))
                break
            before[lang] += x[s]
    if not edges:
        return {}
    edge = labelled.sparkSession.createDataFrame(edges, "lang string, edge int")
    near = hashed.join(F.broadcast(edge), "lang").where(size == F.col("edge")).groupBy("lang", "h").agg(F.count("*").alias("n"))
    bounds = {}
    for r in sorted(near.collect(), key=lambda r: r["h"]):
        if before[r["lang"]] < each:
            bounds[r["lang"]] = r["h"]
            before[r["lang"]] += r["n"]
    return bounds


def training_rows(docs: DataFrame, learn: Column, sample: int) -> DataFrame:
    """Labelled rows of the sample. Only ids and labels are read to find its bounds."""
    labelled = bounded(docs).where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    bounds = labelled.sparkSession.createDataFrame(list(_bounds(labelled, sample).items()), "lang string, bound long")
    return labelled.join(F.broadcast(bounds), "lang").where(F.xxhash64("doc_id") <= F.col("bound")).select("doc_id", "lang", "text")


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE, least_docs: int = 2, log_slots: int = LOG_SLOTS) -> Model:
    rows = training_rows(docs, learn, sample)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    if not languages:
        return Model([], np.zeros((1 << log_slots, 1), np.uint8), np.zeros(0))
    number = {x: i for i, x in enumerate(languages)}

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.flat(batch.column("text"))
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for a, b in T.pieces(offsets):
                for hashes, bounds in grams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]):
                    doc, hashes, _ = _counted(np.repeat(np.arange(b - a), np.diff(bounds)), hashes)
                    of, hashes, docs = _counted(lang[a:b][doc], hashes)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(of), pa.array(docs)],
                                                     ["gram", "lang", "docs"])

    enough = F.col("docs") >= least_docs
    for n in range(1, least_docs):  # languages with n sample rows or fewer are the last ones
        enough |= (F.col("docs") >= n) & (F.col("lang") >= sum(x > n for x in counts.values()))

    held = rows.mapInArrow(tidy(distinct), "gram long, lang long, docs long").groupBy("gram", "lang").agg(
        F.sum("docs").alias("docs")).where(enough)
    probes = F.array(*[F.shiftrightunsigned("gram", i * log_slots).bitwiseAND(F.lit((1 << log_slots) - 1)) for i in range(PROBES)])
    bits = held.select(F.explode(probes).alias("slot"), F.expr("lang div 8").alias("byte"), F.expr("shiftleft(1, cast(lang % 8 as int))").alias("bit"))
    filled = bits.groupBy("slot", "byte").agg(F.bit_or("bit").alias("mask")).select(
        F.col("slot").cast("int"), F.col("byte").cast("short"), F.col("mask").cast("short")).toArrow()
    masks = np.zeros((1 << log_slots, -(-len(languages) // 8)), np.uint8)
    masks[filled["slot"].to_numpy(), filled["byte"].to_numpy()] = filled["mask"].to_numpy()
    share = np.unpackbits(masks, axis=1, bitorder="little")[:, :len(languages)].mean(axis=0)
    return Model(languages, masks, share ** PROBES)


def shares(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text and language the share of n-grams found, corrected for false positives."""
    total, found = np.zeros(len(offsets) - 1, np.int64), np.zeros((len(offsets) - 1, len(model.languages)), np.int64)
    for hashes, bounds in grams(data, offsets):
        total += np.diff(bounds)
        mask = None
        for at in slots(hashes, model.masks.shape[0].bit_length() - 1):
            mask = model.masks[at] if mask is None else mask & model.masks[at]
        for i in range(len(model.languages)):
            found[:, i] += T.sums((mask[:, i // 8] >> np.uint8(i % 8)) & 1, bounds)
    raw = found / np.maximum(total, 1)[:, None]
    return np.clip((raw - model.false_rate) / np.maximum(1e-9, 1 - model.false_rate), 0, 1)


def _judged(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Name and score of each row of a batch with columns text and `LETTERED`."""
    data, offsets = T.flat(batch.column("text"))
    best, score = np.zeros(len(batch), np.int64), np.zeros(len(batch))
    if model.languages:
        for a, b in T.pieces(offsets):
            found = shares(model, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            best[a:b], score[a:b] = found.argmax(axis=1), found.max(axis=1)
    known = batch.column(LETTERED).to_numpy(zero_copy_only=False) & bool(model.languages)
    names = np.array([*model.languages, UNKNOWN], object)
    return names[np.where(known, best, len(model.languages))], np.where(known, score, 0.0)


def _sent(docs: DataFrame, model: Model):
    """The model for tasks: slots x languages bits, a size that parameters set."""
    return docs.sparkSession.sparkContext.broadcast((model.languages, model.masks, model.false_rate))


def _lettered():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(LETTERED)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each row; only the text is looked at."""
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = _judged(batch, Model(*sent.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    return bounded(docs).select("doc_id", "text", _lettered()).mapInArrow(
        tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def known_language(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The rows of docs, as they are, whose text is of a learned language with at least this score."""
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = _judged(batch, Model(*sent.value))
            yield batch.filter(pa.array((names != UNKNOWN) & (score >= least_score))).drop_columns([LETTERED])

    return bounded(docs).select("*", _lettered()).mapInArrow(tidy(run), docs.schema)

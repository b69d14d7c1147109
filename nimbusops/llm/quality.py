"""Quality scores by random-indexing word vectors, pooled per document, and a two-layer network.

Tokens are runs of letters and digits, as written, and runs of other signs without white space. Every token has an
index vector of `NONZERO` plus and minus ones, placed by its hash. The vector of a word is learned by adding up the index
vectors of the tokens around its occurrences (two to each side) in all texts: for the `vocabulary` tokens
of the most documents one by one, for all others by kind (how they are cased and how long they are). Sums
are whole numbers, so they don't depend on how rows are dealt. Learned vectors lose the mean of all and
get length one; a token's vector in a text is that plus its own index vector.

A document becomes the mean and the standard deviation of its tokens' vectors, the length of that mean,
the mean product of the vectors of neighbouring tokens (high where words are repeated) and one over the root of
the number of tokens, the scale of the noise in all of these, which goes to nothing in texts of any greater
length. An empty text has zeros, and one as the last.

The network (tanh, then one logit) is fitted on the driver, on at most `sample` labelled documents of
each label, those whose id hashes lowest, weighted back to the labels' numbers. A fifth of them, by
another hash, is left out of the fit and sets the temperature that divides the logit, so that scores are
probabilities.

A doc_id that labels repeat has its highest quality; of rows that repeat a doc_id the sample takes the
least text. Labels that are null, and rows without an id, are not learned from. With labels of one
kind alone, or none, every score is their share of ones (without any: 0.5). Every row gets its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbusops.llm import text as T
from nimbusops.llm.batches import bounded, merged, tidy
from nimbusops.session import Staging

VOCABULARY = 8192
SAMPLE = 4096
SIZE = 64  # of a vector, a power of two up to 64
NONZERO = 4
WINDOW = 2
HIDDEN = 32
LONGEST = 32  # bytes of a vocabulary token
PIECE = 1 << 18  # bytes of text that numpy works on at a time; vectors are some 150 times that
KINDS = 32

_GAP, _WORD, _SIGN = range(3)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[T.SPACE] = _GAP
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _WORD


@dataclass
class Model:
    words: list[bytes]
    vectors: np.ndarray  # of the words, then of the kinds
    layers: list[np.ndarray]
    temperature: float
    share: float


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, and the number of tokens up to each text."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets] = True
    edges = np.flatnonzero(new)
    inside = kind[edges[:-1]] != _GAP
    starts = edges[:-1][inside]
    return starts, edges[1:][inside], np.searchsorted(starts, offsets)


def _coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    coded = T.strings(data, starts, ends).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def kinds(words: pa.Array) -> np.ndarray:
    """A number below `KINDS` for the case (or sort) of a token and its length."""
    data, offsets = T.flat(words)
    size = np.diff(offsets)
    upper, lower, digit = (T.sums(((data >= a) & (data <= b)).astype(np.int64), offsets) for a, b in ((65, 90), (97, 122), (48, 57)))
    sign = _CLASS[data[offsets[:-1]]] == _SIGN if len(size) else np.empty(0, bool)
    case = np.select([sign, digit > 0, (upper > 1) & (lower == 0), upper == 1, upper == 0], [0, 1, 2, 3, 4], 5)
    return case * 4 + np.minimum(np.searchsorted([2, 5, 10], size, "left"), 3)


def indices(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each token's index vector."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    step = np.arange(NONZERO, dtype=np.uint64)
    place = (hashes[:, None] >> (step * np.uint64(8))) % np.uint64(SIZE)
    sign = ((hashes[:, None] >> (step + np.uint64(48))) & np.uint64(1)).astype(np.int64) * 2 - 1
    return place.astype(np.int64), sign


def _numbers(known: pa.Array, words: pa.Array) -> np.ndarray:
    """Row of each token in the table of vectors."""
    found = pc.index_in(words, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
    return np.where(found >= 0, found, len(known) + kinds(words))


def contexts(known: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the index vectors around the occurrences of each row of the table of vectors."""
    total = np.zeros((len(known) + KINDS) * SIZE, np.int64)
    starts, ends, upto = tokens(data, offsets)
    if not len(starts):
        return total
    words, codes = _coded(data, starts, ends)
    row = _numbers(known, words)[codes] * SIZE
    place, sign = indices(words)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(upto))
    for step in range(1, WINDOW + 1):
        left, right = codes[:-step], codes[step:]
        same = of[step:] == of[:-step]
        for near, far in ((row[:-step], right), (row[step:], left)):
            near, far = near[same], far[same]
            for i in range(NONZERO):
                total += np.bincount(near + place[far, i], weights=sign[far, i], minlength=len(total)).astype(np.int64)
    return total


def document_counts(docs: DataFrame) -> DataFrame:
    """word and n, the number of documents that hold it, of words up to `LONGEST` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, T.PIECE_BYTES):
            data, offsets = T.flat(batch.column("text"))
            for a, b in T.pieces(offsets):
                starts, ends, upto = tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                of = np.repeat(np.arange(b - a), np.diff(upto))
                short = ends - starts <= LONGEST
                words, codes = _coded(data[offsets[a]:offsets[b]], starts[short], ends[short])
                pairs = np.unique(of[short] * max(1, len(words)) + codes)
                n = np.bincount(pairs % max(1, len(words)), minlength=len(words))
                yield pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64))], ["word", "n"])

    return bounded(docs).select("text").mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_vectors(docs: DataFrame, words: list[bytes]) -> np.ndarray:
    """The learned vector of each word and then of each kind, of length one or zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = pa.array(words, pa.binary()), np.zeros((len(words) + KINDS) * SIZE, np.int64)
        for batch in merged(batches, T.PIECE_BYTES):
            data, offsets = T.flat(batch.column("text"))
            for a, b in T.pieces(offsets):
                total += contexts(known, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        rows = total.reshape(-1, SIZE)
        used = np.flatnonzero(rows.any(axis=1))
        values = pa.FixedSizeListArray.from_arrays(pa.array(rows[used].ravel()), SIZE).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used), values], ["row", "v"])

    parts = bounded(docs).select("text").mapInArrow(tidy(run), "row long, v array<long>")
    summed = parts.groupBy("row").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(SIZE)])
    got = summed.toArrow()  # at most a row per word and kind
    total = np.zeros((len(words) + KINDS, SIZE))
    total[got["row"].to_numpy()] = np.stack([got[f"v{i}"].to_numpy() for i in range(SIZE)], axis=1)
    total -= total.sum(axis=0) * (np.abs(total).sum(axis=1) / max(1.0, np.abs(total).sum()))[:, None]
    return (total / np.maximum(np.linalg.norm(total, axis=1), 1e-9)[:, None]).astype(np.float32)


def pooled(known: pa.Array, vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features per text."""
    n_texts = len(offsets) - 1
    first, second, beside, count = np.zeros((n_texts, SIZE)), np.zeros((n_texts, SIZE)), np.zeros(n_texts), np.zeros(n_texts)
    # A long text comes in parts, cut between bytes of one class at worst, which adds a token.
    at = np.unique(np.concatenate([offsets, np.arange(0, len(data), PIECE)]))
    for a, b in T.pieces(at, PIECE):
        starts, ends, upto = tokens(data[at[a]:at[b]], at[a:b + 1] - at[a])
        if not len(starts):
            continue
        words, codes = _coded(data[at[a]:at[b]], starts, ends)
        table = vectors[_numbers(known, words)]
        place, sign = indices(words)
        np.add.at(table, (np.arange(len(words))[:, None], place), sign.astype(np.float32) / np.float32(np.sqrt(NONZERO)))
        some = np.flatnonzero(np.diff(upto))
        of = np.searchsorted(offsets, at[a:b][some], "right") - 1
        each = table[codes]
        np.add.at(first, of, np.add.reduceat(each, upto[some], axis=0))
        np.add.at(second, of, np.add.reduceat(each * each, upto[some], axis=0))
        alike = np.append(np.einsum("ij,ij->i", each[1:], each[:-1]), 0)
        alike[upto[some + 1] - 1] = 0  # the last of a text has no neighbour
        np.add.at(beside, of, np.add.reduceat(alike, upto[some]))
        np.add.at(count, of, np.diff(upto)[some])
    n = np.maximum(count, 1)[:, None]
    mean = first / n
    spread = np.sqrt(np.maximum(second / n - mean * mean, 0))
    return np.hstack([mean, spread, np.linalg.norm(mean, axis=1)[:, None], beside[:, None] / n, 1 / np.sqrt(n)])


def features(docs: DataFrame, words: list[bytes], vectors: np.ndarray, *columns: str) -> DataFrame:
    """The named columns of docs and `x`, the features of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.binary())
        for batch in batches:
            x = pooled(known, vectors, *T.flat(batch.column("text")))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), lists], [*columns, "x"])

    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return bounded(docs).select(*columns, "text").mapInArrow(tidy(run), f"{types}, x array<double>")


def _logits(layers: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    shift, scale, w, b, v, c = layers
    return np.tanh((x - shift) / scale @ w + b) @ v + c[0]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = HIDDEN, rounds: int = 400, rate: float = 0.01, decay: float = 1e-4) -> list[np.ndarray]:
    """Layers by Adam steps on the weighted likelihood of all rows."""
    draw = np.random.default_rng(5)
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, weight = (x - shift) / scale, weight / weight.sum()
    layers = [draw.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    means, squares = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, rounds + 1):
        w, b, v, c = layers
        h = np.tanh(z @ w + b)
        slope = weight * (1 / (1 + np.exp(-np.clip(h @ v + c[0], -60, 60))) - y)
        back = slope[:, None] * v * (1 - h * h)
        for i, g in enumerate((z.T @ back + decay * w, back.sum(axis=0), h.T @ slope + decay * v, slope.sum(keepdims=True))):
            means[i] = 0.9 * means[i] + 0.1 * g
            squares[i] = 0.999 * squares[i] + 0.001 * g * g
            layers[i] = layers[i] - rate * means[i] / (1 - 0.9**step) / (np.sqrt(squares[i] / (1 - 0.999**step)) + 1e-8)
    return [shift, scale, *layers]


def temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the logits under which the labels are likeliest."""
    if not len(y):
        return 1.0
    tried = np.exp(np.linspace(np.log(0.25), np.log(20), 200))
    signed = np.where(y > 0, logits, -logits)
    return float(tried[int(np.argmin([(weight * np.logaddexp(0, -signed / t)).sum() for t in tried]))])


def sample_rows(docs: DataFrame, labels: DataFrame, learn: Column, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, label of the sample (one row per doc_id), and the number of labelled ids by label."""
    one = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") > 0).cast("int")).alias("label")).withColumn("h", F.xxhash64("doc_id"))
    one = Staging(docs.sparkSession).write("labels", one)
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    bounds = {k: one.where(F.col("label") == k).select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0] for k in counts}
    chosen = one.where(F.coalesce(*[F.when(F.col("label") == k, F.col("h") <= h) for k, h in bounds.items()], F.lit(False)))
    near = docs.where(F.xxhash64("doc_id") <= max(bounds.values(), default=0)).select("doc_id", "text")
    joined = near.join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")  # at most `sample` ids of each label
    return joined.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), counts


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Model:
    """`learn` is a condition on labels."""
    rows, counts = sample_rows(docs, labels, learn, sample)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if not 0 < share < 1:
        return Model([], np.zeros((KINDS, SIZE), np.float32), [], 1.0, share)
    top = Staging(docs.sparkSession).write("top", document_counts(docs).orderBy(F.desc("n"), "word").limit(vocabulary))
    words = sorted(bytes(r["word"]) for r in top.select("word").collect())
    vectors = word_vectors(docs, words)
    got = features(rows, words, vectors, "doc_id", "label").toArrow().sort_by("doc_id")
    x = np.array(got["x"].to_pylist()).reshape(len(got), 2 * SIZE + 3)
    y = got["label"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):  # documents of one label alone
        return Model([], np.zeros((KINDS, SIZE), np.float32), [], 1.0, share)
    weight = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, len(y) - y.sum()))
    aside = np.array([xxhash.xxh64_intdigest(str(i), 1) % 5 == 0 for i in got["doc_id"].to_pylist()])
    if not 0 < y[~aside].sum() < (~aside).sum():
        aside[:] = False
    layers = fit(x[~aside], y[~aside], weight[~aside])
    return Model(words, vectors, layers, temperature(_logits(layers, x[aside]), y[aside], weight[aside]), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability of good quality, per row of docs."""
    words, vectors, layers, heat, share = model.words, model.vectors, model.layers, model.temperature, model.share  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.binary())
        for batch in batches:
            p = np.full(len(batch), share)
            if layers:
                x = pooled(known, vectors, *T.flat(batch.column("text")))
                p = 1 / (1 + np.exp(-np.clip(_logits(layers, x) / heat, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    own = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs).select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {own}, score double")

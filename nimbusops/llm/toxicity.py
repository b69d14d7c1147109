"""Severity grades by cumulative-link ordinal regression on sparse word features.

P(grade >= k) = sigmoid(w . x - t_k): one weight vector for all thresholds, which are kept in order.
x marks the words and word beginnings (6 and 7 bytes) a text holds, out of a vocabulary of at most
`vocabulary` of them whose use the sample shows to differ: chi-square, at least `least_chi`, of a word's distinct neighbourhoods (the word before
and the one after) in toxic and other texts. Copies of a text add no neighbourhoods, so words of a text
that was copied often do not look toxic.
The expected severity is the sum of P(grade >= k) over k. A text is toxic from the value of w . x on that
parts the sample best (by F1, in the middle of the gap).

Grades: 0 is not toxic. Labels do not grade toxic texts, so the sample's toxic texts are split by how
much of the vocabulary they hold: 1 up to the median, 2 above it.

The model is fitted on the driver from a bounded sample: the `sample` labelled documents whose id
hashes lowest (those that share the last hash stay), each with at most the vocabulary's words. A doc_id that
labels repeat is toxic if one of them says so; of rows that repeat a doc_id the sample takes the least text. Word counts for the choice of the vocabulary are aggregated by Spark.

Texts that are null or hold no vocabulary word get the value of an empty text. Without labels of
toxic texts every severity is 0. Labels that are null are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbusops.llm import text as T
from nimbusops.llm.batches import bounded, tidy
from nimbusops.session import Staging

SAMPLE = 8192
VOCABULARY = 4096
LEAST_CHI = 50.0
BEGINNINGS = (6, 7)

_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


@dataclass
class Model:
    words: list[bytes]
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = np.inf


def best_cut(z: np.ndarray, toxic: np.ndarray) -> float:
    """The value that parts toxic from other texts with the highest F1, in the middle between two values."""
    values, place = np.unique(z, return_inverse=True)
    hits = np.cumsum(np.bincount(place, weights=toxic)[::-1])[::-1]  # toxic ones from each value on
    chosen = np.cumsum(np.bincount(place)[::-1])[::-1]
    best = int(np.argmax(2 * hits / (chosen + toxic.sum())))
    return float(values[best] if best == 0 else (values[best] + values[best - 1]) / 2)


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in place, and the text it is in."""
    starts, ends, upto = T.words(data, offsets, _APART)
    coded = T.strings(T.LOWER[data] if len(data) else data, starts, ends).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.repeat(np.arange(len(offsets) - 1), np.diff(upto))


def variants(words: pa.Array) -> list[pa.Array]:
    """The words themselves and the beginnings of longer ones, marked by a star; null where there is none."""
    out = [words]
    for size in BEGINNINGS:
        longer = pc.greater(pc.binary_length(words), size)
        cut = pc.binary_join_element_wise(pc.binary_slice(words, 0, size), b"*", b"")
        out.append(pc.if_else(longer, cut, pa.scalar(None, words.type)))
    return out


def features(words: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, vocabulary number) pairs, ordered by text."""
    distinct, codes, of = word_codes(data, offsets)
    found = []
    for kind in variants(distinct):
        known = pc.index_in(kind, value_set=words).fill_null(-1).to_numpy()
        number = known[codes] if len(codes) else np.empty(0, np.int64)
        found.append(of[number >= 0] * np.int64(max(1, len(words))) + number[number >= 0])
    pairs = np.unique(np.concatenate(found))
    return pairs // max(1, len(words)), pairs % max(1, len(words))


def fit(text: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_features: int, rounds: int = 1500, rate: float = 0.1,
        decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam steps on the whole sample's likelihood."""
    top = int(grade.max())
    w, gaps = np.zeros(n_features), np.zeros(top)
    share = [np.clip((grade >= k).mean(), 1e-3, 1 - 1e-3) for k in range(1, top + 1)]
    first = np.log((1 - np.array(share)) / np.array(share))
    gaps[0], gaps[1:] = first[0], np.log(np.maximum(np.diff(first), 0.1))
    state = [np.zeros(n_features + top), np.zeros(n_features + top)]
    for step in range(1, rounds + 1):
        t = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        z = np.bincount(text, weights=w[feature], minlength=len(grade))
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        upper, lower = (1 / (1 + np.exp(np.clip(edges[grade + i] - z, -60, 60))) for i in (0, 1))  # P(>= grade), P(> grade)
        p = np.maximum(upper - lower, 1e-9)
        slope_u, slope_l = upper * (1 - upper), lower * (1 - lower)
        by_z = (slope_u - slope_l) / p / len(grade)
        by_t = np.array([(-(slope_u / p)[grade == k].sum() + (slope_l / p)[grade == k - 1].sum()) / len(grade) for k in range(1, top + 1)])
        after = np.cumsum(by_t[::-1])[::-1]
        by_gaps = np.concatenate([after[:1], after[1:] * np.exp(gaps[1:])])
        slope = np.concatenate([decay * w - np.bincount(feature, weights=by_z[text], minlength=n_features), -by_gaps])
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.999 * state[1] + 0.001 * slope**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w, gaps = w - move[:n_features], gaps - move[n_features:]
    return w, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, grade (0 or 1, toxic) and text of the labelled sample, one row per doc_id."""
    graded = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("toxic") == 0, 0).otherwise(1)).alias("grade")).withColumn("h", F.xxhash64("doc_id"))
    graded = Staging(docs.sparkSession).write("labels", graded)
    bound = graded.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    near = F.xxhash64("doc_id") <= (bound if bound is not None else 0)
    chosen = graded.where(near).select("doc_id", "grade")
    joined = bounded(docs).select("doc_id", "text").where(near).join(F.broadcast(chosen), "doc_id")  # at most `sample` ids
    return joined.groupBy("doc_id", "grade").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY, least_chi: float = LEAST_CHI) -> Model:
    rows = sample_rows(docs, labels, sample)
    sizes = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # two rows
    clean, toxic = sizes.get(0, 0), sum(n for grade, n in sizes.items() if grade)
    if not toxic or not clean:
        return Model([], np.zeros(0), np.zeros(0))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.flat(batch.column("text"))
            is_toxic = batch.column("grade").to_numpy() > 0
            for a, b in T.pieces(offsets):
                words, codes, of = word_codes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))[codes]
                around = np.zeros(len(codes), np.uint64)
                if len(codes):
                    same = of[1:] == of[:-1]
                    around[1:][same] = hashes[:-1][same] * np.uint64(3)
                    around[:-1][same] ^= hashes[1:][same]
                for kind in variants(words):
                    coded = kind.dictionary_encode()
                    number = coded.indices.fill_null(-1).to_numpy()[codes] if len(codes) else codes
                    own = number >= 0
                    order = np.lexsort((is_toxic[a:b][of[own]], around[own], number[own]))
                    keys = np.stack([number[own][order].astype(np.int64), around[own][order].view(np.int64), is_toxic[a:b][of[own]][order]])
                    new = np.ones(keys.shape[1], bool)
                    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [coded.dictionary.take(pa.array(keys[0][new])), pa.array(keys[1][new]), pa.array(keys[2][new].astype(bool))],
                        ["word", "around", "toxic"])

    held = rows.mapInArrow(tidy(contexts), "word binary, around long, toxic boolean").distinct().groupBy("word").agg(
        F.count_if("toxic").alias("a"), F.count("*").alias("n"))
    held = Staging(docs.sparkSession).write("contexts", held)
    totals = held.agg(F.sum("a"), F.sum("n")).first()
    share = totals[0] / totals[1] if totals[1] else 0.0
    if not 0 < share < 1:
        return Model([], np.zeros(0), np.zeros(0))
    chi = F.pow(F.col("a") - F.col("n") * share, 2) / (F.col("n") * share * (1 - share))
    chosen = held.withColumn("chi", chi).where(F.col("chi") >= least_chi).orderBy(F.desc("chi"), "word").limit(vocabulary)
    words = sorted(bytes(r["word"]) for r in chosen.select("word").collect())
    if not words:
        return Model([], np.zeros(0), np.zeros(0))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(words, pa.binary())
        for batch in batches:
            of, number = features(value_set, *T.flat(batch.column("text")))
            bounds = np.searchsorted(of, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(number.astype(np.int32)))], ["grade", "x"])

    got = rows.mapInArrow(tidy(marked), "grade int, x array<int>").toArrow()
    texts = sorted(zip(got["grade"].to_pylist(), got["x"].to_pylist(), strict=True))  # sums in one order, whatever the tasks
    counts = np.array([len(x) for _, x in texts])
    grade = np.array([g for g, _ in texts], np.int64)
    grade[(grade > 0) & (counts > np.median(counts[grade > 0]))] = 2
    text, feature = np.repeat(np.arange(len(counts)), counts), np.array([i for _, x in texts for i in x], np.int64)
    weights, thresholds = fit(text, feature, grade, len(words))
    return Model(words, weights, thresholds, best_cut(np.bincount(text, weights=weights[feature], minlength=len(counts)), grade > 0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (the most probable one) and toxic per row."""
    words, weights, thresholds, cut = model.words, model.weights, model.thresholds, model.cut  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(words, pa.binary())
        for batch in batches:
            data, offsets = T.flat(batch.column("text"))
            z = np.zeros(len(batch))
            for a, b in T.pieces(offsets) if words else ():
                of, number = features(value_set, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                z[a:b] = np.bincount(of, weights=weights[number], minlength=b - a)
            at_least = 1 / (1 + np.exp(np.clip(thresholds[None, :] - z[:, None], -60, 60)))
            p = -np.diff(np.hstack([np.ones((len(z), 1)), at_least, np.zeros((len(z), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(at_least.sum(axis=1)),
                                              pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(z >= cut)],
                                             ["doc_id", "severity", "grade", "toxic"])

    return bounded(docs).select("doc_id", "text").mapInArrow(
        tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, severity double, grade int, toxic boolean")

"""Near duplicates by 64-bit SimHash fingerprints and exact tiled comparison.

Fingerprint: A-Z in lower case, words between ASCII white space, shingles of three words joined by one
space (repeats count; fewer words make one shingle), XXH64 with seed 42 of each; a bit is one if more
than half of the hashes have it. Texts without words, null ones included, have fingerprint zero and
are linked like any other.

Links: equal fingerprints are merged first, so copies cost nothing. Distinct fingerprints are dealt to
tiles of one population count each. Two fingerprints within the radius differ by no more than that in
their counts, so only tiles of near counts meet; each meeting is one task's exclusive-or and bit count
of at most two tiles. Of the links a task finds it returns a spanning star per group, never all pairs.
Groups over all tasks come from alternating large and small stars on written tables.

The comparison is exact and therefore quadratic in the number of distinct fingerprints within near
counts; tiles keep memory and the size of a task bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbusops.llm import text as T
from nimbusops.llm.batches import bounded, tidy
from nimbusops.llm.components import components
from nimbusops.session import Staging

TILE = 8192
MEETINGS = 16  # of tiles in a task
SEED = 42


def _fingerprints(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    starts, ends, upto = T.words(data, offsets)
    result = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return result
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - 1  # ends in the text that has one space behind each word
    at = to - sizes
    joined = np.full(int(to[-1]) + 1, 32, np.uint8)
    gap = np.zeros(len(joined), bool)
    gap[to] = True
    joined[~gap] = T.LOWER[data[T.covered(len(data), starts, ends)]]
    body = joined.tobytes()
    counts = np.diff(upto)
    full = np.flatnonzero(counts)
    n_shingles = np.maximum(counts[full] - size + 1, 1)
    bounds = np.cumsum(n_shingles) - n_shingles
    first = np.repeat(upto[:-1][full] - bounds, n_shingles) + np.arange(int(n_shingles.sum()))
    last = first + np.repeat(np.minimum(counts[full], size) - 1, n_shingles)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(body[i:j], SEED) for i, j in zip(at[first].tolist(), to[last].tolist(), strict=True)),
                         np.uint64, len(first))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.add.reduceat(bits, bounds, axis=0, dtype=np.int32)
    ones = np.packbits(2 * votes > n_shingles[:, None], axis=1, bitorder="little")
    result[full] = np.ascontiguousarray(ones).view("<u8").ravel()
    return result


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and `fp`, the fingerprint as a long (two's complement)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.flat(batch.column("text"))
            parts = [_fingerprints(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size) for a, b in T.pieces(offsets)]
            fps = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return bounded(docs).select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, least member) of the groups that two tiles, or one tile with itself, form."""
    nodes = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    label = np.arange(len(nodes))
    step = max(1, (1 << 20) // max(1, len(other)))
    for i in range(0, len(a), step):
        near = np.bitwise_count(a[i:i + step, None] ^ other[None, :]) <= radius
        x, y = np.nonzero(near)
        x, y = x + i, y + shift
        x, y = x[x != y], y[x != y]
        while len(x):
            low = np.minimum(label[x], label[y])
            if (label[x] == label[y]).all():
                break
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, label[y], low)
            while (label[label] != label).any():
                label = label[label]
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[member], nodes[label[member]]


def links(distinct: DataFrame, staging: Staging, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Star links (a, b) between distinct fingerprints (column fp) that lie within the radius."""
    counted = distinct.select("fp", F.bit_count("fp").alias("ones"))
    histogram = dict.fromkeys(range(65), 0) | {r["ones"]: r["n"] for r in counted.groupBy("ones").agg(F.count("*").alias("n")).collect()}
    tiles = [-(-histogram[ones] // tile) for ones in range(65)]  # at most 65 numbers come to the driver
    n_tiles: Column = F.array(*map(F.lit, tiles))
    bodies = (
        counted.withColumn("part", F.pmod(F.xxhash64("fp"), F.element_at(n_tiles, F.col("ones") + 1)).cast("int"))
        .groupBy("ones", "part").agg(F.collect_list("fp").alias("fps")))
    own = F.struct("ones", "part")
    near = F.filter(F.sequence(F.col("ones") - radius, F.col("ones") + radius), lambda c: c.between(0, 64))
    partners = F.flatten(F.transform(near, lambda c: F.transform(
        F.filter(F.sequence(F.lit(0), F.element_at(n_tiles, c + 1)), lambda p: p < F.element_at(n_tiles, c + 1)),
        lambda p: F.struct(c.alias("ones"), p.alias("part")))))
    meetings = bodies.select("ones", "part", "fps", F.explode(partners).alias("partner")).select(
        F.least(own, "partner").alias("x"), F.greatest(own, "partner").alias("y"), "fps")

    def compare(table: pa.Table) -> pa.Table:
        bodies = [np.asarray(v.values).view(np.uint64) for v in table.column("fps")]
        member, least = _links(bodies[0], bodies[1] if len(bodies) > 1 else None, radius)
        return pa.table({"a": member.view(np.int64), "b": least.view(np.int64)})

    # A meeting is few bytes and much work, so tasks are dealt by meetings, not by bytes.
    n_meetings = sum(n * (n + 1) // 2 + n * sum(tiles[ones + 1:ones + radius + 1]) for ones, n in enumerate(tiles))
    dealt = meetings.repartition(max(1, -(-n_meetings // MEETINGS)), "x", "y")
    return dealt.groupBy("x", "y").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach. One row per row of docs."""
    staging = Staging(docs.sparkSession)
    prints = staging.write("prints", fingerprints(docs, size))
    distinct = staging.write("distinct", prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(staging.write("links", links(distinct, staging, radius, tile)), staging)
    least = staging.write("groups", distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")))
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = least.select("fp", "root").join(whole, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group. Rows that repeat an id stay or go together."""
    kept = Staging(docs.sparkSession).write("kept", near_duplicates(docs, size, radius).where(
        "doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct())
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")

"""Removal of repeated byte strings: each byte covered by a string of `length` bytes that also starts
earlier (in a smaller doc_id, or earlier in the same text) goes. Strings are judged on the input.

1. Anchors. Every string of `length` bytes chooses the 32 bytes inside it whose hash is least, the
   first of equals. Equal strings choose equally, so they meet at the hash of their anchor. Neighbouring
   strings mostly share an anchor; such a run and the bytes under it make one context, about one per 32
   bytes of text. Only hashes and places are shuffled.
2. Contexts of one anchor whose hashes are equal are claims: every later one claims to repeat the earliest, or the one
   before in the same text.
   Within a task's piece of text they are found before the shuffle, and neighbours that claim
   neighbours merge, so a hot anchor sends a row per piece and context at most. Claims are cut at every `CHUNK`
   bytes of the text they point to. Their bytes meet the bytes they point to in a join on that place,
   whose one side is unique; batches of its rows go through the transform (see bwt), so that no hot passage needs one task.
3. Where an anchor has several contexts, every string in them holds one of three blocks of
   `length` - 22 bytes around the anchor, by its place. Only contexts that share a block's hash with
   another one can share a string. The earliest of each such context, cut down to the strings with
   shared blocks, is cut out of its text and sent to the anchor's task, and goes through the transform there, in
   blocks of whole anchors. An anchor with more than `HOT` contexts is split: each of its strings goes
   on its own, to the task of that string's hash, but for those that repeat one of the same task by the transform.
4. The covered bytes are cut out of each text.

Texts are joined to places by id and the 64-bit hash of the text (`tag`), which tells rows that repeat
an id apart: they are ordered by that hash. Rows that repeat both count as one document, and each gets its result.
Null texts count as empty, null ids come first. doc_id must be an integer. Hashes of 64 bits
only choose what is compared: a byte goes only where the transform found its string twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbusops.llm import bwt
from nimbusops.llm import text as T
from nimbusops.llm.batches import bounded, tidy
from nimbusops.session import Staging

LENGTH = 100
GRAM = 32  # bytes of an anchor, a power of two
HOT = 2048
BLOCKS = 3  # of BLOCK_BITS of hash each
BLOCK_BITS = 21
BLOCK_BYTES = 1 << 19
CHUNK = 2048  # bytes of the earlier text per comparison of claims
FETCH_RUNS = 4096  # contexts cut out at a time; each may hold `length` strings
FETCH_CHUNKS = 1024  # chunks cut out at a time
NO_ID = -(1 << 63)

_CODE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the `size` bytes from each place on, by doubling."""
    h, width, factor = _CODE[data], 1, 0x9E3779B97F4A7C15
    while width < size:
        if len(h) <= width:
            return np.empty(0, np.uint64)
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    return _mix(h)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Hashes of all grams, and per run of strings with one anchor the first and last start and the anchor."""
    h = gram_hashes(data)
    window, width = length - GRAM + 1, 1
    if len(h) < window:
        return h, *(np.empty(0, np.int64),) * 3
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if window > width:
        least = np.minimum(least[:width - window], least[window - width:])
    anchor = (least & _PLACE).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int32)
    whole = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][whole], 1)
    np.add.at(inside, offsets[1:][whole] - length + 1, -1)
    inside = np.cumsum(inside[:len(anchor)]) > 0
    changes = anchor[1:] != anchor[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | changes
    last[:-1] &= ~inside[1:] | changes
    low = np.flatnonzero(first)
    return h, low, np.flatnonzero(last), anchor[low]


def string_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """Hashes of the bytes from start to end, which hold at least one gram, out of overlapping grams."""
    out = (end - start).astype(np.uint64)
    for step in range(0, longest, GRAM):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + h[np.minimum(start + step, end - GRAM)])
    return out


def block_span(length: int) -> int:
    """Places of an anchor inside a string that share one block."""
    return -(-(length - GRAM + 1) // BLOCKS)


def block_hashes(h: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
    """For strings in which the anchor has the places i * span to (i + 1) * span - 1, the bytes that all of
    them hold: a few bits of hash each, 0 where the run has no such string."""
    span, out = block_span(length), np.zeros(len(low), np.int64)
    for i in range(BLOCKS):
        own = (anchor - low >= i * span) & (anchor - high < (i + 1) * span)
        start = anchor[own] - i * span
        code = string_hashes(h, start, start + length - span + 1, length - span + 1) % np.uint64((1 << BLOCK_BITS) - 1)
        out[own] |= (code.astype(np.int64) + 1) << (BLOCK_BITS * i)
    return out


def shared_blocks(g: np.ndarray, blocks: np.ndarray, packed: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (distinct within g) that share a block with another one, and their runs cut down to the
    strings with shared blocks."""
    span = block_span(length)
    most, least = np.full(len(g), -1), np.full(len(g), length)
    low, high = _fields(packed)
    at = packed & 127
    for i in range(BLOCKS):
        code = (blocks >> (BLOCK_BITS * i)) & ((1 << BLOCK_BITS) - 1)
        order = np.lexsort((code, g))
        same = (g[order][1:] == g[order][:-1]) & (code[order][1:] == code[order][:-1]) & (code[order][1:] > 0)
        shared = np.zeros(len(g), bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        most = np.where(shared, np.maximum(most, (i + 1) * span - 1), most)
        least = np.where(shared, np.minimum(least, i * span), least)
    anchor = low + at
    low, high = np.maximum(low, anchor - most), np.minimum(high, anchor - least)
    return np.flatnonzero(most >= 0), (low << 14) | ((high - low) << 7) | (anchor - low)


def _slices(offsets: np.ndarray, length: int, limit: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first text, last text, from byte, to byte, bytes of the first text that come before): whole texts,
    or parts of a long one that overlap so that each string starts in one of them."""
    for a, b in T.pieces(offsets, limit):
        begin, end = int(offsets[a]), int(offsets[b])
        if b - a > 1 or end - begin <= limit:
            yield a, b, begin, end, 0
        else:
            for at in range(begin, end, limit):
                yield a, b, at, min(at + limit + length - 1, end), at - begin


def _firsts(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def _fields(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First start and last start of packed runs."""
    low = packed >> 14
    return low, low + ((packed >> 7) & 127)


def _others(led: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Rows that differ in a column from the row that leads them."""
    other = np.zeros(len(led), bool)
    for c in columns:
        other |= c != c[led]
    return other


def _pointed(led: np.ndarray, key: np.ndarray, tag: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """For rows in order of place, the row whose place each claims to repeat: the one before in the same text,
    so that the claims of a periodic text have one shift and merge, else the row that leads."""
    out, at = led.copy(), np.arange(1, len(led))
    own = (led[1:] == led[:-1]) & (key[1:] == key[:-1]) & (tag[1:] == tag[:-1]) & (packed[1:] != packed[:-1])
    out[1:][own] = at[own] - 1
    return out


def keyed(docs: DataFrame, *more) -> DataFrame:
    """The id, with a number for null, and the text. Joins that take the same columns share one shuffle."""
    return bounded(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"),
                       F.xxhash64("text").alias("tag"), "text", *more)


def find_runs(docs: DataFrame, length: int, limit: int) -> DataFrame:
    """Runs (key, tag, start, end) of bytes: claims to equal those from `at` on of the text (of_key, of_tag), which come earlier,
    where g is null, else the earliest of a context of the anchor g, which has n contexts."""

    names = ["g", "context", "key", "tag", "packed", "blocks", "end", "at"]  # of a claim: spread, of_key, .., start, of_tag, ..

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.flat(batch.column("text"))
            keys, tags = batch.column("key").to_numpy(), batch.column("tag").to_numpy()
            for a, b, begin, end, before in _slices(offsets, length, limit):
                edges = np.clip(offsets[a:b + 1], begin, end) - begin
                h, low, high, anchor = anchors(data[begin:end], edges, length)
                if not len(low):
                    continue
                doc = np.searchsorted(edges, low, "right") - 1
                context = string_hashes(h, low, high + length, 2 * length - GRAM)
                context = _mix(context + (anchor - low).astype(np.uint64))
                start = low - edges[doc] + before
                packed = (start << 14) | ((high - low) << 7) | (anchor - low)
                g, key, tag, blocks = h[anchor], keys[a:b][doc], tags[a:b][doc], block_hashes(h, low, high, anchor, length)
                order = np.lexsort((packed, tag, key, context, g))
                g, context, key, tag, packed, blocks = (x[order] for x in (g, context, key, tag, packed, blocks))
                first = _firsts(g, context)
                again = ~first
                # A later row is a repeat unless it is the same place of the same document.
                led = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
                claim = again & _others(led, key, tag, packed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[first]) for x in (g.view(np.int64), context.view(np.int64), key, tag, packed, blocks)]
                    + [pa.nulls(int(first.sum()), pa.int64())] * 2, names)
                number, led = order[claim], _pointed(led, key, tag, packed)[claim]
                key, tag, of_key, of_tag = key[claim], tag[claim], key[led], tag[led]
                (low, high), (at, _) = _fields(packed[claim]), _fields(packed[led])
                order = np.argsort(number)  # by text and place
                key, tag, low, high, of_key, of_tag, at = (x[order] for x in (key, tag, low, high, of_key, of_tag, at))
                new = _firsts(key, tag, of_key, of_tag, low - at)
                new[1:] |= low[1:] != high[:-1] + 1
                last = np.append(new[1:], True)[:len(new)]
                key, tag, low, of_key, of_tag, at = (x[new] for x in (key, tag, low, of_key, of_tag, at))
                spread = _mix(low.view(np.uint64) ^ tag.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (spread, of_key, key, tag, low, of_tag, high[last] + length, at)], names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.empty((6, 0), np.int64)]
        for batch in batches:
            claim = batch.column("at").is_valid()
            _, of_key, *place, of_tag, end, at = (x.to_numpy() for x in batch.filter(claim).columns)
            yield _runs(*place, end, of=(of_key, of_tag, at))
            got.append(np.stack([x.to_numpy() for x in batch.filter(pa.compute.invert(claim)).columns[:6]]))
        rows = np.concatenate(got, axis=1)
        got.clear()
        order = np.lexsort(rows[4::-1])
        for row in rows:  # one at a time
            row[:] = row[order]
        g, context, key, tag, packed, blocks = rows
        first = _firsts(g, context)
        led = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        repeat = ~first & _others(led, key, tag, packed)
        low, high = _fields(packed[repeat])
        led = _pointed(led, key, tag, packed)[repeat]
        yield _runs(key[repeat], tag[repeat], low, high + length, of=(key[led], tag[led], _fields(packed[led])[0]))
        anchor = np.cumsum(_firsts(g)) - 1
        n = np.bincount(anchor, weights=first).astype(np.int64)[anchor] if len(anchor) else anchor
        left = first & (n > 1)
        g, key, tag, packed, blocks = (x[left] for x in (g, key, tag, packed, blocks))
        kept, cut_down = shared_blocks(g, blocks, packed, length)
        g, key, tag, packed = g[kept], key[kept], tag[kept], cut_down[kept]
        anchor = np.cumsum(_firsts(g)) - 1
        low, high = _fields(packed)
        yield _runs(key, tag, low, high + length, (g, np.bincount(anchor)[anchor] if len(anchor) else anchor))

    def _runs(key, tag, start, end, anchor=(None, None), of=(None, None, None)):
        none = pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([none if x is None else pa.array(x) for x in (key, tag, start, end, *anchor, *of)],
                                          ["key", "tag", "start", "end", "g", "n", "of_key", "of_tag", "at"])

    rows = keyed(docs).select("key", "tag", "text").mapInArrow(tidy(cut), ", ".join(f"{x} long" for x in names))
    return rows.repartition("g").mapInArrow(
        tidy(settle), "key long, tag long, start long, end long, g long, n long, of_key long, of_tag long, at long")


def _cut_out(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    sizes = end - start
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    body = data[np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], sizes)]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(body)])


def _later(data: np.ndarray, bounds: np.ndarray, key: np.ndarray, tag: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the contexts: does a string start there that, by the transform, an earlier place in them holds too?"""
    context, place, kind = bwt.repeats(data, bounds, length)
    later = np.zeros(len(data), bool)
    if len(kind):
        order = np.lexsort((tag, key))
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(_firsts(key[order], tag[order]))
        spot = (rank[context] << 40) | (low[context] + place)
        new = _firsts(kind)
        gone = spot != np.minimum.reduceat(spot, np.flatnonzero(new))[np.cumsum(new) - 1]
        later[bounds[context[gone]] + place[gone]] = True
    return later


def _marks(later: np.ndarray, bounds: np.ndarray, key: np.ndarray, tag: np.ndarray, low: np.ndarray, length: int) -> pa.RecordBatch:
    """(key, tag, start, end) of the runs of later strings. None starts in the last bytes of a context, so runs stay inside."""
    edge = np.diff(np.concatenate([[False], later, [False]]).astype(np.int8))
    first, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    c = np.searchsorted(bounds, first, "right") - 1
    shift = low[c] - bounds[c]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[c], tag[c], first + shift, end + shift + length - 1)],
                                      ["key", "tag", "start", "end"])


def _wanted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Texts of a batch as bytes, and the text and the fields of each run wanted of them."""
    data, offsets = T.flat(batch.column("text"))
    lists = batch.column("runs")
    doc = np.repeat(np.arange(len(batch)), pa.compute.list_value_length(lists).to_numpy())
    return data, offsets, doc, [x.to_numpy() for x in lists.flatten().flatten()]


def _asked(docs: DataFrame, runs: DataFrame, *fields: str) -> DataFrame:
    """Texts (key, tag, text) with the runs that are wanted of them. A text has at most some per 32 bytes."""
    lists = runs.groupBy("key", "tag").agg(F.collect_list(F.struct(*fields)).alias("runs"))
    return keyed(docs).select("key", "tag", "text").join(lists, ["key", "tag"])


def find_claimed(docs: DataFrame, runs: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Marks (key, tag, start, end) of strings of the claims that the bytes they point to hold, by the transform."""

    def fetch_claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, doc, (start, end, of_key, of_tag, at) = _wanted(batch)
            keys, tags = batch.column("key").to_numpy(), batch.column("tag").to_numpy()
            shift = start - at
            order = np.lexsort((end, start, shift, of_tag, of_key, doc))
            doc, start, end, of_key, of_tag, shift = (x[order] for x in (doc, start, end, of_key, of_tag, shift))
            # Runs that touch in a string or follow one another are one; no other text or shift lies between them.
            new = _firsts(doc, of_key, of_tag, shift)
            new[1:] |= start[1:] > end[:-1] - length + 1
            first = np.flatnonzero(new)
            if not len(first):
                continue
            end = np.maximum.reduceat(end, first)
            doc, start, of_key, of_tag, shift = (x[first] for x in (doc, start, of_key, of_tag, shift))
            at = start - shift
            chunk = at // CHUNK
            count = (end - shift - length) // CHUNK - chunk + 1
            each = np.repeat(np.arange(len(first)), count)
            chunk = chunk[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            doc, shift = doc[each], shift[each]
            start = np.maximum(start[each], chunk * CHUNK + shift)
            end = np.minimum(end[each], (chunk + 1) * CHUNK + length - 1 + shift)
            for a in range(0, len(each), FETCH_CHUNKS):
                own = slice(a, a + FETCH_CHUNKS)
                base = offsets[doc[own]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (of_key[each[own]], of_tag[each[own]], chunk[own], keys[doc[own]], tags[doc[own]], start[own])]
                    + [_cut_out(data, base + start[own], base + end[own])], ["of_key", "of_tag", "chunk", "key", "tag", "start", "body"])

    def fetch_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, doc, (chunk, start, end) = _wanted(batch)
            keys, tags = batch.column("key").to_numpy(), batch.column("tag").to_numpy()
            for a in range(0, len(doc), FETCH_CHUNKS):
                own = slice(a, a + FETCH_CHUNKS)
                base = offsets[doc[own]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (keys[doc[own]], tags[doc[own]], chunk[own], start[own])]
                    + [_cut_out(data, base + start[own], base + end[own])], ["of_key", "of_tag", "chunk", "begin", "earlier"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by([("of_key", "ascending"), ("of_tag", "ascending"), ("chunk", "ascending")])
            of_key, of_tag, chunk, key, tag, start, begin = (batch.column(x).to_numpy() for x in (
                "of_key", "of_tag", "chunk", "key", "tag", "start", "begin"))
            data, offsets = T.flat(batch.column("body"))
            for a, b in T.pieces(offsets, block_bytes):
                first = a + np.flatnonzero(_firsts(of_key[a:b], of_tag[a:b], chunk[a:b]))
                earlier, edges = T.flat(batch.column("earlier").take(pa.array(first)))
                both = np.concatenate([earlier, data[offsets[a]:offsets[b]]])
                bounds = np.concatenate([edges, edges[-1] + offsets[a + 1:b + 1] - offsets[a]])
                place = [np.concatenate([x[first], y[a:b]]) for x, y in ((of_key, key), (of_tag, tag), (begin, start))]
                yield _marks(_later(both, bounds, *place, length), bounds, *place, length)

    claims = runs.where("g IS NULL")
    fields = "of_key long, of_tag long, chunk long, "
    copies = _asked(docs, claims, "start", "end", "of_key", "of_tag", "at").mapInArrow(
        tidy(fetch_claims), fields + "key long, tag long, start long, body binary")
    until = F.col("at") + F.col("end") - F.col("start")
    chunks = claims.select("of_key", "of_tag", "at", until.alias("until"), F.explode(F.sequence(
        F.expr(f"at div {CHUNK}"), F.floor((until - length) / CHUNK))).alias("chunk")).groupBy("of_key", "of_tag", "chunk").agg(
            F.min(F.greatest("at", F.col("chunk") * CHUNK)).alias("start"),
            F.max(F.least("until", (F.col("chunk") + 1) * CHUNK + length - 1)).alias("end")).withColumnsRenamed({"of_key": "key", "of_tag": "tag"})
    # Rows that repeat are one text. Its start goes with the key, so that the join shuffles anew and can split a hot place.
    earlier = _asked(docs, chunks, "chunk", "start", "end").mapInArrow(tidy(fetch_chunks), fields + "begin long, earlier binary").groupBy(
        "of_key", "of_tag", "chunk", "begin").agg(F.first("earlier").alias("earlier"))
    return copies.join(earlier, ["of_key", "of_tag", "chunk"]).mapInArrow(tidy(judge), "key long, tag long, start long, end long")


def find_marks(docs: DataFrame, runs: DataFrame, length: int, hot: int, block_bytes: int) -> DataFrame:
    """Marks (key, tag, start, end) of repeated strings among contexts that differ."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "key", "tag", "start", "end", "body"]
        for batch in batches:
            data, offsets, all_doc, columns = _wanted(batch)
            keys, tags = batch.column("key").to_numpy(), batch.column("tag").to_numpy()
            for a in range(0, len(all_doc), FETCH_RUNS):
                doc, g, low, end, n = (x[a:a + FETCH_RUNS] for x in (all_doc, *columns))
                cold = n <= hot
                base = offsets[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[cold]) for x in (g, keys[doc], tags[doc], low, end)]
                    + [_cut_out(data, (base + low)[cold], (base + end)[cold])], names)
                if cold.all():
                    continue
                doc, g, low, end = (x[~cold] for x in (doc, g, low, end))
                place = keys[doc], tags[doc], low
                bounds = np.concatenate([[0], np.cumsum(end - low)])
                body = _cut_out(data, offsets[doc] + low, offsets[doc] + end)
                later = _later(T.flat(body)[0], bounds, *place, length)
                found = _marks(later, bounds, *place, length)
                spread = _mix((found.column("start").to_numpy() ^ found.column("tag").to_numpy()).view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), *found.columns, pa.nulls(len(found), pa.binary())], names)
                # Of equal strings in this task the earliest goes on.
                count = end - low - length + 1
                each = np.repeat(np.arange(len(doc)), count)
                inside = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                own = ~later[bounds[each] + inside]
                each, start = each[own], (low[each] + inside)[own]
                code = np.empty(len(each), np.uint64)
                for d in np.unique(doc):  # hashes of one text at a time
                    of = doc[each] == d
                    h = gram_hashes(data[offsets[d]:offsets[d + 1]])
                    code[of] = string_hashes(h, start[of], start[of] + length, length)
                doc, g = doc[each], _mix(code ^ g[each].view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (g, keys[doc], tags[doc], start, start + length)]
                    + [_cut_out(data, offsets[doc] + start, offsets[doc] + start + length)], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            known = batch.column("body").is_null()
            yield batch.filter(known).select(["key", "tag", "start", "end"])
            got.append(batch.filter(pa.compute.invert(known)))
        if not sum(map(len, got)):
            return
        table = pa.Table.from_batches(got).sort_by("g").combine_chunks()
        got.clear()
        g, *place = (table[x].to_numpy() for x in ("g", "key", "tag", "start"))
        data, offsets = T.flat(table["body"])
        groups = np.append(np.flatnonzero(_firsts(g)), len(g))
        at = 0
        while at < len(groups) - 1:
            until = max(int(np.searchsorted(offsets[groups], offsets[groups[at]] + block_bytes, "right")) - 1, at + 1)
            a, b = groups[at], groups[until]
            bounds, own = offsets[a:b + 1] - offsets[a], [x[a:b] for x in place]
            yield _marks(_later(data[offsets[a]:offsets[b]], bounds, *own, length), bounds, *own, length)
            at = until

    contexts = _asked(docs, runs.where("g IS NOT NULL"), "g", "start", "end", "n").mapInArrow(
        tidy(fetch), "g long, key long, tag long, start long, end long, body binary")
    return contexts.repartition("g").mapInArrow(tidy(compare), "key long, tag long, start long, end long")


def _remove(data: np.ndarray, offsets: np.ndarray, lists: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Maximal removed runs of each text, and the bytes that stay."""
    sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy()
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(offsets) - 1), sizes)
    change = np.zeros(len(data) + 1, np.int32)
    start, end = offsets[doc] + flat.field(0).to_numpy(), offsets[doc] + flat.field(1).to_numpy()
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change[:-1], dtype=np.int32) > 0
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    edges = offsets[1:-1][offsets[1:-1] < len(data)]
    first[edges] = gone[edges]
    last = gone.copy()
    last[:-1] &= ~gone[1:]
    edges = edges[edges > 0]
    last[edges - 1] = gone[edges - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    of = np.searchsorted(offsets, a, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(a - offsets[of]), pa.array(b - offsets[of])], ["start", "end"])
    bounds = np.searchsorted(a, offsets)
    kept_before = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~gone, out=kept_before[1:])
    kept = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer(kept_before[offsets]), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans), kept


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, limit: int = T.PIECE_BYTES,
                   block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of maximal removed runs) and kept (remaining bytes) per row, and
    `row`, a struct of the columns to carry. With as_text, kept is a string without the bytes left of
    characters that were cut in two."""
    if not 2 * GRAM < length <= GRAM + 127 or limit + length >= 1 << 24:
        raise ValueError("strings must have 65 to 159 bytes, pieces under 16 MB")
    staging = Staging(docs.sparkSession)
    runs = staging.write("runs", find_runs(docs, length, limit))
    found = find_claimed(docs, runs, length, block_bytes).union(find_marks(docs, runs, length, hot, block_bytes))
    marks = found.groupBy("key", "tag").agg(F.collect_list(F.struct("start", "end")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.flat(batch.column("text"))
            for a, b in T.pieces(offsets):
                spans, kept = _remove(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], batch.column("marks")[a:b])
                if as_text:
                    kept = pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array(np.diff(offsets[a:b + 1])), spans, kept,
                     *[batch.column("row")[a:b] for _ in carry[:1]]], ["doc_id", "n_bytes", "spans", "kept", *["row" for _ in carry[:1]]])

    own = docs.schema["doc_id"].dataType
    schema = f"doc_id {own.simpleString()}, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept {'string' if as_text else 'binary'}"
    row = [F.struct(*carry).alias("row")] if carry else []
    marked = keyed(docs, *row).join(marks, ["key", "tag"], "left").select(
        F.when(F.col("key") != NO_ID, F.col("key")).cast(own).alias("doc_id"), "text", "marks", *["row" for _ in row])
    types = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in carry)
    return marked.mapInArrow(tidy(run), schema + (f", row struct<{types}>" if carry else ""))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs with the text that stays and its n_chars, if there is such a column."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    marker = docs if others else docs.withColumn("no_other_column", F.lit(True))
    found = remove_repeats(marker, length, carry=others or ("no_other_column",), as_text=True)
    column = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[column.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

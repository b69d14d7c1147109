"""A trigram language model in Elias-Fano tries, and log10 scores of whole texts.

Tokens are words between ASCII white space, A-Z lowered, and one end per text. With c(.) and N counted
in training texts, p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), pairs weighed by a and words by m,

    p(w | u v) = (c(u v w) + a c(v w) + m p1(w)) / (c(u v) + a c(v) + m)

which adds up to one over w. Numerators need what ends in w, denominators what ends in v. So every token goes
to the task that owns its word, with the two words before it; that task adds the numerator's logarithm for
the three, and the denominator's for the word in its later role as v. Nothing is looked up across tasks.

A shard's trie is laid out as memory-mapped levels in the shared folder, until the shard is scored: words, each with a monotone
pointer to the words before them, each of these with a pointer to the words before it. The children of an entry
are numbered by their sorted names and made monotone by the entry's number, all in Elias-Fano form; two
bytes per number hold the quantised logarithms. An entry is found by successor search among the children of
the entry above it alone.

Words are known by 64 bits of hash, the word before by 48, the one before that by 32 (compared among those of one pair only), so a table
of words never goes to any one place. A first pass counts the training words. Words that make up more than 1 / `HOT_SHARE` of all tokens (so
at most HOT_SHARE rows, which are broadcast with their counts) have their pairs dealt by both words.
A task sums its contributions per text before they are shuffled back. What is sent is grouped by chunk
of texts; a chunk's messages and its list of texts must come from rows in a stable order, as in files.

Null texts count as empty: one end token. Texts of rows that repeat a doc_id are scored row by row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbusops.llm import text as T
from nimbusops.llm.batches import bounded, merged, tidy
from nimbusops.llm.eliasfano import EliasFano
from nimbusops.llm.files import open_folder
from nimbusops.session import Staging

SMOOTHING = 50.0  # m
PAIRS = 0.01  # a
STEPS = 2048  # quantised logarithms per power of ten
HOT_SHARE = 2000
CHUNK_BYTES = 8 << 20
#: Tokens that are no words; words never hash to them but by chance, as any two tokens may.
END, BEGIN, BEFORE = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127), np.uint64(0xB492B66FBE98F273)
CONTEXT_BITS = np.uint64((1 << 48) - 1)


def _small(values: np.ndarray) -> bytes:
    """Non-negative integers in the least number of bytes each, which the first byte tells, all first bytes before all
    second ones, packed."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _large(body: bytes) -> np.ndarray:
    width, n = body[0], int.from_bytes(body[1:9], "little")
    planes = np.frombuffer(pa.decompress(body[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of distinct words, each word's number in place, and the number of words up to each text."""
    starts, ends, upto = T.words(data, offsets)
    coded = T.strings(T.LOWER[data] if len(data) else data, starts, ends).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return hashes, coded.indices.to_numpy().astype(np.int64), upto


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def unigrams(docs: DataFrame) -> DataFrame:
    """word (hash) and c of the rows that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.flat(batch.column("text"))
            for a, b in T.pieces(offsets, CHUNK_BYTES):
                hashes, codes, _ = word_table(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(hashes, END).view(np.int64)), pa.array(np.append(np.bincount(codes, minlength=len(hashes)), b - a))],
                    ["word", "c"])

    return docs.where(~F.col("held_out")).select("text").mapInArrow(tidy(run), "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _messages(data, offsets, doc_ids, held, chunk, shards, hot) -> Iterator[dict]:
    """The chunk's list of texts, and per shard its words, the words before them and the ones before these, with the
    texts that hold each three."""
    hashes, codes, upto = word_table(data, offsets)
    n_docs, d = len(offsets) - 1, len(hashes)
    names = np.concatenate([hashes, [END, BEGIN, BEFORE]])
    counts = np.diff(upto) + 1
    yield {"shard": int(_mix(np.array([chunk], np.uint64))[0] % np.uint64(shards)), "chunk": chunk, "doc_ids": doc_ids,
           "held": held.tolist(), "counts": counts.tolist()}
    bounds = np.concatenate([[0], np.cumsum(counts)])
    target, context, third = (np.empty(bounds[-1], np.int64) for _ in range(3))
    target[bounds[1:] - 1], context[bounds[:-1]], third[bounds[:-1]] = d, d + 1, d + 2
    word = np.ones(len(target), bool)
    word[bounds[1:] - 1] = False
    target[word] = codes
    word[:], word[bounds[:-1]] = True, False
    context[word] = codes
    third[word] = context[np.flatnonzero(word) - 1]
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), counts)
    mixed = _mix(names)
    shard = (mixed % np.uint64(shards)).astype(np.int32)[target]
    often = np.isin(names, hot)[target]
    shard[often] = (_mix(mixed[target[often]] ^ names[context[often]]) % np.uint64(shards)).astype(np.int32)
    # One sort by shard, pair and word before; the texts of three words stay in order.
    pair = target * (d + 3) + context
    order = np.lexsort((pair * (d + 3) + third, shard) if d < 2_000_000 else (third, pair, shard))
    shard, pair, target, context, third, doc = (x[order] for x in (shard, pair, target, context, third, doc))
    new_word = np.ones(len(order), bool)
    new_word[1:] = (target[1:] != target[:-1]) | (shard[1:] != shard[:-1])
    new_pair = new_word.copy()
    new_pair[1:] |= context[1:] != context[:-1]
    new_third = new_pair.copy()
    new_third[1:] |= third[1:] != third[:-1]
    thirds, pairs, words = np.flatnonzero(new_third), np.flatnonzero(new_pair), np.flatnonzero(new_word)
    in_third = np.diff(np.append(thirds, len(order)))
    in_pair = np.diff(np.append(np.searchsorted(thirds, pairs), len(thirds)))
    in_word = np.diff(np.append(np.searchsorted(pairs, words), len(pairs)))
    firsts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    for a, b in zip(firsts, np.append(firsts[1:], len(order)), strict=True):
        (t, u), (p, q), (v, w) = (np.searchsorted(x, [a, b]) for x in (thirds, pairs, words))
        own = (names[context[pairs[p:q]]] & CONTEXT_BITS).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        present, local = np.unique(doc[a:b], return_inverse=True)
        yield {"shard": int(shard[a]), "chunk": chunk, "words": names[target[words[v:w]]].astype("<u8").tobytes(),
               "n_pairs": _small(in_word[v:w]), "contexts": own.tobytes(), "n_thirds": _small(in_pair[p:q]),
               "thirds": names[third[thirds[t:u]]].astype("<u4").tobytes(), "n_texts": _small(in_third[t:u]),
               "present": _small(present), "texts": _small(local), "trained": np.packbits(~held[present]).tobytes()}


_MESSAGE = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                      ("counts", pa.list_(pa.int64()))] + [(k, pa.binary()) for k in
                     ("words", "n_pairs", "contexts", "n_thirds", "thirds", "n_texts", "present", "texts", "trained")])
_MESSAGE_DDL = ("shard int, chunk long, doc_ids array<long>, held array<boolean>, counts array<long>, words binary, n_pairs binary, "
                "contexts binary, n_thirds binary, thirds binary, n_texts binary, present binary, texts binary, trained binary")


def _children(parent: np.ndarray, name: np.ndarray, n_parents: int) -> list[list[np.ndarray]]:
    """A level below another: the sorted names, where each parent's children begin, and the children, numbered
    by their names. Sorted by parent and name."""
    names = np.unique(name)
    numbers = np.searchsorted(names, name).astype(np.uint64)
    return [EliasFano.encode(names), EliasFano.encode(np.searchsorted(parent, np.arange(n_parents + 1)).astype(np.uint64)),
            EliasFano.encode(parent.astype(np.uint64) * np.uint64(max(1, len(names))) + numbers)]


class Level:
    """Children of the entries of the level above."""

    def __init__(self, names: EliasFano, pointers: EliasFano, children: EliasFano):
        self.names, self.pointers, self.children = names, pointers, children

    def find(self, parent: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the child of that name of each parent, and whether there is one."""
        number, known = self.names.successor(name, 0, self.names.n)
        begin, end = (self.pointers.at(parent + i).astype(np.int64) for i in (0, 1))
        at, found = self.children.successor(parent.astype(np.uint64) * np.uint64(max(1, self.names.n)) + number.astype(np.uint64), begin, end)
        return at, found & known


class Trie:
    """Levels on mapped bytes: words, the words before them, the words before these; and the quantised logarithms
    of numerators (`ends`) and denominators (`starts`) at each level, as far as they are known there."""

    LEVELS = 7  # Elias-Fano lists

    def __init__(self, lists: list[EliasFano], ends: list[np.ndarray], starts: list[np.ndarray]):
        self.words, self.before, self.earlier = lists[0], Level(*lists[1:4]), Level(*lists[4:7])
        self.ends, self.starts = ends, starts

    @staticmethod
    def build(word: np.ndarray, c: np.ndarray, pair_word: np.ndarray, pair_context: np.ndarray, pair_c: np.ndarray, third_pair: np.ndarray,
              third: np.ndarray, third_c: np.ndarray, total: float, smoothing: float, weight: float) -> list[np.ndarray]:
        """word: sorted hashes and their counts; pairs: number of the word, word before and count, sorted; and
        the same of the words before these, by number of the pair."""
        alone = smoothing * (c + 0.5) / total
        both = alone[pair_word] + weight * pair_c
        lists = [EliasFano.encode(word), *_children(pair_word, pair_context, len(word)), *_children(third_pair, third, len(pair_word))]
        numbers = [alone, both, both[third_pair] + third_c, 1 / (weight * c + smoothing), 1 / (pair_c + weight * c[pair_word] + smoothing)]
        return [a for one in lists for a in one] + [np.rint(np.log10(x) * STEPS).astype(np.int16) for x in numbers]

    @staticmethod
    def save(arrays: list[np.ndarray], system, path: str) -> None:
        head = np.array([[ord(a.dtype.kind), a.dtype.itemsize, len(a)] for a in arrays], np.int64)
        with system.open_output_stream(path) as out:
            out.write(np.array([len(arrays)], np.int64).tobytes() + head.tobytes())
            for a in arrays:
                out.write(a.tobytes() + bytes(-a.nbytes % 8))

    @classmethod
    def load(cls, system, path: str) -> Trie:
        """Memory-mapped where the shared folder is a mounted one, else read as a whole."""
        if system.type_name == "local":
            body = pa.memory_map(path).read_buffer()
        else:
            with system.open_input_stream(path) as source:
                body = source.read_buffer()
        n = int(np.frombuffer(body, np.int64, 1)[0])
        head, at, arrays = np.frombuffer(body, np.int64, 3 * n, 8).reshape(n, 3), 8 + 24 * n, []
        for kind, width, length in head.tolist():
            arrays.append(np.frombuffer(body, np.dtype(f"{chr(kind)}{width}"), length, at))
            at += -(-length * width // 8) * 8
        rest = arrays[4 * cls.LEVELS:]
        return cls([EliasFano.mapped(*arrays[4 * i:4 * i + 4]) for i in range(cls.LEVELS)], rest[:3], rest[3:])

    def pairs(self, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of pairs (hashes; the trie holds the last words): quantised logarithms of numerator and one over the denominator (0 for the
        end of a text, which nothing follows), the pair's number and whether the trie holds it."""
        own, _ = self.words.successor(word, 0, self.words.n)
        pair, found = self.before.find(own, context)
        end, start = self.ends[0][own], self.starts[0][own]
        end[found], start[found] = self.ends[1][pair[found]], self.starts[1][pair[found]]
        start[word == END] = 0
        return end, start, pair, found

    def codes(self, word: np.ndarray, context: np.ndarray, pair_of: np.ndarray, third: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """What three words add to a score, given distinct pairs, and the pair of each word that stands before one."""
        found = [self.pairs(word[i:i + step], context[i:i + step]) for i in range(0, len(word), step)]
        end, start, pair, held = (np.concatenate(x) for x in zip(*found, strict=True))
        out = np.empty(len(third), np.int32)
        for i in range(0, len(third), step):
            of = pair_of[i:i + step]
            code = end[of]
            some = np.flatnonzero(held[of])
            three, known = self.earlier.find(pair[of[some]], third[i:i + step][some])
            code[some[known]] = self.ends[2][three[known]]
            out[i:i + step] = code.astype(np.int32) + start[of]
        return out


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Places where sorted keys change."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _shard_scores(rows: list[dict], total: float, hot: dict[str, np.ndarray], smoothing: float, weight: float, system, path: str) -> Iterator[tuple]:
    """What a shard owes each text, message by message: chunk, then texts, quantised codes, exact unigram
    logarithms and known tokens. Takes the messages out of the list."""
    parts = []
    while rows:  # each message is let go of once it is decoded
        r = rows.pop()
        body = np.zeros((len(r["contexts"]) // 6, 8), np.uint8)
        body[:, :6] = np.frombuffer(r["contexts"], np.uint8).reshape(-1, 6)
        n_thirds, n_texts, texts, present = (_large(r[k]) for k in ("n_thirds", "n_texts", "texts", "present"))
        trained = np.unpackbits(np.frombuffer(r["trained"], np.uint8))[:len(present)].astype(np.int64)
        c = T.sums(trained[texts], np.concatenate([[0], np.cumsum(n_texts)])).astype(np.int32)
        word = np.repeat(np.repeat(np.frombuffer(r["words"], "<u8"), _large(r["n_pairs"])), n_thirds)
        parts.append([word, np.repeat(body.view("<u8").ravel(), n_thirds), np.frombuffer(r["thirds"], "<u4"), c, n_texts.astype(np.int32),
                      texts.astype(np.int32), present, r["chunk"]])
    if not parts:
        return
    w, x, y, c = (np.concatenate([p[i] for p in parts]) for i in range(4))
    for p in parts:
        p[:4] = [len(p[0]), None, None, None]
    order = np.lexsort((y, x, w))
    w, x, y, c = w[order], x[order], y[order], c[order]
    at = _groups(w, x, y)
    three_of = np.empty(len(order), np.int32)
    three_of[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(order))))
    w, x, y, three_c = w[at], x[at], y[at].astype(np.uint64), np.add.reduceat(c, at, dtype=np.int64)
    del order, at, c
    pairs = _groups(w, x)
    pair_c = np.add.reduceat(three_c, pairs)
    pair_of = np.repeat(np.arange(len(pairs)), np.diff(np.append(pairs, len(w))))
    words, number = np.unique(w[pairs], return_inverse=True)
    word_c = np.bincount(number, weights=pair_c).astype(np.int64)
    if len(hot["word"]):  # their pairs lie in many tasks, their counts are known
        place = np.minimum(np.searchsorted(hot["word"], words), len(hot["word"]) - 1)
        word_c = np.where(hot["word"][place] == words, hot["c"][place], word_c)
    seen = pair_c > 0
    renumbered = np.cumsum(seen) - 1
    seen_three = three_c > 0
    Trie.save(Trie.build(words, word_c, number[seen], x[pairs][seen], pair_c[seen], renumbered[pair_of[seen_three]], y[seen_three],
                         three_c[seen_three], total, smoothing, weight), system, path)
    code = Trie.load(system, path).codes(w[pairs], x[pairs], pair_of, y)
    system.delete_file(path)  # what is mapped stays readable to this task
    base = np.log10((word_c + 0.5) / total)[number][pair_of]
    known = (word_c > 0)[number][pair_of].astype(np.int64)
    del w, x, y, three_c, seen_three
    first = 0
    for p in parts:
        threes = np.repeat(three_of[first:first + p[0]], p[4])
        first += p[0]
        yield p[7], [p[6]] + [np.bincount(p[5], weights=v[threes], minlength=len(p[6])) for v in (code, base, known)]


def _merged(sums: dict[int, list]) -> Iterator[dict]:
    """The sums of a task's shards as one row per chunk of texts."""
    for chunk, found in sums.items():
        texts, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        code_sum, base_sum, known_sum = (np.bincount(place, weights=np.concatenate([f[i] for f in found])) for i in (1, 2, 3))
        yield {"chunk": chunk, "texts": _small(texts), "codes": code_sum.astype("<i8" if abs(code_sum).max() > 2**31 - 2 else "<i4").tobytes(),
               "base": base_sum.astype("<f8").tobytes(), "known": _small(known_sum.astype(np.int64))}


_SUMS = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("counts", pa.list_(pa.int64())),
                   ("texts", pa.binary()), ("codes", pa.binary()), ("base", pa.binary()), ("known", pa.binary())])
_SUMS_DDL = "chunk long, doc_ids array<long>, held array<boolean>, counts array<long>, texts binary, codes binary, base binary, known binary"


def score(docs: DataFrame, held_out: Column, smoothing: float = SMOOTHING, weight: float = PAIRS, shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row, learned from
    the rows that are not held out."""
    spark = docs.sparkSession
    staging = Staging(spark)
    folder = f"{staging.path}/tries"
    rows = bounded(docs).select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    table = staging.write("unigrams", unigrams(rows))
    n_train, distinct = table.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total = n_train + 0.5 * (distinct + 1)
    often = table.where(F.col("c") > n_train / HOT_SHARE).orderBy("word").toArrow()  # under HOT_SHARE rows
    hot_word, hot_c = often["word"].to_numpy().view(np.uint64), often["c"].to_numpy()
    order = np.argsort(hot_word)
    hot = {"word": hot_word[order], "c": hot_c[order]}
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or 4 * partitions
    begins = rows.where(~F.col("held_out")).count()
    from_begin = np.rint(-np.log10(begins + weight * begins + smoothing) * STEPS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in merged(batches, CHUNK_BYTES):
            data, offsets = T.flat(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for a, b in T.pieces(offsets, CHUNK_BYTES):
                yield pa.RecordBatch.from_pylist(list(_messages(
                    data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], ids[a:b], held[a:b], number, shards, hot["word"])), _MESSAGE)
                number += 1

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_shard: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["doc_ids"] is None:
                    by_shard.setdefault(r["shard"], []).append(r)
                else:
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in _SUMS.names}], _SUMS)
        system, path = open_folder(folder)
        sums: dict[int, list] = {}
        while by_shard:  # one shard at a time
            shard, rows = by_shard.popitem()
            name = f"{path}/{shard}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.trie"
            for chunk, found in _shard_scores(rows, total, hot, smoothing, weight, system, name):
                sums.setdefault(chunk, []).append(found)
        for one in _merged(sums):
            yield pa.RecordBatch.from_pylist([one], _SUMS)

    def gather(table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        own = next(r for r in got if r["doc_ids"] is not None)
        n = len(own["doc_ids"])
        codes, base, known = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        for r in got:
            if r["doc_ids"] is None:
                at = _large(r["texts"])
                codes[at] += np.frombuffer(r["codes"], f"<i{len(r['codes']) // len(at)}")
                base[at] += np.frombuffer(r["base"], "<f8")
                known[at] += _large(r["known"])
        return pa.table({"doc_id": pa.array(own["doc_ids"], pa.int64()), "held_out": own["held"], "n_tokens": own["counts"], "n_known": known,
                         "base_score": base, "score": (codes + from_begin) / STEPS})

    sent = rows.mapInArrow(tidy(send), _MESSAGE_DDL).repartition(partitions, "shard")
    result = sent.mapInArrow(tidy(own), _SUMS_DDL).groupBy("chunk").applyInArrow(
        gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return result.withColumn("train_tokens", F.lit(n_train).cast("long"))

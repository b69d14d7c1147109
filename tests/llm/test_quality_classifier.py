from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from nimbusops.llm import quality
from nimbusops.llm import text as T

TOKEN = regex.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+")
GOOD = "the cat sat on the mat and the dog lay by the door, then it ran to the park."
LABELS = "doc_id long, quality int"


def flat(*texts):
    return T.flat(pa.array(texts, pa.string()))


def index(word):
    h, v = xxhash.xxh64_intdigest(word), np.zeros(quality.SIZE)
    for i in range(quality.NONZERO):
        v[(h >> 8 * i) % quality.SIZE] += 1 if h >> (48 + i) & 1 else -1
    return v


def test_tokens():
    for t in ["", "  ", "a", "Hi!! you%%% |x| é9\t-", "x\x0b\x0cy\n\n"]:
        data, offsets = flat(t, "", t)
        starts, ends, upto = quality.tokens(data, offsets)
        body = data.tobytes()
        assert [body[a:b] for a, b in zip(starts, ends)] == 2 * TOKEN.findall(t.encode())
        assert upto.tolist() == [0, len(starts) // 2, len(starts) // 2, len(starts)]


def test_contexts_against_counting():
    texts = ["the cat, the dog the cat", None, "", "x", "Rare the WORDS the " * 3, "% %% 12 a1"]
    known = [b",", b"cat", b"the"]
    expected = defaultdict(lambda: np.zeros(quality.SIZE))
    for t in texts:
        words = TOKEN.findall((t or "").encode())
        for i, w in enumerate(words):
            row = known.index(w) if w in known else 3 + int(quality.kinds(pa.array([w], pa.binary()))[0])
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if i != j:
                    expected[row] += index(words[j])
    got = quality.contexts(pa.array(known, pa.binary()), *flat(*texts)).reshape(-1, quality.SIZE)
    assert {i for i, v in enumerate(got) if v.any()} <= set(expected)
    for i, v in expected.items():
        assert got[i].tolist() == v.tolist()


def test_pooled_against_plain(monkeypatch):
    known = pa.array([b"a", b"b"], pa.binary())
    vectors = np.random.default_rng(1).normal(size=(2 + quality.KINDS, quality.SIZE)).astype(np.float32)
    texts = ["a b c a a, a", "", None, "lone", "b " * 500 + "END"]
    plain = []
    for t in texts:
        words = TOKEN.findall((t or "").encode())
        v = np.array([vectors[{b"a": 0, b"b": 1}.get(w, 2 + int(quality.kinds(pa.array([w], pa.binary()))[0]))] + index(w) / 2 for w in words]).reshape(-1, quality.SIZE)
        mean = v.mean(axis=0) if len(v) else np.zeros(quality.SIZE)
        plain.append(np.hstack([mean, v.std(axis=0) if len(v) else mean, np.linalg.norm(mean),
                                (v[1:] * v[:-1]).sum() / max(1, len(v)), max(1, len(v)) ** -0.5]))
    for piece in (quality.PIECE, 64):  # 64 bytes: cut between words of the long text
        monkeypatch.setattr(quality, "PIECE", piece)
        assert np.allclose(quality.pooled(known, vectors, *flat(*texts))[:4], plain[:4], atol=2e-3)
    monkeypatch.setattr(quality, "PIECE", 1 << 18)
    assert np.allclose(quality.pooled(known, vectors, *flat(*texts)), plain, atol=2e-3)


def test_document_counts(spark, docs):
    rows = [(1, "a a b"), (2, None), (3, "a " + "y" * 33), (4, "b|b")]
    got = {bytes(r.word): r.n for r in quality.document_counts(docs(*rows)).collect()}
    assert got == Counter({b"a": 2, b"b": 2, b"|": 1})


def test_learns(spark, docs, with_clashes):
    rows = [(i, GOOD.replace("cat", f"cat{i % 7}") * (1 + i % 3)) for i in range(60)] + [(i, f"w{i} | " * (10 + i % 9)) for i in range(60, 120)]
    odd = [(200, None), (201, ""), (202, GOOD * 20_000), (203, "w | " * 100_000), (1, GOOD), (1, None), (None, GOOD)]
    df = with_clashes(docs(*rows, *odd)).repartition(6)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(3, 0), (4, None), (None, 1), (999, 1)], LABELS)
    got = defaultdict(list)
    for r in quality.score(df, quality.train(df, labels, F.col("doc_id") % 5 != 0)).collect():
        got[r.doc_id].append(r.score)
    assert len(got) == 125 and len(got[1]) == 3 and sum(map(len, got.values())) == 127
    assert all(0 <= s <= 1 for x in got.values() for s in x)
    assert np.mean([(got[i][0] >= 0.5) == (i < 60) for i in range(5, 120, 5)]) == 1
    assert got[202][0] > 0.5 > got[203][0]


def test_one_label_or_none(spark, docs):
    df = docs((1, "a"), (2, None))
    for rows, share in (([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([(7, 0), (8, 1)], 0.5)):
        model = quality.train(df, spark.createDataFrame(rows, LABELS), F.lit(True))
        assert [r.score for r in quality.score(df, model).collect()] == [share, share]
    empty = docs((1, "a")).limit(0)
    assert quality.score(empty, quality.train(empty, spark.createDataFrame([(1, 0), (2, 1)], LABELS), F.lit(True))).count() == 0


def test_sample(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], LABELS)
    rows, counts = quality.sample_rows(docs(*[(i, f"t{i}") for i in range(400)]), labels, F.lit(True), 40)
    got = Counter(r.label for r in rows.collect())
    assert counts == {0: 100, 1: 300} and got == {0: 40, 1: 40}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="test tables are not here")
def test_held_out(spark):
    from nimbusops.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.op13_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r.predicted for r in got if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2

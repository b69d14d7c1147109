import collections
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nimbusops.llm import lm
from nimbusops.llm.eliasfano import EliasFano


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=80), st.lists(st.integers(0, 2**64 - 1), max_size=20), st.integers(0, 2))
def test_successor(values, queries, shrink):
    values = np.sort(np.array(values, np.uint64) >> np.uint64(20 * shrink))
    coded = EliasFano.mapped(*EliasFano.encode(values))
    queries = np.concatenate([np.array(queries, np.uint64) >> np.uint64(20 * shrink), values])
    for begin, end in ((0, len(values)), (len(values) // 3, 2 * len(values) // 3)):
        at, found = coded.successor(queries, begin, end)
        expected = [min(max(int(np.searchsorted(values, q)), begin), end) for q in queries]
        if len(values):
            assert at.tolist() == expected
            assert found.tolist() == [i < end and values[i] == q for i, q in zip(expected, queries)]
            assert (coded.at(np.arange(len(values))) == values).all()


def scores(rows, held, smoothing, weight):
    split = {i: ["<b>", "<s>", *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"] for i, t in rows}
    one, two, three, context, contexts = (collections.Counter() for _ in range(5))
    for i, w in split.items():
        if not held(i):
            one.update(w[2:])
            two.update(zip(w[1:], w[2:]))
            three.update(zip(w, w[1:], w[2:]))
            context.update(w[1:-1])
            contexts.update(zip(w[:-2], w[1:-1]))
    n, total = sum(one.values()), sum(one.values()) + 0.5 * (len(one) + 1)
    p1 = lambda x: (one[x] + 0.5) / total
    p3 = lambda u, v, x: (three[u, v, x] + weight * two[v, x] + smoothing * p1(x)) / (contexts[u, v] + weight * context[v] + smoothing)
    return {i: (held(i), len(w) - 2, sum(one[x] > 0 for x in w[2:]), n, sum(math.log10(p1(x)) for x in w[2:]),
                sum(math.log10(p3(*x)) for x in zip(w, w[1:], w[2:]))) for i, w in split.items()}


ROWS = [(0, "the cat sat"), (1, "The CAT sat on the mat"), (2, None), (3, ""), (4, " \n "), (5, "unseen words é É only"), (6, "the cat sat"),
        (7, "the " * 3000), (8, "a\tb\x0bc d"), (9, "x" * 10_000)] + [(10 + i, " ".join(f"w{j * i % 37}" for j in range(50))) for i in range(40)]


@pytest.mark.parametrize("hot_share, chunk, smoothing", [(2000, 8 << 20, 50.0), (20, 300, 3.0)])
def test_against_counting(docs, with_clashes, monkeypatch, hot_share, chunk, smoothing):
    monkeypatch.setattr(lm, "HOT_SHARE", hot_share)
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    table = with_clashes(docs(*ROWS)).repartition(3, "doc_id")
    got = {r.doc_id: r for r in lm.score(table, F.col("doc_id") % 5 == 1, smoothing=smoothing, weight=0.3, shards=7).collect()}
    for i, (held, n, known, total, base, model) in scores(ROWS, lambda i: i % 5 == 1, smoothing, 0.3).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - model) <= 1e-3 * (n + 1)


def test_odd_tables(docs):
    assert lm.score(docs((1, "x")).where("false"), F.lit(False)).count() == 0
    rows = lm.score(docs((1, "a b"), (1, "a b"), (None, "c")), F.lit(False)).collect()
    assert sorted(r.n_tokens for r in rows) == [2, 3, 3] and {r.train_tokens for r in rows} == {8}
    untrained = lm.score(docs((1, "a b")), F.lit(True)).first()
    assert untrained.train_tokens == untrained.n_known == 0 and untrained.score <= 0

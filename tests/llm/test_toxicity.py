import math

import numpy as np

from nimbusops.llm import toxicity


def test_fit_orders_thresholds_and_finds_weights():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 4)) < 0.3
    z = x @ np.array([3.0, 1.5, 0.0, -1.0]) + rng.logistic(size=1500)
    grade = (z > 1.5).astype(int) + (z > 4)
    text, feature = np.nonzero(x)
    weights, thresholds = toxicity.fit(text, feature, grade, 4)
    assert np.allclose(weights, [3, 1.5, 0, -1], atol=0.5) and np.allclose(thresholds, [1.5, 4], atol=0.5)


def loss(w, t, rows):
    """Mean negative log likelihood of (marks, grade) rows, one by one."""
    total = 0.0
    for marks, grade in rows:
        z = sum(w[i] for i in marks)
        at_least = [1.0, *(1 / (1 + math.exp(x - z)) for x in t), 0.0]
        total -= math.log(at_least[grade] - at_least[grade + 1])
    return total / len(rows) + 0.5e-5 * sum(x * x for x in w)


def test_fit_is_the_least_loss():
    rng = np.random.default_rng(4)
    rows = [(tuple(np.flatnonzero(rng.random(3) < 0.5)), int(rng.integers(0, 3))) for _ in range(200)]
    text, feature = np.repeat(np.arange(200), [len(m) for m, _ in rows]), np.array([i for m, _ in rows for i in m])
    w, t = toxicity.fit(text, feature, np.array([g for _, g in rows]), 3, rounds=3000, rate=0.02)
    best = loss(w, t, rows)
    for i in range(5):
        for step in (-0.05, 0.05):
            moved = np.concatenate([w, t])
            moved[i] += step
            assert loss(moved[:3], moved[3:], rows) > best


def test_repeated_labels_and_documents(spark, docs):
    """One row per id in the sample, whatever labels and documents repeat."""
    table = docs(*[(i % 5, f"text {i}") for i in range(50)], (3, None), (None, "x"))
    labels = spark.createDataFrame([(i % 4, 1, int(i == 2)) for i in range(40)] + [(1, 1, None)], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id, r.grade, r.text) for r in toxicity.sample_rows(table, labels, 8192).collect())
    assert got == [(0, 0, "text 0"), (1, 0, "text 1"), (2, 1, "text 12"), (3, 0, "")]
    assert toxicity.sample_rows(table, labels, 2).count() == 2


def test_cut_lies_in_the_gap():
    assert toxicity.best_cut(np.array([0.0, 0.0, 1.0, 4.0, 6.0]), np.array([False, False, False, True, True])) == 2.5
    assert toxicity.best_cut(np.array([3.0, 3.0]), np.array([True, True])) == 3.0
    z, toxic = np.array([0.0, 1.0, 2.0, 3.0]), np.array([False, True, False, True])
    assert toxicity.best_cut(z, toxic) == 0.5


def corpus(spark, docs):
    rng = np.random.default_rng(1)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words, bad = list(rng.choice(plain, 30)), i % 4 == 0
        if bad:
            for _ in range(rng.integers(1, 4)):
                words.insert(int(rng.integers(0, 30)), rng.choice(["nasty", "Vilelike", "vilething"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, docs(*rows), spark.createDataFrame(labels + [(1000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, docs, with_clashes):
    rows, table, labels = corpus(spark, docs)
    model = toxicity.train(with_clashes(table), labels.where("doc_id % 3 <> 0 OR doc_id IS NULL"), least_chi=20)
    assert b"nasty" in model.words and list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.predict(with_clashes(table), model).collect()}
    held = [i for i, _ in rows if i % 3 == 0]
    assert np.mean([got[i].toxic == (i % 4 == 0) for i in held]) > 0.95
    assert all(0 <= r.severity <= len(model.thresholds) for r in got.values())
    odd = {r.doc_id: r for r in toxicity.predict(docs((1, None), (2, ""), (3, "nasty " * 50_000), (None, "nasty vilething vileone")), model).collect()}
    assert not odd[1].toxic and odd[1].severity == odd[2].severity and odd[None].severity > odd[3].severity > 0.5


def test_copies_do_not_make_words_toxic(spark, docs):
    rows, _, labels = corpus(spark, docs)
    rows += [(2000 + i, "unlucky copied text here") for i in range(100)]
    labels = labels.union(spark.createDataFrame([(2000 + i, 1, 1) for i in range(100)], labels.schema))
    assert b"unlucky" not in toxicity.train(docs(*rows), labels, least_chi=20).words


def test_nothing_to_learn(spark, docs):
    table = docs((1, "a b"), (2, "c d"))
    for labels in ([], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1)]):
        model = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert [(r.severity, r.grade, r.toxic) for r in toxicity.predict(table, model).collect()] == [(0.0, 0, False)] * 2
    assert toxicity.predict(table.where("false"), model).count() == 0

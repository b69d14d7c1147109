import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nimbusops.llm import langid
from nimbusops.llm import text as T

EN = ["the cat sat on the mat with the other cat", "a dog and the cat ran to the house", "there is nothing in the house of the dog"]
DE = ["der hund und die katze sind in dem haus", "die katze schläft auf dem dach des hauses", "ein hund läuft durch das haus und bellt"]
TRAIN = [(i, (EN if i % 2 else DE)[i % 3], "en" if i % 2 else "de") for i in range(60)]


def gram_set(text):
    data, offsets = T.flat(pa.array([text]))
    return [h for hashes, _ in langid.grams(data, offsets) for h in hashes.tolist()]


def test_learns_and_decides(docs, with_clashes):
    model = langid.train(with_clashes(docs(*TRAIN, (99, "unlabelled", None))), F.col("doc_id") % 5 != 0, log_slots=16)
    assert sorted(model.languages) == ["de", "en"]
    table = docs((1, "the dog and the house"), (2, "die katze und das haus"), (3, None), (4, ""), (5, "1234 !? 99"), (6, "漢字"), (None, "the mat"),
                 (7, "the cat " * 50_000), (8, "A."))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(with_clashes(table), model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[None][0] == "en" and got[7][0] == "en"
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] in ("en", "de") and got[6][1] < 0.1
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = langid.known_language(with_clashes(table), model, 0.2)
    assert kept.columns == with_clashes(table).columns and {r.doc_id for r in kept.collect()} >= {1, 2, None, 7}
    assert {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5, 6})


def test_filters_hold_every_gram_and_count_like_sets(docs):
    rows = docs(*TRAIN)
    model = langid.train(rows, F.lit(True), log_slots=18)
    held = {lang: {g for x in texts for g in gram_set(x)} for lang, texts in (("en", EN), ("de", DE))}
    text = "the hund and ein house on dem dach"
    data, offsets = T.flat(pa.array([text]))
    found = langid.shares(model, data, offsets)[0]
    for i, lang in enumerate(model.languages):
        exact = np.mean([g in held[lang] for g in gram_set(text)])
        assert abs(found[i] - exact) < 0.02


def test_nothing_learned(docs):
    model = langid.train(docs((1, "x", None)), F.lit(True))
    assert [(r.lang_pred, r.score) for r in langid.predict(docs((1, "some text")), model).collect()] == [("und", 0.0)]
    assert langid.predict(docs((1, "x")).where("false"), model).count() == 0


def test_many_languages(docs):
    rows = [(i * 10 + j, f"wörd{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:02}") for i in range(20) for j in range(3)]
    model = langid.train(docs(*rows), F.lit(True), log_slots=16)
    assert model.masks.shape[1] == 3
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs(*rows), model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 50


def test_sample_is_bounded(docs):
    assert langid.training_rows(docs(*TRAIN), F.lit(True), 10).count() == 10


def test_rare_language_is_learned(spark):
    common = F.expr("element_at(array('the cat sat on the mat', 'a dog ran to the house', 'nothing is in the house'), cast(id % 3 as int) + 1)")
    rare = F.when(F.col("id") == 7, "ქართული ენა").otherwise("страна моя родная и большая")
    label = F.when(F.col("id") == 7, "ka").when(F.col("id") % 5000 == 0, "ru").otherwise("en")
    table = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(label == "en", common).otherwise(rare).alias("text"), label.alias("lang"))
    model = langid.train(table, F.lit(True))
    assert model.languages == ["en", "ru", "ka"]
    got = langid.predict(table.where("lang <> 'en'"), model).join(table, "doc_id").collect()
    assert len(got) == 21 and all(r.lang_pred == r.lang and r.score > 0.9 for r in got)
    rows = {r.lang: r["count"] for r in langid.training_rows(table, F.lit(True), 64).groupBy("lang").count().collect()}
    assert rows == {"en": 43, "ru": 20, "ka": 1}


def test_rows_of_each_language():
    assert langid.rows_each([30, 30], 10) == 5 and langid.rows_each([3, 4], 10) >= 4 and langid.rows_each([1, 20, 90], 64) == 43
    assert langid.rows_each([1000] * 200, 640) == 10 and langid.rows_each([9, 9, 9], 1) == 2

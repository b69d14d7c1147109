import re

import pytest

from nimbusops.llm import decontamination as D
from nimbusops.llm.decontamination import decontaminate, uncontaminated


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def judged(text, items, size=10):
    own, hit, ids = words(text), set(), set()
    for item, body in items:
        w = words(body)
        for win in {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else ():
            for p in range(len(own) - len(win) + 1):
                if tuple(own[p:p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    ids.add("" if item is None else str(item))
    return len(own), len(hit), sorted(ids)


LONG = " ".join(f"Tok{i % 7}en{i}" for i in range(40))
ITEMS = [(1, LONG), (12, "only Three words"), (3, "single"), (4, None), (5, " .,;"), (2, LONG[40:]), (7, "É École DÉJÀ vu"), (None, "no id here"),
         (9, "the the the the the the the the the the the the"), (1, "a second text of item one")]
TEXTS = [(1, LONG), (2, "x " + LONG.upper() + " y"), (3, LONG[:60]), (4, None), (5, ""), (6, "only-three, WORDS! and Single"), (7, "É École DÉJÀ vu"),
         (8, "É École DÉjÀ vu"), (9, "the " * 40), (10, "no id here no id here"), (11, " ".join(LONG.split()[5:14])), (12, LONG + " " + LONG),
         (13, "single"), (14, "singles"), (15, "filler " * 30_000 + LONG), (16, "a second text of item one"), (None, LONG)]


@pytest.mark.parametrize("broadcast_bytes", [D.BROADCAST_BYTES, 0])
def test_against_every_window(spark, docs, with_clashes, broadcast_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS w", "2 AS win")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in
           decontaminate(with_clashes(docs(*TEXTS)), bench, broadcast_bytes=broadcast_bytes).collect()}
    assert got == {i: judged(t, ITEMS) for i, t in TEXTS}


def test_rows_stay_one_to_one(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate(docs((1, LONG), (1, LONG), (1, "clean")), bench).collect()
    assert sorted(r.n_hit for r in rows) == [0, 40, 40]
    table = docs(*TEXTS)
    kept = uncontaminated(table, bench)
    assert kept.columns == table.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, t in TEXTS if not judged(t, ITEMS)[1])


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate(docs((1, "x")).where("false"), bench).count() == 0
    assert [r.n_items for r in decontaminate(docs((1, LONG)), bench.where("false")).collect()] == [0]

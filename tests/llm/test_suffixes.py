import collections

import numpy as np
import pytest

from nimbusops.llm import bwt, suffixes


def judged(rows, length):
    """(bytes, removed runs, bytes that stay) of each distinct (id, text), by looking at every string."""
    seen, out = set(), {}
    for doc_id, text in rows:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            part = body[p:p + length]
            if part in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(part)
        spans, at = [], 0
        while at < len(gone):
            if gone[at]:
                end = at
                while end < len(gone) and gone[end]:
                    end += 1
                spans.append((at, end))
                at = end
            at += 1
        out[doc_id] = (len(body), spans, bytes(b for b, g in zip(body, gone) if not g))
    return out


def found(df, **options):
    return {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffixes.remove_repeats(df, **options).collect()}


def test_repeats_on_the_transform():
    rng = np.random.default_rng(0)
    for _ in range(150):
        length = int(rng.integers(2, 30))
        base = rng.integers(97, 97 + rng.integers(1, 4), 400).astype(np.uint8)
        parts = []
        for _ in range(rng.integers(1, 12)):
            a = rng.integers(0, 350)
            parts.append(base[a:a + rng.integers(0, 50)].copy())
            if len(parts[-1]) and rng.random() < 0.5:
                parts[-1][rng.integers(0, len(parts[-1]))] = rng.integers(0, 256)
        expected, got = collections.defaultdict(set), collections.defaultdict(set)
        for i, x in enumerate(parts):
            for j in range(len(x) - length + 1):
                expected[x[j:j + length].tobytes()].add((i, j))
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        for i, j, k in zip(*bwt.repeats(np.concatenate(parts), bounds, length)):
            got[k].add((i, j))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}é" if i % 9 == 0 else f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words, n))
    passage, line = text(40), "x" * 130
    rows = [(5, text(60) + passage + text(50)), (2, passage), (9, text(30) + passage[3:200]), (11, "a" * 1000), (12, "a" * 99), (13, "a" * 100),
            (20, None), (21, ""), (22, "short"), (30, text(400)), (40, text(2000))]
    rows += [(41, rows[-1][1]), (42, rows[-2][1].replace("w9é", "changed")), (43, passage + " " + passage), (44, "ab" * 300)]
    rows += [(100 + i, f"{i} {line} {text(10)}") for i in range(30)]
    rows += [(200 + i, text(20) + " Éé" * 50 + text(i)) for i in range(10)]
    return rows


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"hot": 3, "limit": 400}, {"block_bytes": 500}, {"length": 70}])
def test_against_every_string(docs, with_clashes, options):
    rows = corpus()
    expected = judged(sorted(rows), options.get("length", 100))
    assert found(with_clashes(docs(*rows)).repartition(5), **options) == expected
    assert sum(len(s) for _, s, _ in expected.values()) > 20


def test_null_ids_and_repeated_rows(docs):
    body = " ".join(str(i) for i in range(200))
    got = found(docs((None, body), (4, body), (4, body), (4, body + " more")))
    assert got[None][1] == [] and len(got) == 2
    rows = suffixes.remove_repeats(docs((4, body), (4, body))).collect()
    assert [r.spans for r in rows] == [[], []]


def test_pipeline_form(docs, with_clashes):
    body = " ".join(str(i) for i in range(200))
    table = with_clashes(docs((1, body), (2, "é" + body[1:]), (3, None)))
    got = suffixes.without_repeats(table)
    assert got.columns == table.columns and got.schema["n_chars"].dataType == table.schema["n_chars"].dataType
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == body and rows[2].text == "é" and rows[2].n_chars == 1 and rows[3].text == "" and rows[2].key == "x"
    assert suffixes.without_repeats(table.where("false")).count() == 0
    assert suffixes.without_repeats(table.select("doc_id", "text")).columns == ["doc_id", "text"]


def test_thousands_of_texts_under_one_id(docs):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(3000)]
    passages = [" ".join(rng.choice(words, 20)) for _ in range(20)]
    texts = [f"{i} {' '.join(rng.choice(words, rng.integers(5, 40)))} {passages[i % 20] if i % 3 == 0 else ''}" for i in range(3000)]
    table = docs(*[(None, x) for x in texts])
    order = table.selectExpr("text", "xxhash64(text) AS h").orderBy("h").collect()
    expected = judged([(r.text, r.text) for r in order], 100)
    got = suffixes.remove_repeats(table, carry=("text",)).collect()
    assert {r.row.text: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got} == expected
    assert len(got) == 3000 and sum(len(s) for _, s, _ in expected.values()) > 900


def test_claims_are_judged_by_bytes(spark, docs):
    rng = np.random.default_rng(6)
    a, b, c = ("".join(rng.choice(list("abcdefgh "), 5000)) for _ in range(3))
    table = docs((1, a), (2, a[:2500] + b[2500:]), (3, c))
    tag = {r.doc_id: r.tag for r in table.selectExpr("doc_id", "xxhash64(text) AS tag").collect()}
    claim = lambda of, to: (to, tag[to], 0, 5000, None, None, of, tag[of], 0)
    runs = spark.createDataFrame([claim(1, 2), claim(1, 3)], "key long, tag long, start long, end long, g long, n long, of_key long, of_tag long, at long")
    marks = suffixes.find_claimed(table, runs, 100, suffixes.BLOCK_BYTES).collect()
    gone = {(r.key, p) for r in marks for p in range(r.start, r.end)}
    common = next(i for i in range(2500, 5001) if i == 5000 or a[i] != b[i])
    assert gone == {(2, p) for p in range(common)}


def test_runs_of_equal_hash_are_claims(docs):
    body = " ".join(str(i) for i in range(3000))
    runs = suffixes.find_runs(docs((1, body), (2, body), (3, "x" + body[50:9000])), 100, 1 << 20).collect()
    claims = [r for r in runs if r.g is None]
    assert claims and all((r.of_key, r.at) < (r.key, r.start) and r.end - r.start >= 100 for r in claims)

"""Every registered corpus query on the smallest tables: against its SQL, or a brute-force version."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from compare import differences, duck
from test_lm import scores
from test_simhash import groups

import __spark_entry__ as entry
from nimbusops.llm import lm, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name):
    return entry.queries()[name](spark, SF)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def test_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, len(names) + 1))


@pytest.mark.parametrize("name", [n for n in entry.corpus_queries() if n in entry.oracle_sql()])
def test_against_sql(spark, name):
    assert differences(rows(spark, name), duck(SF), entry.oracle_sql()[name]) == []


def test_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in rows(spark, "op1_toxicity").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert np.mean([got[i].toxic == bool(x) for i, x in labels.items() if i in got]) > 0.9


def test_toxicity_against_plain(spark, texts):
    """The fitted model's scores, word by word."""
    model = toxicity.train(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    weight = dict(zip(model.words, model.weights.tolist()))
    got = {r.doc_id: r for r in rows(spark, "op1_toxicity").collect()}
    for i, text in texts:
        body = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        words = set(re.findall(rb"[0-9a-z\x80-\xff]+", body))
        marks = words | {w[:n] + b"*" for w in words for n in (6, 7) if len(w) > n}
        z = sum(weight.get(w, 0.0) for w in marks)
        at_least = [1 / (1 + math.exp(min(60.0, max(-60.0, t - z)))) for t in model.thresholds]
        exact = [a - b for a, b in zip([1.0, *at_least], [*at_least, 0.0])]
        assert abs(got[i].severity - sum(at_least)) < 1e-6 and exact[got[i].grade] > max(exact) - 1e-9
        assert abs(z - model.cut) < 1e-6 or got[i].toxic == (z >= model.cut)


def test_language_against_sets(spark, texts):
    """Languages as sets of n-grams that two of their training texts hold."""
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}

    def grams(text):
        body = b" " + b" ".join(re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode() if (text or "").isascii() else re.sub(
            rb"[A-Z]", lambda m: m[0].lower(), text.encode()))) + b" "
        return [body[i:i + n] for n in (3, 5) for i in range(len(body) - n + 1)]

    train = [(lang[i], set(grams(t))) for i, t in texts if crc(i) and lang[i] is not None]
    size = Counter(x for x, _ in train)
    counts = {x: Counter(g for y, held in train if y == x for g in held) for x in size}
    sets = {x: {g for g, n in counts[x].items() if n >= min(2, size[x])} for x in size}
    for r in rows(spark, "op8_language_filters").collect():
        text = dict(texts)[r.doc_id]
        if not regex.search(r"\p{L}", text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        own = grams(text)
        share = {x: sum(g in held for g in own) / max(1, len(own)) for x, held in sets.items()}
        assert abs(share[r.lang_pred] - r.score) < 0.02 and share[r.lang_pred] > max(share.values()) - 0.02


def test_trie_and_repair_are_whole(spark):
    convs = spark.read.parquet(f"{SF}/conversations.parquet")
    n = convs.select("conv_id").distinct().count()
    assert rows(spark, "op12_structure_repair").count() == n
    assert rows(spark, "op11_prefix_trie").where("depth = 0").first().n_convs == n


def test_quality(spark, texts):
    got = rows(spark, "op13_quality").collect()
    assert {r.doc_id: r.held_out for r in got} == {i: crc(i) == 0 for i, _ in texts}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_sentencepiece(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = set()
    for doc_id, text in texts:
        ids = model.encode(text or "", add_bos=True, add_eos=True)
        expected.add((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                      hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    got = rows(spark, "op2_sentencepiece").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert {tuple(r) for r in got.collect()} == expected


def test_ngram_trie(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op3_ngram_trie").collect()}
    for i, (held, n, known, total, base, model) in scores(texts, lambda i: crc(i) == 1, lm.SMOOTHING, lm.PAIRS).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and abs(r.score - model) <= 1e-3 * (n + 1)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # context helps on unseen texts


def test_language_filters(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = rows(spark, "op8_language_filters").collect()
    assert {r.doc_id: r.held_out for r in got} == {i: crc(i) == 0 for i in lang}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_packing(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    length = {i: len(model.encode(t or "", add_bos=True, add_eos=True)) for i, t in texts}
    found, filled = {}, 0
    for r in rows(spark, "op9_packing").collect():
        assert r.n_tokens == r.cu_seqlens[-1] <= 2048 and len(r.doc_ids) == len(r.parts) == len(r.cu_seqlens) - 1
        filled += 1
        for doc, part, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
            found.setdefault(doc, {})[part] = b - a
    assert {i: sum(parts.values()) for i, parts in found.items()} == length
    assert filled <= 1.1 * sum(length.values()) / 2048 + 1


def test_simhash(spark, texts):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows(spark, "op10_simhash").collect()}
    assert got == groups(texts)

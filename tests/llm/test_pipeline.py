import hashlib
import struct
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from test_decontamination import judged as leaked
from test_simhash import groups
from test_suffixes import judged as repeated

import __spark_entry__ as entry
import corpus_pipeline
from nimbusops.llm import langid
from nimbusops.llm.queries import crc_class

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def test_registered():
    assert "pipeline" in entry.queries()
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmark_leaks", "encode"]


def test_run_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = langid.train(docs, crc_class() != 0)
    rows = {r.doc_id: r.text for r in langid.known_language(docs, model, corpus_pipeline.LEAST_LANGUAGE_SCORE).collect()}
    assert len(rows) == docs.count()  # nothing in these tables is without a language
    least = groups(sorted(rows.items()))
    rows = {i: t for i, t in rows.items() if least[i][1] == i}
    rows = {i: kept.decode("utf-8", "ignore") for i, (_, _, kept) in repeated(sorted(rows.items()), 100).items()}
    rows = {i: t for i, t in rows.items() if not leaked(t, items)[1]}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = set()
    for i, text in rows.items():
        ids = sp.encode(text, add_bos=True, add_eos=True)
        expected.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == expected


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_bear_odd_rows(spark, docs, with_clashes, name, stage):
    odd = with_clashes(docs((1, None), (2, ""), (None, "text without an id"), (4, "the same text"), (5, "the same text"), (6, "long " * 30_000), (7, "7!")))
    for table in (odd, odd.where("false")):
        got = stage(spark, table, SF)
        got.collect()
        if name != "encode":
            assert got.columns == table.columns

import hashlib
import struct

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nimbusops.llm import sentencepieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = S.load(PATH)
TABLE = S.ChunkTable(MODEL, rows=50)


def encoded(text):
    return MODEL.encode(text or "", add_bos=True, add_eos=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" ▁ab\n\té€漢\x00<s>", max_size=14), st.text(max_size=20)), min_size=1, max_size=8))
def test_ids_are_the_librarys(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    ids, bounds = S.encode_batch(TABLE, pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [encoded(t) for t in texts]


def test_whole_run(docs, with_clashes):
    texts = [None, "", " ", "  two  runs ", "plain text", "plain text", "word " * 200_000, "x" * 30_000, "tab\tand\nline", "▁mark ▁▁"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id")]
    got = {r.doc_id: r for r in S.digests(S.encode_decode(with_clashes(docs(*rows)), PATH)).collect()}
    for i, text in rows:
        ids = encoded(text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(MODEL.decode(ids).encode()).hexdigest()


def test_empty_table(docs):
    assert S.digests(S.encode_decode(docs((1, "x")).where("false"), PATH)).count() == 0


def test_table_is_bounded():
    table = S.ChunkTable(MODEL, rows=10)
    for i in range(30):
        S.encode_batch(table, pa.array([f"w{i} v{i} u{i}"]))
        assert len(table.row) <= 10


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        S.load(str(tmp_path / "none.model"))

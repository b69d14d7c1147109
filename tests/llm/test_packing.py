import numpy as np
import public_tokenizers
import sentencepiece

from nimbusops.llm import packing
from nimbusops.session import Staging

PATH = public_tokenizers.path("piece_bpe_32k.model")


def naive(lengths, length):
    rows, rooms = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            at = rooms.index(min(fits))
        else:
            at = len(rows)
            rows.append([])
            rooms.append(length)
        rows[at].append(int(i))
        rooms[at] -= lengths[i]
    return rows, rooms


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(0)
    for length in (1, 2, 7, 8, 100, 2048):
        lengths = rng.integers(1, length + 1, 300)
        rows = packing.best_fit(lengths, length)
        assert sorted(i for r in rows for i in r) == list(range(300))
        assert sorted(length - lengths[r].sum() for r in rows) == sorted(naive(lengths, length)[1])
    assert packing.best_fit(np.empty(0, np.int64), 8) == []


def test_nothing_is_lost(spark, docs, with_clashes):
    rows = [(i, f"text number {i} " * (i % 40)) for i in range(100)] + [(500, "word " * 20_000), (501, None), (502, ""), (None, "no id"), (500, "twice")]
    staging = Staging(spark)
    folder = f"{staging.path}/shards"
    table = with_clashes(docs(*rows)).coalesce(2)
    index = staging.write("index", packing.write(table, folder, PATH, length=128, buffer_tokens=3000))
    got = packing.read(index, folder).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    parts = {}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.n_tokens == len(ids) <= 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == len(ids)
        for doc, part, a, b in zip(r.doc_ids, r.parts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(doc, []).append((part, ids[a:b]))
    whole = lambda d: [i for _, ids in sorted(parts[d]) for i in ids]
    for doc, text in rows[:-1]:
        if doc != 500:
            assert whole(doc) == model.encode(text or "", add_bos=True, add_eos=True)
    both = sum(len(model.encode(t, add_bos=True, add_eos=True)) for d, t in rows if d == 500)
    assert sum(len(ids) for _, ids in parts[500]) == both
    assert packing.write(docs((1, "x")).where("false"), folder, PATH).count() == 0

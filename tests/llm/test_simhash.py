import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from nimbusops.llm import simhash
from nimbusops.llm import text as T


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    prints = [(i, fingerprint(x)) for i, x in rows]
    least = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 3 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return {i: (f, least[i]) for i, f in prints}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n x", max_size=30), min_size=1, max_size=6))
def test_fingerprints(texts):
    bodies = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    got = simhash._fingerprints(np.frombuffer(b"".join(bodies), np.uint8), offsets, 3)
    assert got.tolist() == [fingerprint(t) for t in texts]


def test_links_form_stars_over_tiles():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[:20] ^ np.uint64(5)
    member, least = simhash._links(base, near, 3)
    assert {frozenset(x) for x in zip(member.tolist(), least.tolist())} == {frozenset(x) for x in zip(base[:20].tolist(), near.tolist())}
    member, least = simhash._links(np.arange(300, dtype=np.uint64), None, 3)
    assert len(member) == 299 and set(least.tolist()) == {0}


@pytest.mark.parametrize("tile", [2, 8192])
def test_near_duplicates(docs, with_clashes, tile):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(7, long), (3, long.replace("word200", "other")), (9, long), (1, None), (4, ""), (5, " \n"), (2, "one two"),
            (8, "ONE  two"), (6, "é" * 5000), (9, long)]
    rows += [(100 + i, long.replace(f"word{i * 9}", "changed")) for i in range(20)]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(with_clashes(docs(*rows)), tile=tile).collect()}
    assert got == groups(rows)
    assert got[1][1] == got[4][1] == got[5][1] == 1 and got[1][0] == 0 and got[8][1] == 2 and got[9][1] == 3


def test_empty_table_and_representatives(docs):
    empty = docs((1, "x")).where("false")
    assert simhash.near_duplicates(empty).count() == 0
    table = docs((2, "a b c"), (1, "a b c"), (None, "other words here"), (5, "something else now"))
    kept = simhash.representatives(table)
    assert kept.columns == table.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a b c"), ("5", "something else now"), ("None", "other words here")]


def test_words_of_texts_side_by_side():
    data, offsets = T.flat(__import__("pyarrow").array(["ab", "cd ", " ", None, "e"]))
    starts, ends, upto = T.words(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"cd", b"e"] and upto.tolist() == [0, 1, 2, 2, 2, 3]

import hashlib
import random
from collections import defaultdict

import pytest

from nimbusops.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def tree(convs):
    """Nodes of {conv_id: [(role, text), ...]} by plain counting."""
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for conv_id, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(conv_id)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(conv_id)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        parts = [below[c] for c in children[node]]
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below[node] = (sum(p[0] for p in parts) if parts else 1, own + sum(p[1] for p in parts))
    return {(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), *below[n],
             hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()}


def nodes(df):
    rows = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def table(spark, convs, rows=()):
    data = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(data + list(rows), SCHEMA)


def random_convs(seed, n):
    draw = random.Random(seed)
    shared = [("system", "s" * draw.randint(0, 5))]
    convs = {}
    for c in range(n):
        turns = (shared if draw.random() < 0.5 else []) + [(draw.choice("ua"), draw.choice(["x", "yy", ""])) for _ in range(draw.choice([0, 1, 1, 2, 4, 7]))]
        convs[c] = (draw.choice(list(convs.values())) if convs and draw.random() < 0.3 else turns) or [("u", "x")]
    return convs


@pytest.mark.parametrize("piece, fan", [(tries.PIECE_BYTES, tries.FAN), (700, 2), (1, 2)])
def test_against_counting(spark, monkeypatch, piece, fan):
    for seed in range(2):
        convs = random_convs(seed, 300)
        spread = table(spark, convs).repartition(4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, so that forests meet
        try:
            assert nodes(tries.prefix_trie(tries.turns(spread), piece, fan)) == tree(convs)
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pieces_without_spark():
    """Every way to cut a sorted run into ranges and pieces gives the same closed chains."""
    convs = random_convs(5, 120)
    order = sorted((b"".join(hashlib.md5(repr(t).encode()).digest() for t in turns), c) for c, turns in convs.items())
    chars = {c: [len(t[1]) for t in turns] for c, turns in convs.items()}
    np = pytest.importorskip("numpy")

    def run(cuts, piece):
        def parts(rows):
            for body, c in rows:
                yield tries.Part(body, np.array(chars[c], np.int64), c)

        chains, forests = [], []
        for no, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(order)])):
            for batch in tries._settle(parts(order[a:b]), tries.Rows(), no, False, piece):
                for r in batch.to_pylist():
                    (chains if r["kind"] == tries.CHAIN else forests).append(r)
        again = (tries.Part(r["body"], np.array(r["chars"], np.int64), r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved"]) for r in forests)
        for batch in tries._settle(again, tries.Rows(), 0, True, piece):
            chains += batch.to_pylist()
        return sorted((r["key"], r["parent"] or b"", r["depth"], tuple(r["chars"]), r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"]) for r in chains)

    whole = run([], 1 << 30)
    draw = random.Random(9)
    for _ in range(40):
        assert run(sorted(draw.sample(range(1, len(order)), draw.randint(1, 30))), draw.choice([1, 400, 3000, 1 << 30])) == whole


def test_heads(spark):
    from pyspark.sql import functions as F

    convs = {0: [("u", "a"), ("a", "b"), ("u", "c")], 1: [("u", "d")], 2: [("u", "e"), ("a", "f"), ("u", "g")], 107: [("u", "h"), ("a", "i")]}
    listed = tries.turns(table(spark, convs))
    c = F.col("conv_id")
    made = tries.with_heads(listed, c - c % 100, F.when(c == 107, 1).when(c == 1, 5).otherwise(2), 5)
    got = {r.conv_id: [t.digest for t in r.turns] for r in made.collect()}
    own = {r.conv_id: [t.digest for t in r.turns] for r in listed.collect()}
    assert got == {0: own[0], 1: own[0], 2: own[0][:2] + own[2][2:], 107: own[107][1:]}


def test_odd_rows(spark, with_clashes):
    long = "x" * 100_000
    rows = [(7, None, None, None), (7, 3, "u", long), (7, 3, "u", long), (None, 1, "u", "lost"), (8, None, "", ""), (-4, 1, "u", "é😀")]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = nodes(tries.prefix_trie(tries.turns(df)))
    assert got == tree({7: [("", ""), ("u", long), ("u", long)], 8: [("", "")], -4: [("u", "é😀")]})
    assert tries.prefix_trie(tries.turns(spark.createDataFrame([], SCHEMA))).count() == 0
    other = spark.createDataFrame([(1, 2, "u:1", "x"), (2, 2, "u", "1:x"), (3, 1, "u", "b"), (3, 1, "u", "a")], SCHEMA)
    assert tries.prefix_trie(tries.turns(other)).where("depth = 1").count() == 3  # roles and texts don't run together
    assert tries.prefix_trie(tries.turns(other)).where("depth = 2").count() == 1


def test_turnless(spark):
    """A conversation whose turns all fall to an absent head is a member of the root that ends there."""
    from pyspark.sql import functions as F

    convs = {5: [("u", "a")], 205: [("u", "a")], 206: [("u", "a"), ("a", "b")]}
    c = F.col("conv_id")
    made = tries.with_heads(tries.turns(table(spark, convs)), c - c % 100, F.lit(1), 5)
    assert nodes(tries.prefix_trie(made)) == tree({5: [], 205: [], 206: [("a", "b")]})

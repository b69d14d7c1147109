"""Exact top-k inner products by vector approximation files.

Every component x becomes the integer floor(scale * x). Vectors are dealt to blocks, and each block is
written to the approximation file: one byte per component, the number of its cell between the block's
quantiles, and the cells' edges. The exact integers stay in a table of their own.

1. The approximation file alone is scanned. A block of queries and a block of cells give bounds of every score from both sides
   (two small matrix products, as a bound is linear in the cells' edges once a query's signs are
   known). Left are the candidates whose upper bound reaches the k-th lower bound of the block, and those k lower bounds.
2. The k-th lower bound over all blocks rules out most of these.
3. Only vectors that are a candidate of some query are read from the exact table. Per query they are scored in
   the order of their upper bounds until the k-th exact score is above every bound left.

All pairs of blocks are compared, as the stated query set needs; of pairs of rows, only candidates are written.
A task holds a block of queries with one of candidates, or with the exact vectors wanted of one.

Vectors that are null or hold a null or non-finite component take no part. Only vectors of equal
length meet. Rows count one by one: where rows repeat a vec_id, each is a candidate of its own (never of a query
with that id), and the ranks of a query id are those of the scores of all its rows together, so a
candidate can have several. Scores are exact while components times scale, and scores, stay below 2**53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbusops.llm.batches import bounded
from nimbusops.session import Staging

CELLS = 64
BLOCK = 8192
QUERY_BLOCK = 4096
READ = 256

_FOUND = pa.schema([("length", pa.int32()), ("b", pa.int32()), ("g", pa.int32()), ("q", pa.int64()), ("least", pa.list_(pa.float64())),
                    ("rows", pa.list_(pa.int64())), ("most", pa.list_(pa.float64()))])
_FOUND_DDL = "length int, b int, g int, q long, least array<double>, rows array<long>, most array<double>"


def integers(vectors: DataFrame, scale: int = 64, *more: str) -> DataFrame:
    """vec_id, `row`, a number of its own, length and `v`, the integer components, of the vectors that take part."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return bounded(vectors).select("vec_id", "embedding", *more).where("vec_id is not null").where(usable).select(
        "vec_id", *more, F.monotonically_increasing_id().alias("row"), F.size("embedding").alias("length"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, length: int) -> np.ndarray:
    body = column.combine_chunks()
    return body.flatten().to_numpy(zero_copy_only=False).reshape(len(body), length)


def approximate(v: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Cell number of each component, and per cell and dimension the least and greatest value inside it."""
    codes = np.empty(v.shape, np.uint8)
    edges = np.zeros((2, cells, v.shape[1]))
    for d in range(v.shape[1]):
        cuts = np.unique(np.quantile(v[:, d], np.linspace(0, 1, cells + 1)[1:-1], method="lower"))
        codes[:, d] = np.searchsorted(cuts, v[:, d], "left")
        order = np.argsort(codes[:, d], kind="stable")
        used, first = np.unique(codes[order, d], return_index=True)
        edges[0, used, d] = np.minimum.reduceat(v[order, d], first)
        edges[1, used, d] = np.maximum.reduceat(v[order, d], first)
    return codes, edges


def approximation_file(rows: DataFrame, n_blocks: Column, cells: int = CELLS) -> DataFrame:
    """A row per block: length, b, the ids and rows of its vectors, their cell numbers and the cells' edges."""

    def cut(table: pa.Table) -> pa.Table:
        length = table.column("length")[0].as_py()
        codes, edges = approximate(_matrix(table.column("v"), length), cells)
        ids, numbers = (table.column(c).to_numpy().astype("<i8") for c in ("vec_id", "row"))
        return pa.table({"length": pa.array([length], pa.int32()), "b": pa.array([table.column("b")[0].as_py()], pa.int32()),
                         "ids": [ids.tobytes()], "numbers": [numbers.tobytes()], "codes": [codes.tobytes()], "edges": [edges.astype("<f8").tobytes()]})

    dealt = rows.withColumn("b", F.pmod(F.xxhash64("row"), n_blocks).cast("int"))
    return dealt.groupBy("length", "b").applyInArrow(cut, "length int, b int, ids binary, numbers binary, codes binary, edges binary")


def bounds(codes: np.ndarray, edges: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each query (row) can have with each vector of a block (column)."""
    columns = np.arange(codes.shape[1])
    low, high = edges[0][codes, columns], edges[1][codes, columns]
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


def scan(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, codes: np.ndarray, edges: np.ndarray, k: int):
    """Per query the k best lower bounds of a block, and the places and upper bounds of its candidates."""
    for i in range(0, len(queries), READ):
        least, most = bounds(codes, edges, queries[i:i + READ].astype(np.float64))
        for j in range(len(least)):
            own = np.flatnonzero(ids != q_ids[i + j])
            best = least[j][own]
            if len(best) > k:
                best = np.partition(best, len(best) - k)[len(best) - k:]
            near = own[most[j][own] >= best.min()] if len(best) else own
            yield i + j, best, near, most[j][near]


def best_of(query: np.ndarray, v: np.ndarray, ids: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best candidates, read in the order of their bounds until they are certain."""
    order = np.argsort(-most, kind="stable")
    at, scores = np.empty(0, np.int64), np.empty(0)
    for i in range(0, len(order), READ):
        if len(scores) >= k and most[order[i]] < scores[k - 1]:
            break
        more = order[i:i + READ]
        at, scores = np.append(at, more), np.append(scores, v[more] @ query)
        best = np.lexsort((ids[at], -scores))[:k]
        at, scores = at[best], scores[best]
    return at, scores


def candidates(cells: DataFrame, queries: DataFrame, n_groups: Column, n_blocks: Column, k: int) -> DataFrame:
    """length, b, g (blocks of vectors and queries), q, row and `most`, the upper bound, of what the scan leaves."""
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    none = {c: F.lit(None).cast(t) for c, t in {"vec_id": "long", "row": "long", "v": "array<long>", "ids": "binary", "numbers": "binary",
                                                 "codes": "binary", "edges": "binary"}.items()}
    columns = ["length", "b", "g", *none]
    left = cells.withColumns({c: none[c] for c in ("vec_id", "row", "v")}).withColumn("g", every(n_groups)).select(columns)
    right = queries.withColumns({c: none[c] for c in ("ids", "numbers", "codes", "edges")}).withColumn("b", every(n_blocks)).select(columns)

    def meet(table: pa.Table) -> pa.Table:
        length, b, g = (table.column(c)[0].as_py() for c in ("length", "b", "g"))
        block = table.filter(table.column("codes").is_valid())
        asked = table.filter(table.column("codes").is_null())
        out = []
        if len(block) and len(asked):
            one = block.slice(0, 1).to_pylist()[0]
            ids, numbers = np.frombuffer(one["ids"], "<i8"), np.frombuffer(one["numbers"], "<i8")
            codes, edges = np.frombuffer(one["codes"], np.uint8).reshape(-1, length), np.frombuffer(one["edges"], "<f8").reshape(2, -1, length)
            q = asked.column("row").to_numpy()
            for j, best, near, most in scan(asked.column("vec_id").to_numpy(), _matrix(asked.column("v"), length), ids, codes, edges, k):
                out.append((length, b, g, q[j], best, numbers[near], most))
        return pa.table([pa.array([x[i] for x in out], f.type) for i, f in enumerate(_FOUND)], schema=_FOUND)

    return left.union(right).groupBy("length", "b", "g").applyInArrow(meet, _FOUND_DDL)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block: int = BLOCK,
          query_block: int = QUERY_BLOCK, cells: int = CELLS) -> DataFrame:
    """query_id, rank from 1, vec_id and score: the k highest integer inner products of every query id with
    all rows of another id, ties to the smaller vec_id."""
    staging = Staging(vectors.sparkSession)
    rows = staging.write("exact", integers(vectors.withColumn("_asked", is_query), scale, "_asked").withColumnRenamed("_asked", "is_query"))
    sizes = {r["length"]: (max(1, -(-r["n"] // block)), max(1, -(-r["q"] // query_block))) for r in
             rows.groupBy("length").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).collect()}
    if not sizes:
        return rows.selectExpr("vec_id query_id", "length rank", "vec_id", "vec_id score").limit(0)
    of_length = lambda i: F.create_map(*[F.lit(x) for n, s in sizes.items() for x in (n, s[i])])[F.col("length")]
    n_blocks, n_groups = of_length(0), of_length(1)
    queries = rows.where("is_query").withColumn("g", F.pmod(F.xxhash64("row"), n_groups).cast("int")).select("length", "g", "vec_id", "row", "v")
    file = staging.write("cells", approximation_file(rows, n_blocks, cells))
    found = staging.write("bounds", candidates(file, queries, n_groups, n_blocks, k))
    best_first = Window.partitionBy("q").orderBy(F.desc("bound"))
    limits = found.select("q", F.explode("least").alias("bound")).withColumn("n", F.row_number().over(best_first)).where(
        F.col("n") <= k).groupBy("q").agg(F.min("bound").alias("bound"), F.count("*").alias("n")).select(
        F.col("q").alias("of"), F.when(F.col("n") == k, F.col("bound")).otherwise(float("-inf")).alias("bound"))
    reached = F.filter(F.arrays_zip("rows", "most"), lambda x: x["most"] >= F.col("bound"))
    left = staging.write("candidates", found.join(limits, F.col("q") == F.col("of")).select(
        "length", "b", "g", "q", F.inline(reached).alias("row", "most")))
    # Exact vectors: those of candidates and of their queries, once per pair of blocks.
    wanted = left.select("length", "b", "g", "row").distinct().union(left.select("length", "b", "g", F.col("q").alias("row"))).distinct()
    exact = wanted.join(rows.select("row", "vec_id", "v"), "row")
    null = {c: F.lit(None) for c in ("q", "most", "vec_id", "v")}
    both = exact.select("length", "b", "g", "row", "vec_id", "v", null["q"].cast("long").alias("q"), null["most"].cast("double").alias("most")).union(
        left.select("length", "b", "g", "row", null["vec_id"].cast("long"), null["v"].cast("array<long>"), "q", "most"))

    def read(table: pa.Table) -> pa.Table:
        vectors = table.filter(table.column("q").is_null())
        pairs = table.filter(table.column("q").is_valid()).sort_by("q")
        numbers = vectors.column("row").to_numpy()
        order = np.argsort(numbers)
        numbers, ids = numbers[order], vectors.column("vec_id").to_numpy()[order]
        v = _matrix(vectors.column("v"), table.column("length")[0].as_py())[order].astype(np.float64)
        q, most = pairs.column("q").to_numpy(), pairs.column("most").to_numpy()
        place = np.searchsorted(numbers, pairs.column("row").to_numpy())
        edges = np.append(np.flatnonzero(np.append(True, q[1:] != q[:-1])), len(q)) if len(q) else [0]
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            asked = np.searchsorted(numbers, q[a])
            at, scores = best_of(v[asked], v[place[a:b]], ids[place[a:b]], most[a:b], k)
            out.append((np.full(len(at), ids[asked]), ids[place[a:b]][at], scores))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (p.astype(np.int64) for p in parts), strict=True)))

    scored = both.groupBy("length", "b", "g").applyInArrow(read, "query_id long, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

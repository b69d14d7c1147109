"""Connected components of a link table by alternating large and small stars.

Each round is two aggregations and joins over the links, written to the shared folder. A hot centre is
pre-aggregated before its shuffle, and the join back is one that adaptive execution can split. Only
two numbers per round come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbusops.session import Staging

MAX_ROUNDS = 100


def _stars(pairs: DataFrame, least: DataFrame) -> DataFrame:
    return pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _signature(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]


def components(links: DataFrame, staging: Staging) -> DataFrame:
    """node and root (the least node that links reach), for nodes that have a link to another node."""
    a, b = links.columns
    edges = staging.write("round-0", links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = _signature(edges)
    for i in range(1, MAX_ROUNDS + 1):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staging.write(f"large-{i}", _stars(both.where("v > u"), least).select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _stars(large, least).union(least.select("u", F.col("m").alias("v"))).select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = staging.write(f"round-{i}", small)
        now = _signature(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Exact medians that never gather the rows of a key, nor all its values, in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nimbusops.session import Staging

BUCKETS = 4096  # of a range that is refined
MOST_VALUES = 10_000  # distinct ones that are ranked in one task


def value_histogram(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Rows per key, metric and value (NULL values included): keys, metric, x, n.

    Combined map-side; the shuffle spreads a hot key over its values.
    """
    points = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])
    return df.select(*keys, F.inline(points)).groupBy(*keys, "metric", "x").agg(F.count("*").alias("n"))


def _same(columns: Sequence[str]) -> Column:
    """Equality with columns of the other side, whose names start with an underscore; NULL equals NULL."""
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])


def _inside(values: DataFrame, ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values in the ranges of their key. Ranges are a row or two per key."""
    named = ranges.select(*[F.col(c).alias(f"_{c}") for c in by], "low", "high", "least", "greatest", "before")
    return values.join(named, _same(by)).where(F.col("x").between(F.col("least"), F.col("greatest")))


def _refined(values: DataFrame, ranges: DataFrame, by: Sequence[str], buckets: int) -> DataFrame:
    """The buckets of ranges that hold the middle ranks, as narrower ranges: the least and greatest of their
    values, the number of rows before them and of distinct values in them.

    Halves of the numbers are compared, so that no difference overflows; a range with two values at least always
    falls apart, as its ends are in the first and the last bucket.
    """
    half = [F.col(c) / 2 for c in ("x", "least", "greatest")]
    place = F.coalesce(F.floor((half[0] - half[1]) / F.nullif(half[2] - half[1], F.lit(0.0)) * buckets), F.lit(0))
    found = _inside(values, ranges, by).groupBy(*by, "low", "high", "least", "before", F.least(place, F.lit(buckets - 1)).alias("bucket")).agg(
        F.sum("n").alias("size"), F.count("*").alias("values"), F.min("x").alias("_least"), F.max("x").alias("_greatest"))
    earlier = W.partitionBy(*by, "least").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counted = found.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    return counted.where("before <= high and before + size > low").select(
        *by, "low", "high", F.col("_least").alias("least"), F.col("_greatest").alias("greatest"), "before", "values")


def histogram_medians(histogram: DataFrame, keys: Sequence[str], metrics: Sequence[str], most_values: int = MOST_VALUES,
                      buckets: int = BUCKETS) -> DataFrame:
    """Rows and interpolated median (NULLs and NaNs ignored, other values finite) per key: keys, `rows`, `median_<metric>`.

    The range of a key's values is cut into buckets again and again, keeping those that hold the middle
    ranks, until none of them has more than `most_values` distinct values; only these are ranked. So a task
    sees the buckets of one range or the values of a small one, never all rows or values of a key. The
    histogram is staged; one number per round comes to the driver. A NULL key is a key like any other.
    """
    by, staging = [*keys, "metric"], Staging(histogram.sparkSession)
    values = staging.write("values", histogram.withColumn("x", F.nanvl("x", F.lit(None).cast("double"))))
    known = F.col("x").isNotNull()
    totals = values.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("known"),
        F.count("x").alias("values"), F.min("x").alias("least"), F.max("x").alias("greatest")).withColumns(
        {"low": F.floor((F.col("known") - 1) / 2), "high": F.floor(F.col("known") / 2), "before": F.lit(0).cast("long")})
    totals = staging.write("totals", totals)
    ranges, rounds = totals.drop("rows", "known"), 0
    while (ranges.agg(F.max("values")).first()[0] or 0) > most_values:
        rounds += 1
        small = F.col("values") <= most_values
        finer = _refined(values, ranges.where(~small), by, buckets).unionByName(ranges.where(small))
        ranges = staging.write(f"ranges-{rounds}", finer)
        if rounds > 1:
            staging.drop(f"ranges-{rounds - 1}")
    smaller = F.sum("n").over(W.partitionBy(*by, "least").orderBy("x").rowsBetween(W.unboundedPreceding, -1))
    ranked = _inside(values, ranges, by).withColumn("first", F.col("before") + F.coalesce(smaller, F.lit(0)))
    last = F.col("first") + F.col("n") - 1

    def holds(rank: str) -> Column:
        return F.col(rank).between(F.col("first"), last).cast("int")

    share = F.col("x") * (holds("low") + holds("high")) / 2
    middles = ranked.groupBy(*by).agg(F.sum(share).alias("median")).select(*[F.col(c).alias(f"_{c}") for c in by], "median")
    return totals.join(middles, _same(by), "left").groupBy(*keys).agg(
        F.max("rows").alias("rows"), *[F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"median_{m}") for m in metrics])

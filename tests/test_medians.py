import random
import statistics

from pyspark.sql import functions as F

from nimbusops.operators.medians import histogram_medians, value_histogram


def brute_force(rows, metric):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row[metric])
    return {k: statistics.median(known) if (known := [v for v in vs if v is not None]) else None for k, vs in groups.items()}


def test_medians_with_a_hot_key(spark):
    """Half of all rows in one key, continuous and whole values, missing values and a key without any."""
    rng = random.Random(3)
    keys = ["hot"] * 5 + ["a", "b", "c", "d"]
    rows = [(rng.choice(keys), rng.uniform(-500, 5000), float(rng.randrange(-30, 30))) for _ in range(6000)]
    rows += [("one", 7.5, None), ("two", 1.0, 3.0), ("two", 2.0, 8.0), ("empty", None, None)]
    rows += [("hot", None, 1.0)] * 50
    frame = spark.createDataFrame(rows, "k string, x double, y double")
    result = histogram_medians(value_histogram(frame, ["k"], ["x", "y"]), ["k"], ["x", "y"]).collect()
    got = {r.k: r for r in result}
    assert set(got) == {r[0] for r in rows}
    for metric, name in ((1, "median_x"), (2, "median_y")):
        for key, expected in brute_force(rows, metric).items():
            value = got[key][name]
            assert value == expected or abs(value - expected) < 1e-9, (key, name)
    assert got["hot"].rows == sum(r[0] == "hot" for r in rows)


def test_refinement_does_not_matter(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-9), rng.gauss(0, 1e300), float(rng.randrange(3))]) for _ in range(1001)]
    frame = spark.createDataFrame([(rng.choice("ab"), x) for x in values] + [("c", -1.7e308), ("c", 1.7e308), ("c", 3.0), ("c", float("nan"))], "k string, x double")
    histogram = value_histogram(frame, ["k"], ["x"])
    results = [sorted(map(tuple, histogram_medians(histogram, ["k"], ["x"], *how).collect())) for how in ((1, 2), (3, 16), (10_000,))]
    assert results[0] == results[1] == results[2]
    assert dict((k, m) for k, _, m in results[0])["c"] == 3.0 and results[0][2][1] == 4
    for key, expected in brute_force([(r.k, r.x) for r in frame.where("k < 'c'").collect()], 1).items():
        assert dict((k, m) for k, _, m in results[0])[key] == expected


def test_millions_of_values_within_a_minute(spark):
    """A hot key with two million distinct values, all within 60, beside a small one."""
    x = F.when(F.col("id") < 2_000_000, F.pmod(F.col("id") * 7919, F.lit(2_000_003)) / F.lit(2_000_003.0) * 60)
    frame = spark.range(2_000_101).select(F.when(F.col("id") < 2_000_000, "hot").otherwise("small").alias("k"),
                                          F.coalesce(x, (F.col("id") - 2_000_000).cast("double")).alias("x"))
    got = {r.k: (r.rows, r.median_x) for r in histogram_medians(value_histogram(frame, ["k"], ["x"]), ["k"], ["x"]).collect()}
    places = sorted(i * 7919 % 2_000_003 for i in range(2_000_000))
    assert got["small"] == (101, 50.0) and got["hot"][0] == 2_000_000
    assert abs(got["hot"][1] - (places[999_999] + places[1_000_000]) / 2 / 2_000_003 * 60) < 1e-9


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert histogram_medians(value_histogram(empty, ["k"], ["x"]), ["k"], ["x"]).count() == 0

"""Benchmark decontamination by a prefix-filtered join, in DataFrame functions only.

An item's windows are its runs of `size` consecutive words (a shorter item is one window). A document
that holds a window holds each of the window's two-word shingles, so only one is necessary: shingles
are ordered by rarity, counted over all documents, and the rarest of each window is its prefix.
Documents' shingles meet prefixes in a hash join; the shingle's place in the window then gives the
only start that the window can have, the bounds of the text are checked and the words are compared.
A window whose rarest shingle occurs in no document is dropped before the join.

The windows side is broadcast only while its measured size is below `broadcast_bytes`; beyond that the
join shuffles shingles with the words around them, never whole texts.

Words are runs of 0-9, a-z (after A-Z are lowered) and all characters beyond ASCII. Null and empty
texts have no words. Items without words match nothing; items whose id is null count as one item with
an empty id, items of equal id as one. Rows that repeat a document are judged alike.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbusops.session import Staging

#: All that is not a word.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
BROADCAST_BYTES = 32 << 20


def words(text: str) -> Column:
    """Lower-case words of a text column; the quick lowering is used where it cannot touch other letters."""
    plain = F.length(text) == F.octet_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(low, BETWEEN), ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """item, win (words) and win_text, distinct."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.slice("w", i, size))
    return items.where(F.size("w") > 0).select("item", F.explode(cut).alias("win")).withColumn(
        "win_text", F.array_join("win", " ")).distinct()


def _shingles(docs: DataFrame, size: int, single: bool) -> DataFrame:
    """A row per word: place p, the hash of the word and the next one, and the words around them.

    The outer generator keeps the optimizer from copying the split into a filter; empty texts give one
    row without a shingle, which no join matches. `single` adds the hash of the word alone."""
    spread = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words("text").alias("w")).select(
        "doc_id", "text_hash", "w", F.posexplode_outer("w").alias("p", "word"))
    first = F.greatest(F.col("p") - (size - 1), F.lit(0))
    rows = spread.select(
        "doc_id", "text_hash", "p", F.xxhash64("word", F.expr("get(w, p + 1)")).alias("shingle"), first.alias("first"),
        F.size("w").alias("n"), F.slice("w", first + 1, 2 * size).alias("around"), "word").where("p is not null")
    if not single:
        return rows.drop("word")
    both = F.explode(F.array("shingle", F.xxhash64(F.col("word"), F.lit(None).cast("string"))))
    return rows.select("doc_id", "text_hash", "p", both.alias("shingle"), "first", "n", "around")


def occurrences(docs: DataFrame, benchmark: DataFrame, staging: Staging, size: int = SIZE,
                broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, text_hash, start, length, win_text) of all windows, and the windows."""
    table = staging.write("windows", windows(benchmark, size))
    known = table.select("win", "win_text").distinct()
    stats = known.agg(F.coalesce(F.sum(3 * F.octet_length("win_text") + 200), F.lit(0)).alias("bytes"),
                      F.coalesce(F.bool_or(F.size("win") == 1), F.lit(False)).alias("single")).first()
    small = (lambda df: F.broadcast(df)) if stats["bytes"] <= broadcast_bytes else (lambda df: df)
    places = F.sequence(F.lit(0), F.greatest(F.size("win") - 2, F.lit(0)))
    inside = known.select("win", "win_text", F.explode(places).alias("place")).withColumn(
        "shingle", F.expr("xxhash64(win[place], get(win, place + 1))"))
    rows = _shingles(docs, size, stats["single"])
    counts = rows.select("shingle").join(small(inside.select("shingle").distinct()), "shingle").groupBy("shingle").agg(
        F.count("*").alias("n_docs"))
    rarity = staging.write("rarity", counts)
    # Inner: a window with a shingle that no document holds cannot occur. Its other shingles must not stand in.
    ranked = inside.join(rarity, "shingle", "left").groupBy("win_text").agg(
        F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "shingle", "place", "win")).alias("rarest"))
    prefixes = staging.write("prefixes", ranked.where("rarest.n_docs > 0").select(
        "win_text", "rarest.shingle", "rarest.place", "rarest.win"))
    start = F.col("p") - F.col("place")
    fits = (start >= 0) & (start + F.size("win") <= F.col("n"))
    equal = F.slice("around", F.greatest(start - F.col("first") + 1, F.lit(1)), F.size("win")) == F.col("win")
    found = rows.join(small(prefixes), "shingle").where(fits & equal).select(
        "doc_id", "text_hash", start.alias("start"), F.size("win").alias("length"), "win_text")
    return staging.write("found", found), table


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_words, n_hit (words inside any window's occurrence), n_items and
    items (sorted ids of the items with occurring windows)."""
    staging = Staging(docs.sparkSession)
    found, table = occurrences(docs, benchmark, staging, size, broadcast_bytes)
    spans = found.groupBy("doc_id", "text_hash", "start").agg(F.max("length").alias("length"))
    before = F.expr("max(start + length) OVER (PARTITION BY doc_id, text_hash ORDER BY start "
                    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    fresh = F.col("start") + F.col("length") - F.greatest("start", F.coalesce("before", F.col("start")))
    hits = spans.withColumn("before", before).groupBy("doc_id", "text_hash").agg(
        F.sum(F.greatest(fresh, F.lit(0))).alias("n_hit"))
    items = found.select("doc_id", "text_hash", "win_text").distinct().join(table.select("item", "win_text"), "win_text").groupBy(
        "doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    marks = hits.alias("h").join(items.alias("i"), F.expr("h.doc_id <=> i.doc_id AND h.text_hash = i.text_hash")).selectExpr(
        "h.doc_id AS of_doc", "h.text_hash AS of_text", "n_hit", "items")
    marks = staging.write("marks", marks)
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words("text")).cast("long").alias("n_words"))
    joined = own.join(marks, F.expr("doc_id <=> of_doc AND text_hash = of_text"), "left")
    return joined.select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs that hold no window of any item."""
    staging = Staging(docs.sparkSession)
    found, _ = occurrences(docs, benchmark, staging, size)
    leaks = staging.write("leaks", found.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")).distinct())
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.xxhash64("text") == F.col("of_text")), "left_anti")

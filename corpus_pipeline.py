"""A corpus run over the documents table: stages that each take what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it to the shared folder
and reads it again for the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nimbusops.llm import decontamination, langid, sentencepieces, simhash, suffixes
from nimbusops.llm.queries import PIECE_MODEL, crc_class
from nimbusops.session import Staging, prepare

#: Texts below this share of known n-grams are in none of the learned languages. Texts of a learned
#: language score above 0.5, also with much junk between.
LEAST_LANGUAGE_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out texts without a letter or of no learned language."""
    return langid.known_language(docs, langid.train(docs, crc_class() != 0), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash group."""
    return simhash.representatives(docs, size=3, radius=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that start earlier in the corpus out of the texts."""
    return suffixes.without_repeats(docs, length=100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a window of a benchmark item."""
    return decontamination.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them."""
    return sentencepieces.digests(sentencepieces.encode_decode(docs, public_tokenizers.path(PIECE_MODEL)))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("benchmark_leaks", benchmark_leaks), ("encode", encode)]

#: The language stage learns a model, which SQL does not express; tests hold the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = Staging(prepare(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staging.write(name, stage(spark, docs, sf_dir))
    return docs

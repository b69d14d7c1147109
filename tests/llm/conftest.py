import pytest
from pyspark.sql import types as t

DOC = t.StructType([t.StructField("doc_id", t.LongType()), t.StructField("text", t.StringType()), t.StructField("lang", t.StringType()),
                    t.StructField("source", t.StringType()), t.StructField("n_chars", t.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def with_clashes(spark):
    """The same rows with extra columns whose names the operators use themselves."""

    def add(df):
        from pyspark.sql import functions as F

        names = ("key", "tag", "g", "fp", "ids", "score", "held_out", "text_hash", "marks", "row", "component_id", "words")
        return df.withColumns({c: F.lit("x") for c in names if c not in df.columns})

    return add

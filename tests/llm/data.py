"""Test tables."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def docs(spark, texts, first=1):
    """A documents table of the given texts, with an extra column that clashes with results' names."""
    rows = [(first + i, t, "en", "s", None if t is None else len(t), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")

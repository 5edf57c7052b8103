"""The corpus pipeline: five stages, each of which is an operator of `loamdex.llm` applied to whole tables.

    quality     documents that the rule ensemble rejects go
    near_dedup  one document of each group of near-duplicates stays
    substrings  byte strings that repeat earlier ones go from the texts
    mixture     sources are read to temperature weights; none is left out, small ones are read up to `MIX_EPOCHS` times
    tokens      texts are encoded and decoded; digests are returned

Every stage but the last returns the columns of `documents`, and each works on what the one before it kept.

Defined results: a null text is scored, compared, cut and encoded as the empty one (and is empty after `substrings`); an
empty text is near to nothing, so it stays if the classifier keeps it, until `mixture`, where a source without words has no
rows; rows that share a doc_id are one document, so all of them stay or go together, and a null doc_id is a document like
any other, larger than all; of a group with equal texts the least doc_id stays; extra columns, clashing names included,
are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.llm import bpe, chosen_path, mixing, rule_ensemble, suffix_dedup
from loamdex.llm.queries import vocabulary
from loamdex.session import materialize, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIX_EPOCHS = 2.0


def _with(docs: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on doc_id, null ids included."""
    return docs.join(found.withColumnRenamed("doc_id", "found_id"), F.col("doc_id").eqNullSafe(F.col("found_id")), how).drop("found_id")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = rule_ensemble.classify(docs, read_table(spark, sf_dir, "labels"))
    return _with(docs, scores.filter("predicted = 1").select("doc_id").distinct(), "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = chosen_path.group(docs).filter("kept").select("doc_id").distinct()
    return _with(docs, kept, "left_semi").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document of which nothing is left stays as an empty text; n_chars is counted again."""
    kept = suffix_dedup.kept_texts(docs, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs, budget="cover", max_epochs=MIX_EPOCHS).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, vocabulary())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substrings", substrings), ("mixture", mixture), ("tokens", tokens)]

#: The classifier, the similarity join and the merges have no form in SQL; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each one's result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

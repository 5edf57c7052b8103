"""The queries of this subpackage, one for each operator, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamdex.llm import bpe, chosen_path, divergence, html_text, line_runs, mixing, multi_index, phrase_dedup, quality_rules, rule_ensemble, suffix_dedup, toxicity, voronoi_join
from loamdex.session import read_table


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(read_table(spark, sf_dir, "embeddings"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def vocabulary() -> str:
    """The vocabulary file that the queries use, from the installed package of public tokenizers."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op4_phrase_automata_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.digests(read_table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read_table(spark, sf_dir, "documents"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), vocabulary())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.group(read_table(spark, sf_dir, "documents"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_texts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_join.mine(read_table(spark, sf_dir, "embeddings"))


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digests(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_multi_index": op1_multi_index,
        "op2_source_mixing": op2_source_mixing,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_phrase_automata_dedup": op4_phrase_automata_dedup,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_bpe_codec": op6_bpe_codec,
        "op7_quality_rules": op7_quality_rules,
        "op8_chosen_path_dedup": op8_chosen_path_dedup,
        "op9_html_main_text": op9_html_main_text,
        "op10_toxicity": op10_toxicity,
        "op11_source_divergence": op11_source_divergence,
        "op12_voronoi_negatives": op12_voronoi_negatives,
        "op13_line_runs": op13_line_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mixing": mixing.oracle(),
        "op4_phrase_automata_dedup": phrase_dedup.oracle(),
        "op7_quality_rules": quality_rules.oracle(),
        "op11_source_divergence": divergence.oracle(),
        "op12_voronoi_negatives": voronoi_join.oracle(),
        "op13_line_runs": line_runs.oracle(),
    }

"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import oracles
from plumbline.llm.decontamination import contamination
from plumbline.llm.impacts import ranked_search
from plumbline.llm.main_text import extract_main_text
from plumbline.llm.lines import line_digest
from plumbline.llm.merkle import merkle_manifest
from plumbline.llm.mixing import mix
from plumbline.llm.partitions import nearest
from plumbline.llm.secret_scan import secret_digest
from plumbline.llm.simhash import near_duplicates
from plumbline.llm.substrings import repeats_query
from plumbline.llm.suffix_tree import language_scores
from plumbline.llm.toxicity import toxicity
from plumbline.llm.topk import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights; null and empty texts take nothing."""
    return mix(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text; null texts have none."""
    return secret_digest(_table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents: lines before and removed, and the digest of what stays; null texts have no lines."""
    return line_digest(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, learned from the labels outside the held-out fold; empty texts score too."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words have fingerprint zero."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every twentieth vector, exactly; null and non-finite vectors take no part."""
    return top_k(_table(spark, sf_dir, "embeddings"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model and unigram scores of every document; a null text is one end."""
    return language_scores(_table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null html has none."""
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that repeat an earlier document, over all documents; null and empty texts have none."""
    return repeats_query(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document; null texts have no words."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the 20 nearest candidates of every twentieth vector; null, zero and non-finite vectors take no part."""
    return nearest(_table(spark, sf_dir, "embeddings"))


def op12_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item by the impacts of its terms; null texts have none."""
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle proof of every document, checked on a copy in which some texts are changed; null ids stay as they are."""
    return merkle_manifest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_secrets": op2_secrets,
    "op3_lines": op3_lines,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_topk": op6_topk,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_html": op8_html,
    "op9_substrings": op9_substrings,
    "op10_decontamination": op10_decontamination,
    "op11_partitions": op11_partitions,
    "op12_impacts": op12_impacts,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op1_mixing": oracles.MIXING,
    "op3_lines": oracles.LINES,
    "op6_topk": oracles.TOP_K,
    "op10_decontamination": oracles.DECONTAMINATION,
    "op12_impacts": oracles.IMPACTS,
    "op13_merkle": oracles.MERKLE,
}

"""Corpus pipeline: STAGES applied to ``documents``, each written as Parquet and reread as the next one's input.

The filtering stages return the columns of ``documents`` (``n_chars`` follows the edited text); the last one
adds token ids and the text decoded from them. Rows without words stay until the quality rules reject
them; an empty table gives empty results at every stage. A stage releases the tables that the stage before it staged, as that
one's result has been written by then; a folder that its input still reads is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latecomer.llm import bpe, decontaminate, lines, quality, simhash
from latecomer.llm.common import scope, staged, table


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    with scope(spark, docs):
        return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match earlier ones go."""
    with scope(spark, docs):
        return _counted(lines.remove_later_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    with scope(spark, docs):
        return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go, and documents that mostly consist of them."""
    with scope(spark, docs):
        return _counted(decontaminate.remove(docs, table(spark, sf_dir, "benchmark")))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the text decoded from them."""
    with scope(spark, docs):
        coded = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), bpe.word_tokenizer())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_tokens", bpe_tokens),
]

#: SimHash and the tokenizer can't be expressed in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

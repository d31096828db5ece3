"""The corpus pipeline: five of the training-data operators, one a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratal.llm import decontam, langid, ngram_join, rlz, spviterbi
from stratal.llm.queries import find_package, table, tokenizer_path
from stratal.llm.scratch import discard, materialize, temporary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fit no language profile go, and with them null and empty ones and those without a letter; the profiles
    are those of the documents' own languages, null ones left out."""
    find_package(spark)
    return langid.keep(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id stays. Rows without words or without a doc_id stay;
    rows that share a doc_id are told apart by their texts."""
    find_package(spark)
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more that an earlier document has are cut out; a document of which nothing is left
    goes. Rows without a doc_id have no place in the order and stay as they are."""
    find_package(spark)
    return rlz.rewrite(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; items without an id or a text are left out, and no item means no leak."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document left, one without a doc_id too."""
    find_package(spark)
    return spviterbi.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("encoding", encoding),
]

#: Profiles, fingerprints and Viterbi scores are beyond SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's own tables, and the table it read, go as soon as its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with temporary(spark) as kept:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs)
        discard(before)
        before = docs
    return docs

"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.common import materialize
from quadrille.llm.exact_dedup import exact_dedup
from quadrille.llm.ngram_join import drop_near_duplicates
from quadrille.llm.packing import packed_documents
from quadrille.llm.quality import quality_filter
from quadrille.llm.queries import tokenizer_file
from quadrille.llm.suffix_dedup import drop_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("best_fit_packing", packing),
]

#: The robust estimates, the groups of similar texts and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole table ``documents``; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs

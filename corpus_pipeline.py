"""Corpus pipeline: quality classifier, line dedup, near-dedup, mixing, tokenising.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and reread as the next stage's ``docs``.  All but the last return the columns
of ``documents``.

Defined results for odd input: every stage takes nulls in any column, empty and very long
texts, empty tables and columns of any name, which pass through; of rows that repeat a
document near-dedup keeps one, and rows without a doc_id or text stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkfolio.llm import bpe, dart_minhash, line_dedup, mixing, quality_gbt
from sparkfolio.llm.common import stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_gbt.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and runs of lines go; so does a document of which nothing is left."""
    return line_dedup.line_dedup(docs, drop_emptied=True, runs=True).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return dart_minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document appears as often as it was drawn."""
    return mixing.emit_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document of the mixture, as digests."""
    return bpe.bpe_digests(docs, bpe.default_path())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("bpe", tokens),
]

#: The classifier and the tokenizer have no SQL form.  Tests hold line dedup, near-dedup (also on what line
#: dedup leaves) and the trees against brute force, tokens against the library, the mixture against its SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The composed path: pages -> chunks -> exact and near duplicates -> both indexes -> retrieval in four modes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import retrieval as R
from .chunking import ChunkSettings, chunk_documents, hashed_vectors
from .dedup import drop_exact, newest_first
from .models import embed, embed_queries
from .order import positions
from .pages import page_streams
from .survivors import near_survivors
from .upkeep import IndexStore, Version

NEAR = 0.95


@dataclass(frozen=True)
class Corpus:
    """``chunks``: chunk_id, doc_id, title, year, page_start, page_end, content, pos (newest first), duplicate_ids."""

    chunks: DataFrame
    store: IndexStore
    version: Version
    model: Callable[[list[str]], np.ndarray]


def build(pages: DataFrame, folder: str, settings: ChunkSettings = ChunkSettings(), near: float = NEAR, model: Callable[[list[str]], np.ndarray] = hashed_vectors) -> Corpus:
    """Chunk, embed once, drop duplicates, and bring the indexes in ``folder`` up to date.

    ``pages``: doc_id, title, year, page_number, content.  Of equal or similar chunks the newest stays and
    takes the others' ids.  Every table is written to ``folder`` before the next step reads it; a
    folder that holds an older corpus keeps its index's segments, and only changed documents are indexed anew.
    """
    spark = pages.sparkSession
    run = f"{folder}/build-{IndexStore(spark, f'{folder}/index').next_number():010d}"

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{run}/{name}")
        return spark.read.parquet(f"{run}/{name}")

    of_document = pages.groupBy("doc_id").agg(F.max("year").alias("year"), F.min("title").alias("title"))
    made = chunk_documents(page_streams(pages), settings).select("chunk_id", "doc_id", "page_start", "page_end", "content")
    chunks = kept(made.join(of_document, "doc_id"), "made")
    single = kept(positions(chunks.join(drop_exact(chunks), "chunk_id"), *newest_first()), "single")
    vectors = kept(embed(single.select("chunk_id", "pos", "content"), "content", model=model).select("chunk_id", "pos", "vector"), "vectors")
    settled = kept(near_survivors(vectors.select(F.col("pos").alias("node"), F.col("vector").alias("v")), near, F.col("node")), "settled")
    # A dropped chunk gives its own id and those of its copies to the one that absorbed it.
    given = settled.where("NOT kept").join(single.select(F.col("pos").alias("node"), "chunk_id", "duplicate_ids"), "node")
    given = given.groupBy(F.col("absorber").alias("pos")).agg(F.array_sort(F.flatten(F.collect_list(F.concat(F.array("chunk_id"), "duplicate_ids")))).alias("_more"))
    final = single.join(settled.where("kept").select(F.col("node").alias("pos")), "pos", "left_semi").join(given, "pos", "left")
    ids = F.concat("duplicate_ids", F.coalesce("_more", F.array().cast("array<string>")))
    final = kept(final.select("chunk_id", "doc_id", "title", "year", "page_start", "page_end", "content", "pos", ids.alias("duplicate_ids")), "chunks")
    store = IndexStore(spark, f"{folder}/index", model=model)
    return Corpus(final, store, store.update(final, vectors=vectors.select("chunk_id", "vector")), model)


def hits(questions: DataFrame, corpus: Corpus, s: R.RetrievalSettings = R.RetrievalSettings()) -> tuple[DataFrame, DataFrame]:
    """Ranked dense and lexical hits of all questions (query_id, question); the mode doesn't matter to them."""
    place = corpus.chunks.select("chunk_id", "pos")
    items = corpus.store.vectors(corpus.version).join(place, "chunk_id").select(F.col("pos").alias("item_id"), F.col("vector").cast("array<double>").alias("v"))
    asked = embed_queries(questions, "question", model=corpus.model).select("query_id", F.col("vector").cast("array<double>").alias("q"))
    dense = R.vector_search(asked, items, s.dense_k, same=False).join(place, F.col("item_id") == F.col("pos")).select("query_id", "chunk_id", "score", "rank")
    found = R.bm25(questions, corpus.store.lexical(corpus.version), s.sparse_k).join(place, "chunk_id")
    return dense, R.ranked(found, s.sparse_k, F.col("pos"))


def ask(questions: DataFrame, corpus: Corpus, s: R.RetrievalSettings = R.RetrievalSettings()) -> DataFrame:
    """Ranked passages of all questions (query_id, question) in the mode of the settings."""
    return R.retrieve(questions, corpus.chunks, *hits(questions, corpus, s), s)

"""Page records: filters, reports, page streams and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions import text as T

SPARSE_PAGE_CHARS, SCANNED_MEAN_CHARS, SPARSE_SHARE = 100, 50, 0.4


def is_sparse() -> Column:
    return F.length(T.strip(F.col("content"))) < SPARSE_PAGE_CHARS


def dense_pages(pages: DataFrame) -> DataFrame:
    return pages.where(~is_sparse())


def scanned_documents(pages: DataFrame, limit: int = SCANNED_MEAN_CHARS) -> DataFrame:
    """Documents with too little text per page to be anything but scans."""
    chars = F.sum(F.length(T.strip(F.col("content"))))
    return pages.groupBy("doc_id").agg((chars / F.greatest(F.count("*"), F.lit(1))).alias("mean_chars")).where(F.col("mean_chars") < limit)


def without_scans(pages: DataFrame) -> DataFrame:
    return pages.join(scanned_documents(pages).select("doc_id"), "doc_id", "left_anti")


def page_streams(pages: DataFrame) -> DataFrame:
    """Adds ``stream``: runs of consecutive page numbers of a document, numbered from 0."""
    w = Window.partitionBy("doc_id").orderBy("page_number")
    gap = F.col("page_number") != F.lag("page_number").over(w) + 1
    return pages.withColumn("stream", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def stream_offsets(streams: DataFrame) -> DataFrame:
    """Adds ``start`` and ``end``: a page's place in its stream joined by blank lines."""
    w = Window.partitionBy("doc_id", "stream").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content") + 2).over(w), F.lit(0))
    return streams.select("*", start.alias("start"), (start + F.length("content")).alias("end"))


def document_report(pages: DataFrame) -> DataFrame:
    """One row per document with counts of pages by kind of defect, characters, and the verdict."""
    sparse = is_sparse()
    return (
        pages.groupBy("doc_id")
        .agg(
            F.count("*").alias("n_pages"),
            F.sum(F.length(T.strip(F.col("content")))).alias("n_chars"),
            F.count_if(sparse).alias("n_sparse"),
            F.count_if(F.col("content").contains("|")).alias("n_tables"),
            F.count_if(sparse & ~F.col("content").contains("|")).alias("n_image_only"),
            F.count_if(~sparse).alias("n_indexed"),
            F.max("year").alias("year"),
        )
        .select(
            "*",
            F.when(F.col("n_chars") / F.col("n_pages") < SCANNED_MEAN_CHARS, "scanned")
            .when(F.col("n_sparse") / F.col("n_pages") > SPARSE_SHARE, "partial")
            .otherwise("OK")
            .alias("verdict"),
        )
    )


def locate(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """The page that holds each position of a stream; positions beyond the end belong to the last page.

    Points and page starts are merged into one ordered stream, and the last start seen
    is carried forward: a range join without comparing pairs.
    """
    events = (
        offsets.select("doc_id", "stream", F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("page_number").alias("page"), F.lit(None).cast("long").alias("point"))
        .unionByName(points.select("doc_id", "stream", F.col("position").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("page"), F.col("point").cast("long").alias("point")))
    )
    w = Window.partitionBy("doc_id", "stream").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("*", F.last("page", ignorenulls=True).over(w).alias("found")).where("kind = 1").select("doc_id", "stream", "point", F.col("at").alias("position"), F.col("found").alias("page_number"))

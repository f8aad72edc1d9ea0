"""Positions in a total order, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.sources.files import scratch


def positions(rows: DataFrame, *order: Column, name: str = "pos", start: int = 1) -> DataFrame:
    """Adds each row's place in the order, as a long that counts from ``start``.

    Rows are sorted into ranges, written to the shared folder and numbered within their range;
    the sizes of the ranges, one short row each, are added up by a window of their own.
    Rows that tie in ``order`` are numbered in any order, once and for all.
    """
    spark = rows.sparkSession
    path = scratch(spark, "ordered")
    rows.sort(*order).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_nth")).write.parquet(path)
    # Ids of a range count up from a number of its own: the difference to the least is the place within it.
    stored = spark.read.parquet(path)
    sizes = stored.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_nth").alias("_least"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", "_least", before.alias("_before"))
    place = F.col("_nth") - F.col("_least") + F.col("_before") + F.lit(start)
    return stored.join(offsets, "_range").select(*rows.columns, place.cast("long").alias(name))

"""Offline evaluation: hits against gold pages, ablations, floor calibration, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.numbers import half_away


def first_gold_rank(results: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, first: the least rank whose passage overlaps a gold page span of the same document; null if none does."""
    r = results.select("query_id", "doc_id", "page_start", "page_end", "rank")
    g = gold.select("query_id", F.col("doc_id").alias("_d"), F.col("page_start").alias("_s"), F.col("page_end").alias("_e")).distinct()
    hit = r.join(g.withColumnRenamed("query_id", "_q"), (F.col("query_id") == F.col("_q")) & (F.col("doc_id") == F.col("_d")) & (F.col("page_start") <= F.col("_e")) & (F.col("page_end") >= F.col("_s")))
    best = hit.groupBy("query_id").agg(F.min("rank").alias("first"))
    return gold.select("query_id").distinct().join(best, "query_id", "left")


def hit_rate(first: Column, k: int) -> Column:
    return F.coalesce(F.avg(F.when(first <= k, 1.0).otherwise(0.0)), F.lit(0.0))


def mean_reciprocal_rank(first: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(1 / first, F.lit(0.0))), F.lit(0.0))


def calibrate_floor(scores: DataFrame) -> DataFrame:
    """The threshold with the fewest wrong answers, then the fewest wrong refusals; the lowest of equals.

    ``scores``: answerable, best.  Candidates are 0, the midpoints of neighbouring
    different scores, and just above the largest.  Costs come from running counts over
    the sorted scores, so candidates never meet every score.
    """
    rounded = scores.select("answerable", half_away(F.col("best"), 4).alias("s"))
    per = rounded.groupBy("s").agg(F.count_if("answerable").alias("a"), F.count_if(~F.col("answerable")).alias("u"))
    up = Window.orderBy("s")
    following = F.lead("s").over(up)
    # The midpoint of scores that are one unit apart can be rounded down to the lower one, which then passes.
    placed = per.select(
        "s", "a", "u", F.coalesce(half_away((F.col("s") + following) / 2, 4), F.col("s") + 0.01).alias("threshold"),
        F.coalesce(F.sum("u").over(up.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("above"), F.sum("a").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("below"),
    )
    passes = F.col("s") >= F.col("threshold")
    between = placed.select("threshold", (F.col("above") + F.when(passes, F.col("u")).otherwise(0)).alias("wrong_answers"), (F.col("below") - F.when(passes, F.col("a")).otherwise(0)).alias("wrong_refusals"))
    zero = rounded.agg(F.lit(0.0).alias("threshold"), F.count_if(~F.col("answerable") & (F.col("s") >= 0)).alias("wrong_answers"), F.count_if(F.col("answerable") & (F.col("s") < 0)).alias("wrong_refusals"))
    best = F.min(F.struct("wrong_answers", "wrong_refusals", "threshold")).alias("b")
    return between.unionByName(zero).agg(best).select("b.threshold", "b.wrong_answers", "b.wrong_refusals")

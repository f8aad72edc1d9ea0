"""Mix sources to target weights by systematic sampling.

Each source gets a target number of words.  Within a source every document has the
same expected number of copies, ``target / source size``.  Expected copies are
prefix-summed along a fixed order, one random offset per source is added, and a
document is emitted once for every integer boundary that its interval crosses.
The order sorts by size class first, so the sample is stratified by size and the
taken words stay close to the target.

The prefix sum is two-level: a histogram over (source, size class, hash digits) is
pre-aggregated and prefix-summed per source; exact ranks are only computed inside
one histogram cell.  A source that holds a third of all rows is thereby spread over
as many tasks as it has cells, and no task sees a whole source.  Cells per source
are bounded by ``16 ** digits`` times the square root of the largest size; ``digits``
follows the number of documents, so a cell stays small.

Defined results for odd input: a null text has size 0; a null source is a source of
its own, sorted last; repeated rows are documents of their own; if all sizes are 0
every target is 0 and nothing is taken; long texts are counted whole; columns of the
input may have any names (the mixture has them all; of the counts, those named like a
result column give way); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(key, source, source_size) -> adds ``target``: shares of the total by weight, capped and reshared.

    Resharing until no source is above ``max_copies`` times its size has one fixed
    point: sources are capped in rising order of cap per weight, as long as that
    ratio is below what the rest would get.  Cumulative sums find it in one pass
    over the source table (one row per source).
    """
    ranked = sizes.select(
        "*", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("_i")
    ).select(
        "*",
        F.element_at(F.array(*map(F.lit, weights)), F.col("_i") % len(weights) + 1).cast("long").alias("_w"),
        (F.col("source_size") * max_copies).alias("_cap"),
    )
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = ranked.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).alias("_words"),
        (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))).alias("_weights"),
    ).withColumn("_capped", F.col("_cap") / F.col("_w") < F.col("_words") / F.col("_weights"))
    # The first source that is not capped knows what is left for all that are not.
    first = F.min(F.when(~F.col("_capped"), F.struct((-F.col("_weights")).alias("_o"), "_words", "_weights"))).over(every)
    return rest.select(
        "key",
        "source_size",
        F.when(F.col("_capped"), F.col("_cap").cast("double"))
        .otherwise(first["_words"] * F.col("_w") / first["_weights"])
        .alias("target"),
    )


def _uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 8 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


#: Rows of one cell that are ranked in one task: about so many, whatever the number of documents.
CELL_ROWS = 100_000


def _digits_for(n: int) -> int:
    """Hash digits that keep a cell of a source with all ``n`` documents, spread over ten size classes, near CELL_ROWS."""
    digits = 1
    while digits < 8 and n > 10 * CELL_ROWS * 16**digits:
        digits += 1
    return digits


def _drawn(docs: DataFrame, carry, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix", digits: int | None = None) -> DataFrame:
    """``_row`` (the columns in ``carry``), size, source_size, target and copies of every document.

    ``digits`` only says how many cells there are; the order, and so the sample, is the same with any.
    """
    digits = digits or _digits_for(docs.count())
    order_key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    base = docs.select(
        F.struct(*carry).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("_sk"),
        order_key.alias("_k"),
        F.xxhash64("text").alias("_tie"),
    ).select("*", F.floor(F.sqrt("size")).cast("long").alias("_class"), F.substring("_k", 1, digits).alias("_sub"))
    # Read twice, so written once: one row for each cell.
    cells = stash(
        base.groupBy("_sk", "_class", "_sub").agg(F.count("*").alias("_n"), F.sum("size").alias("_words"), F.min("_source").alias("source")), "cells"
    )
    sizes = cells.groupBy(F.col("_sk").alias("key")).agg(F.min("source").alias("source"), F.sum("_words").alias("source_size"))
    along = Window.partitionBy("_sk").orderBy("_class", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(
        F.col("_sk").alias("_csk"),
        F.col("_class").alias("_cclass"),
        F.col("_sub").alias("_csub"),
        F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"),
    ).join(source_targets(sizes, weights, max_copies), F.col("_csk") == F.col("key"))
    within = Window.partitionBy("_sk", "_class", "_sub").orderBy("_k", "_id", "_tie")
    ranked = base.select("*", F.row_number().over(within).alias("_rank"))
    placed = ranked.join(
        starts.hint("merge"),
        (F.col("_sk") == F.col("_csk")) & (F.col("_class") == F.col("_cclass")) & (F.col("_sub") == F.col("_csub")),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _uniform(F.concat(F.lit(f"{seed}:"), "_sk"))
    upto = F.col("_before") + F.col("_rank")
    copies = F.floor(offset + upto * rate) - F.floor(offset + (upto - 1) * rate)
    return placed.select("_row", "size", "source_size", "target", F.least(copies, F.lit(max_copies)).cast("long").alias("copies"))


def mix_sources(docs: DataFrame, carry=(), **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, and the columns in ``carry``.

    A column in ``carry`` that is named like one of the others is left out.
    """
    own = ("size", "source_size", "target", "copies", "taken")
    columns = ["doc_id", "source", *[c for c in carry if c not in ("doc_id", "source", *own)]]
    return _drawn(docs, columns, **options).select("_row.*", *own[:4], (F.col("copies") * F.col("size")).alias("taken"))


def emit_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document repeated as often as it was drawn, with the columns of ``docs``."""
    drawn = _drawn(docs, docs.columns, **options).where("copies > 0")
    return drawn.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).select("_row.*")


def op7_mix_sources(spark, sf_dir):
    """The registered query: all of ``documents``, weights 5, 2, 1 repeating."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents
),
s0 AS (SELECT source, sum(size)::BIGINT AS sz FROM d GROUP BY source),
s1 AS (SELECT source, sz, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i, 3 * sz AS cap FROM s0),
s2 AS (SELECT *, [5, 2, 1][(i % 3 + 1)::INT] AS w FROM s1),
s3 AS (SELECT *, (sum(sz) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS words,
              (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS weights FROM s2),
s4 AS (SELECT *, cap / w < words / weights AS capped FROM s3),
s5 AS (SELECT source, sz, CASE WHEN capped THEN cap::DOUBLE ELSE
        first_value(words) OVER (ORDER BY capped, weights DESC) * w / first_value(weights) OVER (ORDER BY capped, weights DESC) END AS target FROM s4),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(size)), k, doc_id) AS n FROM d),
x AS (SELECT r.doc_id, r.size, s5.sz AS source_size, s5.target, n, s5.target / s5.sz AS rate,
        ('0x' || substr(md5('mix:' || coalesce('s' || r.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM r JOIN s5 ON r.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target,
       ((floor(u + n * rate) - floor(u + (n - 1) * rate)) * size)::BIGINT AS taken
FROM x
"""

"""Rectangles against rectangles: a join on grid cells, shares of area, prose outside tables.

A rectangle has the columns x0, y0, x1, y1.  Both sides are dealt to the grid cells they
touch, so the join is an equality on page and cell: no rectangle meets one that is not near,
and a page with very many is spread over its cells.  Two that share several cells meet once: in
the cell that holds the lower corner of their intersection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Side of a grid cell.
CELL = 32.0
#: Text whose block lies in a table by more than this share is left to the table.
TABLE_OVERLAP = 0.6

_BOX = ("x0", "y0", "x1", "y1")


def _dealt(boxes: DataFrame, size: float) -> DataFrame:
    """One row for each cell that a rectangle with an area touches."""
    at = lambda c: F.floor(F.col(c) / size)
    full = boxes.where("x1 > x0 AND y1 > y0")
    return full.withColumn("_gx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_gy", F.explode(F.sequence(at("y0"), at("y1"))))


def intersections(left: DataFrame, right: DataFrame, on: list[str], size: float = CELL) -> DataFrame:
    """The columns of ``left`` and ix0, iy0, ix1, iy1 for every rectangle of ``right`` that overlaps it on the same page.

    Rectangles that only touch, and those without an area, don't overlap.
    """
    other = _dealt(right.select(*on, *[F.col(c).alias(f"t{c}") for c in _BOX]).select(*on, *[F.col(f"t{c}").alias(c) for c in _BOX]), size)
    other = other.select(*on, "_gx", "_gy", *[F.col(c).alias(f"_{c}") for c in _BOX])
    both = _dealt(left, size).join(other, [*on, "_gx", "_gy"])
    low, high = (lambda c: F.greatest(c, f"_{c}")), (lambda c: F.least(c, f"_{c}"))
    clipped = both.select("*", low("x0").alias("ix0"), low("y0").alias("iy0"), high("x1").alias("ix1"), high("y1").alias("iy1"))
    once = (F.floor(F.col("ix0") / size) == F.col("_gx")) & (F.floor(F.col("iy0") / size) == F.col("_gy"))
    return clipped.where(once & (F.col("ix0") < F.col("ix1")) & (F.col("iy0") < F.col("iy1"))).select(*left.columns, "ix0", "iy0", "ix1", "iy1")


def union_area(parts: DataFrame, key: list[str]) -> DataFrame:
    """key, area: of the union of the rectangles ix0, iy0, ix1, iy1 of every key.

    The edges cut the plane into slabs; in each slab the intervals are merged by a running maximum.
    """
    edges = parts.select(*key, F.explode(F.array("ix0", "ix1")).alias("_a")).distinct()
    slabs = edges.select(*key, "_a", F.lead("_a").over(Window.partitionBy(*key).orderBy("_a")).alias("_b")).where("_b IS NOT NULL")
    inside = parts.join(slabs, key).where("ix0 <= _a AND ix1 >= _b")
    before = Window.partitionBy(*key, "_a").orderBy("iy0", "iy1").rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.max("iy1").over(before), F.col("iy0"))
    height = F.greatest(F.lit(0.0), F.col("iy1") - F.greatest(F.col("iy0"), top))
    return inside.select(*key, ((F.col("_b") - F.col("_a")) * height).alias("_part")).groupBy(*key).agg(F.sum("_part").alias("area"))


def coverage(blocks: DataFrame, tables: DataFrame, on: list[str], key: list[str], size: float = CELL) -> DataFrame:
    """key, n_tables, largest (share of the block in one table), together (share in the union of all), for every block."""
    parts = intersections(blocks, tables, on, size)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    one = (F.col("ix1") - F.col("ix0")) * (F.col("iy1") - F.col("iy0")) / area
    per = parts.groupBy(*key).agg(F.count("*").alias("n_tables"), F.max(one).alias("largest"))
    whole = blocks.select(*key, area.alias("_area")).join(per, key, "left").join(union_area(parts, key), key, "left")
    share = lambda c: F.coalesce(c, F.lit(0.0))
    return whole.select(*key, F.coalesce("n_tables", F.lit(0)).alias("n_tables"), share(F.col("largest")).alias("largest"), share(F.col("area") / F.col("_area")).alias("together"))


def prose_outside(blocks: DataFrame, tables: DataFrame, on: list[str], key: list[str], most: float = TABLE_OVERLAP, size: float = CELL) -> DataFrame:
    """The blocks that no table covers by more than ``most``: the same figures aren't indexed as table and as text."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    inside = intersections(blocks, tables, on, size).where((F.col("ix1") - F.col("ix0")) * (F.col("iy1") - F.col("iy0")) / area > most)
    return blocks.join(inside.select(*key).distinct(), key, "left_anti")

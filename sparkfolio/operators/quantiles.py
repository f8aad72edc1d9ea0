"""Exact order statistics by histograms: no row is sorted or collected.

For each group and wanted position an interval of values is known that holds it.  A pass counts
the rows of the interval in ``buckets`` equal parts and keeps the part that holds the position;
its own least and greatest value are the next interval.  When an interval holds at most
``small`` rows, or one value, its different values are counted and the position is read off.
Counts are combined before they are shuffled; a pass is a scan, not a sort.  Buckets follow
from subtraction, division and floor, which never reverse two values, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.sources.files import scratch

BUCKETS, SMALL = 4096, 65_536


def _kept(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "quantiles")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nth_values(rows: DataFrame, by: list[str], value: str, wanted: dict[str, Callable[[Column], Column]], buckets: int = BUCKETS, small: int = SMALL) -> DataFrame:
    """``by`` and, for each name of ``wanted``, the value at that index of the group's sorted values.

    ``wanted`` gives the index, from 0, by the number of values.  Nulls and NaN are no values; an index
    outside of the values, and a group without any, gives null.  Groups may be null.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    every = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v"))
    base = every.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    same = lambda df, k: df[k].eqNullSafe(F.col(f"_o{k}"))
    renamed = lambda df: df.select(*[F.col(k).alias(f"_o{k}") for k in keys], *[c for c in df.columns if c not in keys])

    def inside(targets: DataFrame) -> DataFrame:
        """The values of every target's interval."""
        other = renamed(targets)
        within = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        for k in keys:
            within = within & same(base, k)
        return base.join(other, within).select(*keys, "_v", *[c for c in other.columns if not c.startswith("_o_")])

    stats = base.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("_t"), at(F.col("_n")).cast("long").alias("_at")) for name, at in wanted.items()]))
    targets = _kept(stats.select("*", each.alias("_w")).select(*keys, "_w._t", "_w._at", "_n", "_lo", "_hi").where("_at >= 0 AND _at < _n"))
    order = [*keys, "_t"]
    while True:
        wide = (F.col("_lo") < F.col("_hi")) & (F.col("_n") > small)
        if targets.where(wide).isEmpty():
            break
        # Halves, so that the width of an interval stays finite.
        part = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * buckets), F.lit(buckets - 1))
        counted = inside(targets.where(wide)).groupBy(*order, "_at", part.alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*order).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        found = counted.withColumn("_upto", upto).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n")))
        found = found.select(*order, (F.col("_at") - F.col("_upto") + F.col("_n")).alias("_at"), "_n", "_lo", "_hi")
        targets = _kept(targets.where(~wide).unionByName(found))
    single = targets.where("_lo = _hi").select(*order, F.col("_lo").alias("_value"))
    counted = inside(targets.where("_lo < _hi")).groupBy(*order, "_at", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*order).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    read = counted.withColumn("_upto", upto).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_c"))).select(*order, F.col("_v").alias("_value"))
    values = single.unionByName(read).groupBy(*keys).agg(*[F.max(F.when(F.col("_t") == name, F.col("_value"))).alias(name) for name in wanted])
    if not keys:
        return values  # one row
    groups = every.select(*keys).distinct()
    found = renamed(values)
    on = F.lit(True)
    for k in keys:
        on = on & same(groups, k)
    return groups.join(found, on, "left").select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *wanted)


def floor_index(fraction: float) -> Callable[[Column], Column]:
    """Index floor(n * f), at most the last."""
    return lambda n: F.least(F.floor(n * F.lit(fraction)), n - 1)


def upper_median(n: Column) -> Column:
    return F.floor(n / 2)

"""Embedding whitening: covariance by generated column sums, LAPACK on the driver, projection in Spark.

Every entry becomes a whole number.  One aggregation holds generated Spark SQL sums of centred
products of every pair of dimensions (upper triangle): a sum for each distance of two dimensions,
grouped by the first one, as thousands of sums in one row make code that the JVM doesn't
compile.  Its ``d (d + 1) / 2`` numbers are all the driver sees.  Entries are centred by the whole
number next to their mean before they are multiplied, so every product is a whole number and
the sums are exact and the same in any order while they stay below 2^53; the rest of the
centring (less than one half) is taken off the matrix.

Defined results for odd input: a null vector, or one with a null or non-finite entry, is
dropped, and so is one with fewer entries than the longest of the table (as if the missing ones
were null).  Repeated rows count as often as they occur and come out as often; a null vec_id
stays null.  Components whose eigenvalue is zero up to rounding (fewer different vectors than
dimensions) have a null ``whitened`` and take no part in ``identity_error``, which is null if
none is left.  Of an empty table, or one without a vector, the result is empty.  Other columns
don't matter, whatever their names.  A ``deviation`` beyond 64 bits is an arithmetic error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import map_batches, stash, table

#: Whole numbers of entries: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32


def finite(vector: Column) -> Column:
    """Whether a vector is there, and every entry is there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def finite_vectors(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose ``vector`` is finite and as long as the longest of the table; it becomes doubles."""
    rows = df.withColumn(vector, F.col(vector).cast("array<double>"))
    size = rows.agg(F.max(F.size(vector)).alias("n")).first()["n"] or 0
    return rows.where(finite(F.col(vector)) & (F.size(vector) == size) & (F.size(vector) > 0))


def sums(rows: DataFrame, x: str) -> tuple[int, list]:
    """The number of vectors, and the sum of each dimension."""
    one = rows.select(F.posexplode(x).alias("i", "e")).groupBy("i").agg(F.count("*").alias("n"), F.sum("e").alias("s"))
    found = sorted(one.collect())  # one row for each dimension
    return (found[0]["n"], [r["s"] for r in found]) if found else (0, [])


def upper_products(rows: DataFrame, x: str, d: int) -> np.ndarray:
    """The symmetric matrix of sums of products of every two dimensions of the double vectors ``x``.

    One generated sum for each distance t up to half of the dimensions, grouped by the dimension i:
    every pair (i, i + t), the dimensions in a ring, is taken once.
    """
    ring = rows.select(F.concat(x, x).alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("_i"))
    terms = [F.expr(f"sum(get(_r, _i) * get(_r, _i + {t})) AS s{t}") for t in range(d // 2 + 1)]
    found = np.zeros((d, d))
    for row in ring.groupBy("_i").agg(*terms).collect():  # one row for each dimension
        to = (row["_i"] + np.arange(d // 2 + 1)) % d
        found[row["_i"], to] = found[to, row["_i"]] = row[1:]
    return found


def moments(rows: DataFrame, x: str) -> tuple[int, list[int], np.ndarray]:
    """n, sums S of each dimension, and the covariance (divisor n) of the whole-number vectors ``x``."""
    n, total = sums(rows, x)
    if not n:
        return 0, [], np.zeros((0, 0))
    middle = [round(s / n) for s in total]
    centre = F.array(*[F.lit(m).cast("long") for m in middle])
    centred = rows.select(F.zip_with(x, centre, lambda e, m: (e - m).cast("double")).alias("_c"))
    rest = np.array([(s - n * m) / n for s, m in zip(total, middle, strict=True)])
    return n, total, upper_products(centred, "_c", len(total)) / n - np.outer(rest, rest)


def principal(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns."""
    value, vector = np.linalg.eigh(covariance)
    return value[::-1], vector[:, ::-1]


def whiten(rows: DataFrame, x: str, components: int = COMPONENTS) -> DataFrame:
    """The columns of ``rows`` but ``x``, and component, n, deviation, whitened, explained, identity_error.

    ``x`` holds whole-number vectors of one length.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c != x]
    n, total, covariance = moments(rows, x)
    if not n:
        empty = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], rows.select(*kept).schema).join(spark.createDataFrame([], empty))
    d = len(total)
    value, vector = principal(covariance)
    used = min(components, d)
    trace = float(np.trace(covariance))
    real = value[:used] > max(value[0], 0.0) * d * np.finfo(float).eps
    middle = [round(s / n) for s in total]
    # (x - S/n) as the whole centre and the rest, so that nothing is lost beside the offset.
    rest = np.array([(s - n * m) / n for s, m in zip(total, middle, strict=True)])
    centre, scaled = np.array(middle), vector[:, :used][:, real] / np.sqrt(value[:used][real])

    def project(batches):
        for batch in batches:
            own = batch.pop("_x").tolist()
            at = (np.stack(own) - centre - rest) @ scaled if own else []
            yield batch.assign(_w=list(at))

    off = F.zip_with(x, F.array(*[F.lit(s).cast("long") for s in total]), lambda e, s: n * e - s)
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda a, o: a + o * o)
    named = rows.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(kept)], deviation.alias("deviation"), F.col(x).alias("_x"))
    wide = stash(map_batches(named, project, StructType([*named.schema.fields[:-1], StructField("_w", ArrayType(DoubleType()))])), "whitened")
    error, place = None, np.cumsum(real) - 1
    if real.any():
        used_up = int(real.sum())
        mean = np.array(sums(wide, "_w")[1]) / n
        error = float(np.abs(upper_products(wide, "_w", used_up) / n - np.outer(mean, mean) - np.eye(used_up)).max())
    one = lambda k: F.struct(
        F.lit(k + 1).alias("component"),
        (F.get("_w", F.lit(int(place[k]))) if real[k] else F.lit(None).cast("double")).alias("whitened"),
        F.lit(float(value[k] / trace) if trace > 0 else None).cast("double").alias("explained"),
    )
    rows = wide.select(*[f"_{i}" for i in range(len(kept))], "deviation", F.explode(F.array(*[one(k) for k in range(used)])).alias("_e"))
    return rows.select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)],
        F.col("_e.component").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("_e.whitened").alias("whitened"),
        F.col("_e.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def op13_whitening(spark, sf_dir):
    """The registered query: all finite vectors of ``embeddings``, whitened."""
    rows = finite_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "embedding")
    return whiten(rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c * SCALE) + F.lit(OFFSET).cast("long")).alias("x")), "x")

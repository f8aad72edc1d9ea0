"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a character class body and as plain characters.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
WORD = rf"[^{WS_CLASS}]+"

#: Batches that go to Python hold at most so many rows and bytes; a single longer row goes alone.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

_stashed: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (the path may be one that only Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{WS_CLASS}]+")
    )


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it asks for less.

    Spark's default is 10,000 rows or 64 MB, which stand once in the JVM and two or
    three times in the worker; texts are long, so that is most of a worker's memory.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).lower()
        # Sizes with a unit of their own are the session's choice.
        if now.rstrip("b").lstrip("-").isdigit() and not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInPandas`` over bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInPandas(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkfolio-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it back.

    The copy survives lost executors, is compressed, and lets later joins see two
    plain exchanges (so that adaptive execution can split a hot key).  Copies are
    removed when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _stashed:
        atexit.register(_clear)
    _stashed.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clear() -> None:
    for spark, path in _stashed:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - this session is already down; another's folders may still be reached
            continue

"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last ``WINDOW`` lines decides after which lines
a chunk ends, so the same passage is cut alike wherever it stands and an inserted line
only disturbs the chunks around it.  Chunks of two lines or more that occur more than
once in the corpus are candidates; their bytes are compared (grouping by hash *and*
text), and all but the first occurrence (by doc_id, then position) are removed.

The chunking pass emits hashes only.  Repeated hashes are found by an aggregate with
map-side combining; texts of candidate chunks are cut out natively after a join by
doc_id.  A chunk that a third of all documents share is one row per map task in every
aggregate and meets its occurrences only in plain sort-merge joins of stored tables,
which adaptive execution splits.  Nothing is collected, and no side of a join is broadcast:
all of them grow with the corpus.

Defined results for odd input: null and empty texts stay as they are; texts of one line
have no multi-line chunk and stay; very long texts are processed whole; rows that
repeat a doc_id count as one document and keep their chunks; rows without a doc_id are
first occurrences, never losers; an empty table gives an empty result; further columns
are passed through whatever their names, but for ``removed_lines``, which the result's own
column replaces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stash, word_array

#: Lines in the rolling window, mean lines between boundaries, least and most lines of a chunk.
WINDOW, MEAN_LINES, MIN_LINES, MAX_LINES = 3, 4, 2, 64
#: Runs of repeated lines are removed if they have more words.
RUN_WORDS = 50
#: Added to the hashes of windows, so that a window and a chunk are never one group.
_WINDOW_MARK = 0x5851F42D4C957F2D
#: The seed that Spark's xxhash64 uses, so that both sides agree on a chunk's hash.
_SEED = 42
_U = np.uint64
_FACTOR = 0x9E3779B97F4A7C15


def boundaries(lines: list[bytes]) -> list[tuple[int, int]]:
    """(start, number of lines) of the chunks of one text."""
    n = len(lines)
    value = np.fromiter(map(xxhash.xxh64_intdigest, lines), dtype=_U, count=n)
    rolled = np.zeros(n, _U)
    for j in range(min(WINDOW, n)):
        rolled[j:] += value[: n - j] * _U(pow(_FACTOR, j, 1 << 64))
    rolled ^= rolled >> _U(29)
    rolled *= _U(0xBF58476D1CE4E5B9)
    ends = np.flatnonzero((rolled >> _U(32)) % _U(MEAN_LINES) == 0) + 1
    chunks, start = [], 0
    # No chunk ends where fewer than MIN_LINES lines would be left: they could never be removed.
    for end in [*ends[ends <= n - MIN_LINES].tolist(), n]:
        while end - start > MAX_LINES:
            size = min(MAX_LINES, end - start - MIN_LINES)
            chunks.append((start, size))
            start += size
        if end - start >= MIN_LINES or (end == n and end > start):
            chunks.append((start, end - start))
            start = end
    return chunks


def windows(lines: list[bytes]) -> list[tuple[int, int]]:
    """(start, number of lines) of every two neighbouring lines, and of every line of over RUN_WORDS words."""
    return [(i, 2) for i in range(len(lines) - 1)] + [(i, 1) for i, x in enumerate(lines) if len(x) > 2 * RUN_WORDS and len(x.split()) > RUN_WORDS]


def chunk_table(docs: DataFrame, runs: bool = False) -> DataFrame:
    """doc_id, start, n, hash of every chunk of two lines or more; n is negative for the windows of ``runs``."""

    def run(batches):
        for batch in batches:
            ids, starts, sizes, hashes = [], [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                if len(lines) < MIN_LINES:
                    continue
                for start, n in boundaries(lines):
                    if n >= MIN_LINES:
                        ids.append(doc_id)
                        starts.append(start)
                        sizes.append(n)
                        hashes.append(xxhash.xxh64_intdigest(b"\n".join(lines[start : start + n]), _SEED))
                for start, n in windows(lines) if runs else ():
                    ids.append(doc_id)
                    starts.append(start)
                    sizes.append(-n)
                    hashes.append(xxhash.xxh64_intdigest(b"\n".join(lines[start : start + n]), _SEED) ^ _WINDOW_MARK)
            yield pd.DataFrame(
                {
                    "doc_id": pd.array(ids, dtype="Int64"),
                    "start": np.array(starts, np.int32),
                    "n": np.array(sizes, np.int32),
                    "hash": np.array(hashes, _U).view(np.int64),
                }
            )

    several = docs.where(F.contains("text", F.lit("\n"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(several, run, "doc_id long, start int, n int, hash long")


def _cut_out(lines: Column, r: Column) -> Column:
    """The text of a chunk or window."""
    return F.array_join(F.slice(lines, r["start"] + 1, F.abs(r["n"])), "\n")


def _hash_of(text: Column, n: Column) -> Column:
    return F.xxhash64(text).bitwiseXOR(F.when(n < 0, F.lit(_WINDOW_MARK)).otherwise(F.lit(0).cast("long")))


def repeated_chunks(docs: DataFrame, runs: bool = False) -> DataFrame:
    """doc_id and ``ranges`` (start, n, hash) of the chunks to remove: proven repeats of an earlier chunk."""
    chunks = stash(chunk_table(docs, runs), "chunks")
    place = F.struct("doc_id", "start")
    repeats = stash(
        chunks.groupBy("hash")
        .agg(F.min(place).alias("_a"), F.max(place).alias("_z"))
        .where(~F.col("_a").eqNullSafe(F.col("_z")))
        .select(F.col("hash").alias("_h")),
        "repeats",
    )
    found = stash(chunks.join(repeats.hint("merge"), F.col("hash") == F.col("_h")).drop("_h"), "occurrences")
    ranges = found.groupBy(F.col("doc_id").alias("_d")).agg(F.array_sort(F.collect_set(F.struct("start", "n", "hash"))).alias("ranges"))
    texts = (
        docs.where(F.contains("text", F.lit("\n")))
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(ranges.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")))
        # Cut before exploding, or every row would carry all lines of its text.
        .select("doc_id", "ranges", F.split("text", "\n").alias("_lines"))
        .select("doc_id", F.explode(F.transform("ranges", lambda r: F.struct(r["start"].alias("start"), r["n"].alias("n"), r["hash"].alias("hash"), _cut_out(F.col("_lines"), r).alias("chunk")))).alias("r"))
        .select("doc_id", "r.*")
        # Rows that repeat a doc_id with another text don't hold the chunk at that place.
        .where(_hash_of(F.col("chunk"), F.col("n")) == F.col("hash"))
    )
    # Byte comparison: one group for each different text; nearly always one to a hash.
    equal = stash(texts.groupBy("hash", "chunk").agg(F.min(place).alias("first")), "byte-groups")
    per_hash = stash(
        equal.groupBy("hash").agg(F.count("*").alias("_texts"), F.min("first").alias("first")).select(F.col("hash").alias("_h"), "_texts", "first"),
        "groups",
    )
    losers = (
        found.join(per_hash.hint("merge"), F.col("hash") == F.col("_h"))
        .where((F.col("_texts") == 1) & ~place.eqNullSafe(F.col("first")))
        .select("doc_id", "start", "n", "hash")
    )
    if not per_hash.where("_texts > 1").isEmpty():
        clashing = per_hash.where("_texts > 1").select("_h")
        first = equal.join(clashing, F.col("hash") == F.col("_h"), "left_semi").select(F.col("hash").alias("_h"), F.col("chunk").alias("_c"), "first")
        losers = losers.unionByName(
            texts.join(first, (F.col("hash") == F.col("_h")) & (F.col("chunk") == F.col("_c")))
            .where(~place.eqNullSafe(F.col("first")))
            .select("doc_id", "start", "n", "hash")
        )
    return stash(
        losers.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "n", "hash"))).alias("ranges")), "removals"
    )


def _joined(ranges: Column, gap: int) -> Column:
    """Sorted (start, end) without overlaps; neighbours at most ``gap`` lines apart become one."""

    def step(done, r):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        apart = (F.size(done) == 0) | (r["start"] > F.try_element_at(done, F.lit(-1))["end"] + gap)
        return F.when(apart, F.concat(done, F.array(r))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<start:int,end:int>>"), step)


def _removed(lines: Column, ranges: Column) -> Column:
    """(start, end) of the lines to remove: repeated chunks, and stretches of repeated windows that have the words."""
    ends = lambda rs: F.transform(rs, lambda r: F.struct(r["start"].alias("start"), (r["start"] + F.abs(r["n"])).alias("end")))
    words = lambda r: F.size(word_array(F.array_join(F.slice(lines, r["start"] + 1, r["end"] - r["start"]), "\n")))
    # Windows that only touch are two stretches: the lines on both sides were not seen together.
    runs = F.filter(_joined(ends(F.filter(ranges, lambda r: r["n"] < 0)), -1), lambda r: words(r) > RUN_WORDS)
    return _joined(F.concat(ends(F.filter(ranges, lambda r: r["n"] > 0)), runs), 0)


def line_dedup(docs: DataFrame, drop_emptied: bool = False, runs: bool = False) -> DataFrame:
    """The documents with repeated chunks removed, and ``removed_lines``; ``n_chars``, if there, follows the text.

    With ``runs``, repeated runs of lines of over RUN_WORDS words go too, wherever chunks end.

    A document all of whose lines repeat earlier ones keeps its row with an empty text,
    or goes if ``drop_emptied``.
    """
    removals = repeated_chunks(docs, runs).select(F.col("doc_id").alias("_d"), F.col("ranges").alias("_ranges"))
    columns = docs.columns
    # Rows travel as one struct beside their text, so that no column of theirs can clash with ours.
    rest = [c for c in columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("_row"), F.col("doc_id").cast("long").alias("_id"), "text")
    joined = rows.join(removals.hint("merge"), F.col("_id") == F.col("_d"), "left").withColumn(
        "_lines", F.when(F.col("_ranges").isNotNull() & F.col("text").isNotNull(), F.split("text", "\n"))
    )
    here = joined.withColumn(
        "_ranges",
        F.filter(
            "_ranges",
            lambda r: _hash_of(_cut_out(F.col("_lines"), r), r["n"]) == r["hash"],
        ),
    ).withColumn("_ranges", _removed(F.col("_lines"), F.col("_ranges")))
    left = F.array_join(
        F.filter(
            "_lines",
            lambda _, i: ~F.exists("_ranges", lambda r: (i >= r["start"]) & (i < r["end"])),
        ),
        "\n",
    )
    cut = here.withColumn("_text", F.coalesce(left, F.col("text"))).withColumn(
        "_removed", F.coalesce(F.aggregate("_ranges", F.lit(0), lambda a, r: a + r["end"] - r["start"]), F.lit(0)).cast("long")
    )
    if drop_emptied:
        # Exploding none or one text drops the row; a filter would be pushed below the columns it tests and compute them again for every line.
        texts = F.when((F.col("_removed") > 0) & (F.col("_text") == ""), F.array().cast("array<string>")).otherwise(F.array("_text"))
        cut = cut.select("_row", "_removed", F.explode(texts).alias("_text"))
    out = []
    for c in columns:
        if c == "text":
            out.append(F.col("_text").alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("_removed") > 0, F.length("_text")).otherwise(F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c))
        elif c != "removed_lines":
            out.append(F.col("_row")[c].alias(c))
    return cut.select(*out, F.col("_removed").alias("removed_lines"))


def op3_line_dedup(spark, sf_dir):
    """The registered query: all ``documents``, with what is left of each text."""
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), runs=True)

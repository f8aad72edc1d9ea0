"""Hard-negative mining: PCA-rotated partial products discard early, integer products decide.

Entries become whole numbers; a score is the whole-number inner product.  An orthogonal
rotation to principal axes keeps inner products and puts most of them into the leading
components.  Blocks of items stay in a task while all anchors stream past.  For a tile of
both, products are added up over the leading components; what remains is at most the product
of the residual norms, plus a slack for rounding, so every pair that can't reach what is asked
is discarded early.  Pairs that survive are scored again by products of whole numbers, and only
those scores decide.  What is asked of a pair rises as the first ``k`` of a window fill up.

Two passes: the first finds the positives of each anchor, which fix windows of scores; the
second finds in each window the first ``k`` of the other labels.  Each block passes on at most
``k`` rows of an anchor's window, and a window function takes the first ``k`` of all blocks.  Items
cross the network once, anchors once for each block; a block grows with the table up to
``MAX_BLOCK`` rows, so memory is bounded.  No label, anchor or vector is a key of a shuffle
of items, so frequent ones are spread.

Defined results for odd input: rows with a null label, a null vector, or any null or
non-finite entry take no part; nor do vectors with fewer entries than the longest of the table.
Rows equal in vec_id, label and vector count once; a null vec_id is no anchor and, as a partner,
follows all others.  A row is no partner of rows with its own vec_id.  Anchors without another
row of their label, or with an empty window, have no rows (a negative positive_score leaves
none).  Scores tie by vec_id, then by the row's hash.  An empty table gives an empty result;
other columns don't matter.  Entries whose products could leave 64 bits are an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stash, table
from .whitening import finite_vectors, principal

SCALE = 256
ANCHOR_STEP, LABEL_STEP, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
#: Items of a block: as many as give every core a few blocks, between these.
MIN_BLOCK, MAX_BLOCK = 4096, 131_072
#: Anchors and items of one tile; pairs whose whole-number products are taken at once.
TILE_ANCHORS, TILE_ITEMS, TILE_PAIRS = 256, 4096, 1 << 15
#: Shares of the components after which pairs are discarded.
CUTS = (0.25, 0.5, 0.75, 1.0)
#: Survivors of a tile under this share go to whole-number products without more components.
FEW = 0.02

_NONE = -(1 << 62)


def _products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whole-number inner products of pairs of rows."""
    found = np.empty(len(i), np.int64)
    for s in range(0, len(i), TILE_PAIRS):
        found[s : s + TILE_PAIRS] = np.einsum("ij,ij->i", x[i[s : s + TILE_PAIRS]], y[j[s : s + TILE_PAIRS]], dtype=np.int64)
    return found


class Rotated:
    """Whole-number vectors, rotated, with the norms of what is left after each cut."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        d = x.shape[1]
        self.x = x
        self.r = x.astype(float) @ axes
        self.cuts = sorted({max(1, round(d * c)) for c in CUTS})
        squares = np.cumsum((self.r**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = [np.sqrt(squares[:, c]) * (1 + 1e-9) if c < d else np.zeros(len(x)) for c in self.cuts]
        self.norm = np.sqrt((x.astype(float) ** 2).sum(1))

    def slack(self) -> np.ndarray:
        """The share of two norms by which a rounded rotated product can be off."""
        return self.norm * (64 * self.r.shape[1] * np.finfo(float).eps)


def survivors(items: Rotated, a: slice, anchors: Rotated, b: slice, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (item, anchor) of a tile, of those ``allowed``, whose product can lie between ``low`` and ``high`` of the anchor."""
    done = 0
    product = np.zeros(allowed.shape)
    slack = items.slack()[a][:, None] * anchors.norm[b][None, :]
    for cut, mine, theirs in zip(items.cuts, items.rest, anchors.rest, strict=True):
        product += items.r[a, done:cut] @ anchors.r[b, done:cut].T
        reach = mine[a][:, None] * theirs[b][None, :] + slack
        allowed = allowed & (product + reach >= low) & (product - reach <= high)
        done = cut
        if allowed.sum() <= FEW * allowed.size:
            break
    i, j = np.nonzero(allowed)
    return i + a.start, j + b.start


class Best:
    """The first k (score falling, then vec_id, then hash) of every anchor's windows."""

    def __init__(self, anchors: int, windows: int, k: int):
        self.score = np.full((anchors, windows, k), _NONE, np.int64)
        self.id = np.zeros((anchors, windows, k), np.int64)
        self.hash = np.zeros((anchors, windows, k), np.int64)

    def least(self, low: np.ndarray) -> np.ndarray:
        """The least score that still matters, per anchor and window."""
        return np.maximum(low, self.score[:, :, -1])

    def add(self, w: int, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> None:
        k = self.score.shape[2]
        order = np.lexsort((hashes, ids, -score, anchor))
        anchor, score, ids, hashes = anchor[order], score[order], ids[order], hashes[order]
        start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        nth = np.arange(len(anchor)) - np.repeat(start, np.diff(np.r_[start, len(anchor)]))
        keep = nth < k
        touched, row = np.unique(anchor[keep], return_inverse=True)
        both = []
        for own, new, blank in ((self.score, score, _NONE), (self.id, ids, 0), (self.hash, hashes, 0)):
            wide = np.full((len(touched), 2 * k), blank, np.int64)
            wide[:, :k] = own[touched, w]
            wide[row, k + nth[keep]] = new[keep]
            both.append(wide)
        first = np.lexsort((both[2], both[1], -both[0]), axis=1)[:, :k]
        for own, wide in zip((self.score, self.id, self.hash), both, strict=True):
            own[touched, w] = np.take_along_axis(wide, first, axis=1)


def first_in_windows(items: Rotated, item: pd.DataFrame, anchors: Rotated, anchor: pd.DataFrame, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> Best:
    """For every anchor and window [low, high] the first k items of its own (``same``) or the other labels."""
    best = Best(len(anchor), low.shape[1], k)
    label, ids, hashes = (item[c].to_numpy() for c in ("label", "vec_id", "hash"))
    own_label, own_id = anchor["label"].to_numpy(), anchor["vec_id"].to_numpy()
    for s in range(0, len(anchor), TILE_ANCHORS):
        b = slice(s, min(s + TILE_ANCHORS, len(anchor)))
        start, size = 0, TILE_ITEMS // 8  # a small first tile fills the windows
        while start < len(item):
            a = slice(start, min(start + size, len(item)))
            start, size = a.stop, TILE_ITEMS
            least = np.where(low[b] <= high[b], best.least(low)[b], 1 << 62)
            alike = label[a][:, None] == own_label[b][None, :]
            allowed = (alike if same else ~alike) & (ids[a][:, None] != own_id[b][None, :])
            i, j = survivors(items, a, anchors, b, least.min(1).astype(float), high[b].max(1).astype(float), allowed)
            score = _products(items.x, anchors.x, i, j)
            for w in range(low.shape[1]):
                inside = (score >= least[j - s, w]) & (score <= high[j, w])
                if inside.any():
                    best.add(w, j[inside], score[inside], ids[i[inside]], hashes[i[inside]])
    return best


def second_moments(rows: DataFrame) -> np.ndarray:
    """Sums of products of every two dimensions of ``x``: each task adds up its own, Spark adds up the tasks' cells."""

    def run(batches):
        own = 0.0
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()).astype(float) if len(batch) else np.zeros((0, 0))
            own = own + x.T @ x if len(batch) else own
        if np.ndim(own):
            yield pd.DataFrame({"cell": np.arange(own.size), "value": own.ravel()})

    cells = map_batches(rows.select("x"), run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    return cells.sort_values("cell")["value"].to_numpy().reshape(round(len(cells) ** 0.5), -1)


#: Stands for a null vec_id, after all others.
_LAST = (1 << 63) - 1


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, axes: np.ndarray, k: int, same: bool) -> DataFrame:
    """anchor (hash), window, score, vec_id, hash: the first k of each block.  ``anchors`` have ``low`` and ``high``."""
    key = ["vec_id", "hash", "label", "x"]
    nothing = F.array().cast("array<bigint>")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = (
        rows.select(F.pmod("hash", F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), *key, nothing.alias("low"), nothing.alias("high"))
        .unionByName(anchors.select(every.alias("block"), F.lit(1).alias("kind"), *key, "low", "high"))
        .repartition(blocks, "block")
        .sortWithinPartitions("block", "kind")
    )

    def run(batches):
        held, ready, at = [], None, None
        for batch in batches:
            batch["vec_id"] = batch["vec_id"].astype("Int64").fillna(_LAST).astype("int64")
            change = np.flatnonzero(np.r_[True, (batch["block"].to_numpy()[1:] != batch["block"].to_numpy()[:-1]) | (batch["kind"].to_numpy()[1:] != batch["kind"].to_numpy()[:-1])])
            for s, e in zip(change, np.r_[change[1:], len(batch)], strict=True):
                part = batch.iloc[s:e]
                if part["block"].iloc[0] != at:
                    held, ready, at = [], None, part["block"].iloc[0]
                x = np.stack(part["x"].to_numpy())
                if part["kind"].iloc[0] == 0:
                    held.append((part[["vec_id", "hash", "label"]], x.astype(np.int32)))
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = pd.concat([h[0] for h in held], ignore_index=True), Rotated(np.concatenate([h[1] for h in held]), axes)
                low, high = (np.stack(part[c].to_numpy()) for c in ("low", "high"))
                own = part.reset_index(drop=True)
                best = first_in_windows(ready[1], ready[0], Rotated(x, axes), own, low, high, k, same)
                i, w, n = np.nonzero(best.score > _NONE)
                yield pd.DataFrame({"anchor": own["hash"].to_numpy()[i], "window": w.astype(np.int32), "score": best.score[i, w, n], "vec_id": best.id[i, w, n], "hash": best.hash[i, w, n]})

    found = map_batches(dealt, run, "anchor long, window int, score long, vec_id long, hash long")
    first = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "vec_id", "hash")
    return found.select("*", F.row_number().over(first).alias("rank")).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all anchors.

    ``rows``: vec_id, label, x (whole-number vectors of one length).
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("x").cast("array<bigint>").alias("x"))
    rows = stash(rows.dropDuplicates().withColumn("hash", F.xxhash64("vec_id", "label", "x")), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))).first()[0] >= 2.0**55:
        raise ArithmeticError("entries are too large for 64-bit scores")
    axes = np.ascontiguousarray(principal(second_moments(rows))[1])
    blocks = -(-n // min(MAX_BLOCK, max(MIN_BLOCK, -(-n // (2 * spark.sparkContext.defaultParallelism)))))
    anchors = rows.where(is_anchor)
    bounds = lambda low, high: (F.array(F.lit(low).cast("long")).alias("low"), F.array(F.lit(high).cast("long")).alias("high"))
    near = stash(_search(rows, anchors.select("*", *bounds(_NONE + 1, -_NONE)), blocks, axes, positives, True), "positives")
    own = near.groupBy(F.col("anchor").alias("hash")).agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    # Whole bounds: 30 * positive <= 100 * negative <= 90 * positive.
    share = lambda c, up: F.expr(f"transform(p, p -> (p.score * {c} + {up} - pmod(p.score * {c} + {up}, 100L)) div 100)")
    low, high = share(LOWEST, 99), share(HIGHEST, 0)
    asked = stash(anchors.join(own, "hash").select("vec_id", "hash", "label", "x", "p", low.alias("low"), high.alias("high")), "asked")
    found = _search(rows, asked, blocks, axes, negatives, False).withColumnRenamed("vec_id", "negative_id")
    real = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c)
    return (
        found.join(asked.select(F.col("hash").alias("anchor"), F.col("vec_id").alias("anchor_id"), "p"), "anchor")
        .select("anchor_id", F.get("p", F.col("window")).alias("p"), "rank", real("negative_id"), F.col("score").alias("negative_score"))
        .select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("p.score").alias("positive_score"), "negative_score")
        .withColumn("positive_id", real("positive_id"))
    )


def prepared(rows: DataFrame) -> DataFrame:
    """vec_id, label, x of the finite vectors that have a label: every seventh label is changed, entries become whole numbers."""
    rows = finite_vectors(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"), "embedding").where(F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % LABEL_STEP == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda c: F.floor(c * SCALE)).alias("x"))


def op12_hard_negatives(spark, sf_dir):
    """The registered query: hard negatives of every vector whose id is divisible by 100, among all ``embeddings``."""
    return hard_negatives(prepared(table(spark, sf_dir, "embeddings")), F.col("vec_id") % ANCHOR_STEP == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.x::DOUBLE[], b.x::DOUBLE[])::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.*, other_id AS negative_id, score AS negative_score,
             (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INT AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

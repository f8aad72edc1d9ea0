"""Greedy near-duplicate removal over vectors, block by block in order.

The walk keeps a vector if no kept earlier one is similar to it, so pairs of dropped
vectors never matter.  Vectors are numbered in the walk's order and settled in blocks of at most
``BLOCK``: the block's rows travel with the job and meet the stored survivors of the blocks before, then one
task walks those that are left.  A block's outcome is written once and never again; no table of pairs
is made.  Work is rows times survivors, without the pairs that cells exclude.

*Cells.*  Similar vectors are near each other: ``|x - y|^2 = |x|^2 + |y|^2 - 2 x.y``.  Rows and survivors
are split into cells by their nearest pivot, then in halves along the axes in which a sample is spread most;
two cells whose boxes are further apart than that allows are skipped whole.

*Absorbers.*  A dropped vector is absorbed by the most similar survivor within the first group of
``GROUP`` survivors (in their order) that holds a similar one.  A row that is dropped by the group that its block
goes on to fill may still find a more similar one there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.sources.files import scratch

from .order import positions

BLOCK, GROUP, PIVOTS = 32768, 512, 16
#: Rows of a cell, survivors that are multiplied with one at once, and rows that the axes are taken from.
CELL, TILE, SAMPLE = 128, 2048, 1024
#: Products in single precision choose pairs; those within this of the threshold are added up in the order of the elements.
_MARGIN = 1e-5


def _margin(x: np.ndarray, y: np.ndarray) -> float:
    """What a product in single precision may be off by: more for long vectors and many elements."""
    norm = lambda v: float(np.sqrt((v**2).sum(1).max(initial=0)))
    return max(_MARGIN, x.shape[1] * 1.2e-7) * max(1.0, norm(x) * norm(y))


def exact_scores(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of pairs of rows, added up element by element and rounded to six places."""
    score = np.zeros(len(i))
    for d in range(x.shape[1]):
        score += x[i, d] * y[j, d]
    return np.round(score, 6)


class _Cells:
    """Vectors in an order in which neighbours are together, and the boxes of their cells."""

    def __init__(self, v: np.ndarray, pivots: np.ndarray, axes: np.ndarray):
        place, nearest = v @ axes.T, ((pivots**2).sum(1) - 2 * v @ pivots.T).argmin(1)
        self.order, self.ends = np.argsort(nearest, kind="stable"), []
        edges = np.r_[0, np.flatnonzero(np.diff(nearest[self.order])) + 1, len(v)] if len(v) else np.zeros(1, np.int64)
        todo = list(zip(edges[-2::-1].tolist(), edges[:0:-1].tolist(), strict=True))
        while todo:
            start, end = todo.pop()
            if end - start <= CELL:
                self.ends.append((start, end))
                continue
            at, middle = self.order[start:end], (end - start) // 2
            self.order[start:end] = at[np.argpartition(place[at, place[at].var(0).argmax()], middle)]
            todo += [(start + middle, end), (start, start + middle)]
        self.low, self.high = (np.array([f(place[self.order[s:e]], axis=0) for s, e in self.ends]).reshape(-1, len(axes)) for f in (np.min, np.max))
        norms = (v**2).sum(1)
        self.norm = np.array([norms[self.order[s:e]].max() for s, e in self.ends])
        self.v = v[self.order].astype(np.float32)


class Survivors:
    """Kept vectors in cells: by the nearest of a few of ``pivots`` (any sample of vectors), and along the axes in which these are spread most."""

    def __init__(self, v: np.ndarray, pivots: np.ndarray, threshold: float):
        self.kept, self.threshold = v, threshold
        self.pivots, self.axes = pivots[:: -(-len(pivots) // PIVOTS)], np.linalg.svd(pivots, full_matrices=False)[2]
        self.cells = self.celled(v)
        #: Products taken and skipped, for tests and reports.
        self.taken = self.skipped = 0

    def celled(self, v: np.ndarray) -> _Cells:
        return _Cells(v, self.pivots, self.axes)

    def similar(self, rows: np.ndarray, cells: _Cells | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, survivor, score) of all pairs at or over the threshold; ``cells`` are those of the rows, if there already."""
        own, cells = self.cells, cells or self.celled(rows)
        least = self.threshold - _margin(rows, self.kept)
        sizes, room = np.array([e - s for s, e in own.ends], np.int64), np.empty(CELL * TILE, np.float32)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c, (s, e) in enumerate(cells.ends):
            gap = np.maximum(np.maximum(own.low - cells.high[c], cells.low[c] - own.high), 0)
            near = np.repeat((gap**2).sum(1) <= np.maximum(own.norm + cells.norm[c] - 2 * least, 0) + 1e-9, sizes)
            at = np.flatnonzero(near)
            self.taken += (e - s) * len(at)
            self.skipped += (e - s) * (len(near) - len(at))
            for t in range(0, len(at), TILE):
                to = at[t : t + TILE]
                product = np.dot(cells.v[s:e], own.v[to].T, out=room[: (e - s) * len(to)].reshape(e - s, len(to)))
                most = product.max(1)
                if most.max() >= least:
                    some = np.flatnonzero(most >= least)
                    i, j = np.nonzero(product[some] >= least)
                    left.append(cells.order[s + some[i]])
                    right.append(own.order[to[j]])
        i, j = np.concatenate(left), np.concatenate(right)
        score = exact_scores(rows, self.kept, i, j)
        keep = score >= self.threshold
        return i[keep], j[keep], score[keep]


def _first_hits(row: np.ndarray, index: np.ndarray, score: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that are hit, and for each the number of its best hit: first group, then score, then order."""
    order = np.lexsort((index, -score, index // group, row))
    first = np.r_[True, row[order][1:] != row[order][:-1]] if len(order) else np.zeros(0, bool)
    return row[order[first]], order[first]


def walk(v: np.ndarray, waiting: np.ndarray, before: int, threshold: float, group: int = GROUP, step: int = 256) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """One block in order: survivors' row numbers, and (row, survivor's index, score) of every row they hit.

    ``waiting``: the group that a row waits for, or -1; such a row is dropped already and only meets that group.
    ``before``: survivors of earlier blocks.
    """
    kept: list[int] = []
    hits: list[tuple[int, int, float]] = []
    least, single, own_kept = threshold - _margin(v, v), v.astype(np.float32), np.empty(v.shape, np.float32)
    room = np.empty(step * TILE, np.float32)
    for s in range(0, len(v), step):
        rows = np.arange(s, min(s + step, len(v)))
        near = [[] for _ in rows]
        earlier = np.array(kept, np.int64)
        for t in range(0, len(kept), TILE):
            other = own_kept[t : min(t + TILE, len(kept))]
            product = np.dot(single[rows], other.T, out=room[: len(rows) * len(other)].reshape(len(rows), len(other)))
            some = np.flatnonzero(product.max(1) >= least)
            if not len(some):
                continue
            i, j = np.nonzero(product[some] >= least)
            i, j = some[i], t + j
            score = exact_scores(v, v, rows[i], earlier[j])
            for r, k, x in zip(i[score >= threshold], j[score >= threshold], score[score >= threshold], strict=True):
                near[r].append((before + int(k), float(x)))
        i, j = np.nonzero(np.tril(single[rows] @ single[rows].T >= least, -1))
        score = exact_scores(v, v, rows[i], rows[j])
        inside = [[] for _ in rows]
        for r, c, x in zip(i[score >= threshold], j[score >= threshold], score[score >= threshold], strict=True):
            inside[r].append((int(c), float(x)))
        index_of: dict[int, int] = {}
        for r in range(len(rows)):
            own = near[r] + [(index_of[c], x) for c, x in inside[r] if c in index_of]
            wait = waiting[s + r]
            if wait >= 0:
                hits += [(s + r, k, x) for k, x in own if k // group == wait]
            elif own:
                hits += [(s + r, k, x) for k, x in own]
            else:
                index_of[r] = before + len(kept)
                own_kept[len(kept)] = single[s + r]
                kept.append(s + r)
    return np.array(kept, np.int64), hits


_STATE = "node long, kept boolean, absorber long, index long, v binary"
_HITS = "place long, index long, score double, absorber long"


def _packed(vectors: str) -> Column:
    @F.pandas_udf("binary")
    def pack(vs: pd.Series) -> pd.Series:
        return vs.map(lambda v: np.asarray(v, np.float64).tobytes())

    return pack(vectors)


def _unpacked(vectors: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(-1, size)


def _meeting(shipped, threshold: float, group: int):
    """The best hit of each row of a block among a task's survivors (index, node, v)."""

    def meet(batches):
        places, rows, sample = shipped.value
        cells = None
        for frame in batches:
            if not len(frame):
                continue
            found = Survivors(_unpacked(frame["v"], rows.shape[1]), sample, threshold)
            cells = cells or found.celled(rows)
            row, to, score = found.similar(rows, cells)
            index = frame["index"].to_numpy()[to]
            at, best = _first_hits(row, index, score, group)
            yield pd.DataFrame({"place": places[at], "index": index[best], "score": score[best], "absorber": frame["node"].to_numpy()[to[best]]})

    return meet


def _settling(first: int, threshold: float, group: int, size: int):
    """Walks the rows of one block that no survivor before it has settled; ``first`` is the number of those survivors."""

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", ignore_index=True)
        index, score = frame["index"].fillna(-1).to_numpy(np.int64), frame["score"].to_numpy(float, copy=True)
        absorber, node = frame["absorber"].fillna(-1).to_numpy(np.int64, copy=True), frame["node"].to_numpy()
        # Groups that are full have given their best hit; the last one may not be.
        left = np.flatnonzero((index < 0) | (index // group >= first // group))
        v = _unpacked(frame["v"].iloc[left], size)
        kept, hits = walk(v, np.where(index[left] >= 0, index[left] // group, -1), first, threshold, group)
        row, to, x = (np.array(c) for c in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        at, best = _first_hits(row, to, x, group)
        # Of equal scores the earlier survivor stays.
        better = (index[left[at]] < 0) | (x[best] > score[left[at]])
        absorber[left[at[better]]] = node[left[kept[to[best[better]] - first]]]
        own = np.zeros(len(frame), bool)
        own[left[kept]] = True
        number = np.full(len(frame), -1)
        number[left[kept]] = first + np.arange(len(kept))
        return pd.DataFrame({"node": node, "kept": own, "absorber": absorber, "index": number, "v": frame["v"].where(own, None)})

    return settle


def near_survivors(vectors: DataFrame, threshold: float, *order: Column, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """node, kept, absorber (null for survivors).  ``vectors``: node (long), v, and the columns of ``order``."""
    spark = vectors.sparkSession
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], "node long, kept boolean, absorber long")
    packed = vectors.select("node", _packed("v").alias("v"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    placed = positions(packed, *[F.col(f"_o{i}") for i in range(len(order))], name="place", start=0)
    # Each block is a folder of its own, read twice: to travel with the job, and to be walked.
    path, done = scratch(spark, "placed"), scratch(spark, "settled")
    placed.select("place", F.col("node").cast("long").alias("node"), "v", F.floor(F.col("place") / block).cast("long").alias("_block")).write.partitionBy("_block").parquet(path)
    read = lambda b: spark.read.schema("place long, node long, v binary").parquet(f"{path}/_block={b}")
    parts = spark.sparkContext.defaultParallelism
    kept_so_far, sample, size = 0, None, 0
    for b in range(-(-n // block)):
        rows = read(b)
        if b == 0:
            # The axes are those of a bounded sample of the first block.
            some = rows.where(F.col("place") % max(1, min(n, block) // SAMPLE) == 0).limit(2 * SAMPLE).select("v").toPandas()["v"]
            size = len(some.iloc[0]) // 8
            sample = _unpacked(some, size)
            state = rows.select("place", "node", "v", F.lit(None).cast("long").alias("index"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("absorber"))
        else:
            own = rows.select("place", "v").toPandas()  # at most ``block`` rows
            shipped = spark.sparkContext.broadcast((own["place"].to_numpy(), _unpacked(own["v"], size), sample))
            before = spark.read.schema(_STATE).parquet(done).where("kept").select("index", "node", "v")
            hits = before.mapInPandas(_meeting(shipped, threshold, group), _HITS)
            first = F.struct(F.floor(F.col("index") / group), -F.col("score"), "index")
            best = hits.groupBy("place").agg(F.min_by(F.struct("index", "score", "absorber"), first).alias("_h")).select("place", "_h.*")
            state = rows.join(best, "place", "left")
        state.groupBy().applyInPandas(_settling(kept_so_far, threshold, group, size), _STATE).repartition(parts).write.mode("append").parquet(done)
        if b:
            shipped.destroy()
        kept_so_far = spark.read.schema(_STATE).parquet(done).where("kept").count()
    return spark.read.schema(_STATE).parquet(done).select("node", "kept", F.when(F.col("absorber") >= 0, F.col("absorber")).alias("absorber"))

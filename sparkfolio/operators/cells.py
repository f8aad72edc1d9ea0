"""A vector index: coarse cells, one-byte codes, exact rescoring.

``build`` fits centres by spherical k-means on at most ``SAMPLE`` vectors (those with the least hash of
their id), gives every vector of the table its nearest centre's cell and a code of one byte for
each element, and stores ``rows`` (item_id, cell, scale, code, vector) sorted by cell.

``search`` scores codes only (a quarter of the bytes; the vectors' column isn't read), and of
those only the cells nearest to a question, until they hold ``share`` of the table.  Blocks of
codes, dealt by id so that a large cell is spread, stay in a task while all questions stream past;
a block passes on the first ``depth`` of a question, and the first ``depth`` of all blocks are scored
again by the stored vectors, exactly as an exhaustive search would.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import dot

SAMPLE, MAX_CELLS, ROUNDS = 20_000, 2048, 6
#: Cells for each square root of the table's rows.
FINENESS = 8
#: Share of the table whose codes a question looks at, and candidates scored again for each hit asked for.
SHARE, DEPTH = 0.7, 4
BLOCK, TILE = 32_768, 128


@dataclass(frozen=True)
class CellIndex:
    rows: DataFrame
    centres: np.ndarray
    #: Vectors of each cell.
    sizes: np.ndarray


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of at most ``cells`` cells; the start is evenly spread over the sample, so reruns agree."""
    start = np.unique(np.linspace(0, len(sample) - 1, cells).round().astype(int))
    centres = sample[start].copy()
    for _ in range(rounds):
        # A slice at a time: the driver never holds all products.
        cell = np.concatenate([(sample[s : s + 1024] @ centres.T).argmax(1) for s in range(0, len(sample), 1024)])
        total = np.zeros_like(centres)
        np.add.at(total, cell, sample)
        length = np.linalg.norm(total, axis=1)
        centres[length > 0] = total[length > 0] / length[length > 0, None]
    return centres


def _encoded(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(v).max(1) / 127
    return np.rint(v / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8), scale.astype(np.float32)


def build(items: DataFrame, folder: str) -> None:
    """Write the index of (item_id, v)."""
    n = items.count()
    sample = items.orderBy(F.xxhash64("item_id"), "item_id").limit(SAMPLE).select("v").toPandas()["v"]
    if not n:
        raise ValueError("no vectors")
    centres = fit_centres(np.stack(sample.to_numpy()).astype(float), min(MAX_CELLS, max(1, int(FINENESS * n**0.5))))

    def assign(batches):
        for batch in batches:
            v = np.stack(batch["v"].to_numpy()).astype(np.float32)
            code, scale = _encoded(v)
            yield pd.DataFrame({"item_id": batch["item_id"], "cell": (v @ centres.T).argmax(1).astype(np.int32), "scale": scale, "code": [c.tobytes() for c in code], "vector": list(v)})

    rows = items.select("item_id", "v").mapInPandas(assign, "item_id long, cell int, scale float, code binary, vector array<float>")
    rows.repartitionByRange("cell", "item_id").sortWithinPartitions("cell", "item_id").write.parquet(f"{folder}/rows")
    spark = items.sparkSession
    spark.createDataFrame(enumerate(centres.tolist()), "cell int, centre array<double>").write.parquet(f"{folder}/centres")


def read(spark: SparkSession, folder: str) -> CellIndex:
    """At most ``MAX_CELLS`` centres and sizes come to the driver."""
    rows = spark.read.parquet(f"{folder}/rows")
    centres = spark.read.parquet(f"{folder}/centres").toPandas().sort_values("cell")["centre"]
    sizes = np.zeros(len(centres), np.int64)
    for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    return CellIndex(rows, np.stack(centres.to_numpy()), sizes)


def probed(q: np.ndarray, centres: np.ndarray, sizes: np.ndarray, share: float) -> np.ndarray:
    """(questions, cells): the nearest cells of each question, until they hold the share of all vectors."""
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    found = np.zeros(order.shape, bool)
    np.put_along_axis(found, order, before < share * sizes.sum(), axis=1)
    return found


def search(questions: DataFrame, index: CellIndex, k: int, share: float = SHARE, same: bool = True) -> DataFrame:
    """query_id, item_id, score, rank, looked_at (codes that the question looked at); ``same`` as in ``vector_search``."""
    depth, centres, sizes = DEPTH * k, index.centres, index.sizes
    blocks = max(1, -(-int(sizes.sum()) // BLOCK))
    item = index.rows.select(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.col("item_id").alias("id"), "cell", "scale", "code", F.array().cast("array<double>").alias("q"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = questions.select(every.alias("block"), F.lit(1).alias("kind"), F.col("query_id").cast("long").alias("id"), F.lit(0).alias("cell"), F.lit(0.0).cast("float").alias("scale"), F.lit(None).cast("binary").alias("code"), F.col("q").cast("array<double>").alias("q"))
    dealt = item.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind", "cell", "id")

    def run(batches):
        at, held, ready = None, [], None
        for batch in batches:
            block, kind = batch["block"].to_numpy(), batch["kind"].to_numpy()
            change = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])])
            for s, e in zip(change, np.r_[change[1:], len(batch)], strict=True):
                part = batch.iloc[s:e]
                if block[s] != at:
                    at, held, ready = block[s], [], None
                if kind[s] == 0:
                    code = np.frombuffer(b"".join(part["code"]), np.int8).reshape(len(part), -1)
                    held.append((part["id"].to_numpy(), part["cell"].to_numpy(), code.astype(np.float32) * part["scale"].to_numpy(np.float32)[:, None]))
                    continue
                if not held:
                    continue
                ready = ready or tuple(np.concatenate(x) for x in zip(*held, strict=True))
                ids, cell, v = ready
                edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
                for t in range(0, len(part), TILE):
                    tile = part.iloc[t : t + TILE]
                    q = np.stack(tile["q"].to_numpy())
                    near = probed(q, centres, sizes, share)
                    score = np.full((len(q), len(ids)), -np.inf, np.float32)
                    for a, b in zip(edge[:-1], edge[1:], strict=True):
                        who = np.flatnonzero(near[:, cell[a]])
                        score[who, a:b] = q[who].astype(np.float32) @ v[a:b].T
                    own = tile["id"].to_numpy()
                    if same:
                        score[own[:, None] == ids[None, :]] = -np.inf
                    top = np.argpartition(-score, min(depth, len(ids)) - 1, axis=1)[:, :depth]
                    value = np.take_along_axis(score, top, axis=1)
                    r, c = np.nonzero(np.isfinite(value))
                    yield pd.DataFrame({"query_id": own[r], "item_id": ids[top[r, c]], "near": value[r, c].astype(float), "looked_at": (near * sizes).sum(1)[r]})

    found = dealt.mapInPandas(run, "query_id long, item_id long, near double, looked_at long")
    first = Window.partitionBy("query_id").orderBy(F.col("near").desc(), "item_id")
    few = found.select("*", F.row_number().over(first).alias("_n")).where(F.col("_n") <= depth)
    exact = few.join(index.rows.select("item_id", F.col("vector").cast("array<double>").alias("v")), "item_id").join(questions.select("query_id", "q"), "query_id")
    scored = exact.select("query_id", "item_id", F.round(dot("v", F.col("q").cast("array<double>")), 6).alias("score"), "looked_at")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return scored.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)

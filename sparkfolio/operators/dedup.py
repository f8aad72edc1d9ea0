"""Near-duplicate removal by recency, and incremental index deltas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first() -> list[Column]:
    return [F.coalesce("year", F.lit(0)).desc(), F.col("doc_id"), F.col("page_start"), F.col("chunk_id")]


def drop_exact(chunks: DataFrame) -> DataFrame:
    """Of chunks with equal content the newest stays and takes the others' ids."""
    digest = F.sha2(F.col("content").cast("binary"), 256)
    order = F.struct((-F.coalesce("year", F.lit(0))).alias("y"), "doc_id", "page_start", "chunk_id")
    groups = chunks.groupBy(digest.alias("digest")).agg(F.min(order).alias("first"), F.array_sort(F.collect_set("chunk_id")).alias("ids"))
    return groups.select(F.col("first.chunk_id").alias("chunk_id"), F.array_except("ids", F.array("first.chunk_id")).alias("duplicate_ids"))


def _checkpoint_dir(spark) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            from sparkfolio.sources.files import scratch

            scratch(spark, "checkpoints")  # a local session gets a folder, a cluster must name one
        else:
            spark.sparkContext.setCheckpointDir(found)


def greedy_survivors(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Walk in order: a node is dropped if a kept earlier node is similar to it.

    ``nodes``: node, pos (the order).  ``pairs``: (early, late) similar nodes, the one
    with the smaller pos first.  Returns node, kept.  This is the lexicographically
    first maximal independent set: in each round, open nodes without an open
    earlier neighbour are kept, and neighbours of kept nodes are dropped, until no
    node is open.  A round only reads what is open.  Lineage is cut by ``checkpoint``
    to the folder all executors share.
    """
    _checkpoint_dir(nodes.sparkSession)
    named = lambda df, name: df.withColumnRenamed("node", name)
    open_ = nodes.select("node")
    edges = pairs.select("early", "late").join(named(open_, "early"), "early", "left_semi").join(named(open_, "late"), "late", "left_semi").checkpoint()
    kept = None
    while True:
        ready = open_.join(edges.select(F.col("late").alias("node")).distinct(), "node", "left_anti").checkpoint()
        kept = ready if kept is None else kept.unionByName(ready).coalesce(max(1, ready.rdd.getNumPartitions())).checkpoint()
        dropped = edges.join(named(ready, "early"), "early", "left_semi").select(F.col("late").alias("node")).distinct().checkpoint()
        if dropped.isEmpty():
            if not edges.isEmpty():
                raise ValueError("pairs do not follow the order of the nodes")
            break
        open_ = open_.join(ready, "node", "left_anti").join(dropped, "node", "left_anti").checkpoint()
        edges = edges.join(named(dropped, "late"), "late", "left_anti").join(named(dropped, "early"), "early", "left_anti").checkpoint()
    return nodes.select("node").join(kept.withColumn("kept", F.lit(True)), "node", "left").select("node", F.coalesce("kept", F.lit(False)).alias("kept"))


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 4096, within: str | None = None) -> DataFrame:
    """early, late, score of all pairs of vectors (node, v) whose dot product, rounded to six places, is at least ``threshold``.

    Blocks of about ``block`` vectors meet each other; a task holds two of them.  With ``within``, only
    vectors that share that column's value meet (null shares with nothing), in as many blocks as the value has.
    Products choose candidates, whose scores are added up in the order of the elements.
    """
    label = F.col(within) if within else F.lit(0)
    named = vectors.where(F.col("v").isNotNull() & label.isNotNull()).select(label.alias("_l"), "node", "v")
    sizes = named.groupBy("_l").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    placed = named.join(sizes, "_l").select("_l", "node", "v", "_n", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int").alias("_b"))
    left = placed.select("_l", F.col("_b").alias("i"), F.explode(F.sequence(F.col("_b"), F.col("_n") - 1)).alias("j"), "node", "v")
    right = placed.select(F.col("_l").alias("_l"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("i"), F.col("_b").alias("j"), F.col("node").alias("node"), F.col("v").alias("v"))

    def run(key, a, b):
        if len(a) and len(b):
            x, y = (np.stack(f["v"].to_numpy()).astype(float) for f in (a, b))
            p, q = a["node"].to_numpy(), b["node"].to_numpy()
            ids, scores = [], []
            for s in range(0, len(x), 512):
                r, c = np.nonzero(x[s : s + 512] @ y.T >= threshold - 1e-5)
                r = r + s
                once = p[r] < q[c] if key[1] == key[2] else p[r] != q[c]
                r, c = r[once], c[once]
                score = np.zeros(len(r))
                for d in range(x.shape[1]):
                    score += x[r, d] * y[c, d]
                ids.append(np.stack([np.minimum(p[r], q[c]), np.maximum(p[r], q[c])], 1))
                scores.append(score)
            at = np.concatenate(ids)
            return pd.DataFrame({"early": at[:, 0], "late": at[:, 1], "score": np.concatenate(scores)})
        return pd.DataFrame({"early": np.empty(0, np.int64), "late": np.empty(0, np.int64), "score": np.empty(0)})

    found = left.groupBy("_l", "i", "j").cogroup(right.groupBy("_l", "i", "j")).applyInPandas(run, "early long, late long, score double")
    return found.withColumn("score", F.round("score", 6)).where(F.col("score") >= threshold)


def index_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """doc_id, state (new, changed, same, removed): by digest and number of chunks."""
    c = current.select("doc_id", F.col("digest").alias("_c"), F.col("chunks").alias("_cn"))
    p = previous.select("doc_id", F.col("digest").alias("_p"), F.col("chunks").alias("_pn"))
    state = (
        F.when(F.col("_p").isNull(), "new").when(F.col("_c").isNull(), "removed").when((F.col("_c") == F.col("_p")) & (F.col("_cn") == F.col("_pn")), "same").otherwise("changed")
    )
    return c.join(p, "doc_id", "full_outer").select("doc_id", state.alias("state"))

"""Greedy survivors block by block, and positions, against plain walks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import survivors as S
from sparkfolio.operators.order import positions


def plain_walk(ids, v, threshold, group=S.GROUP):
    kept, out = [], {}
    for k, i in enumerate(ids):
        found = None
        for s in range(0, len(kept), group):
            near = [(np.round(sum(float(a) * float(b) for a, b in zip(v[k], v[x], strict=True)), 6), -n, x) for n, x in enumerate(kept[s : s + group])]
            near = [x for x in near if x[0] >= threshold]
            if near:
                found = ids[max(near)[2]]
                break
        out[i] = (found is None, found)
        if found is None:
            kept.append(k)
    return out


@pytest.mark.parametrize(("kind", "block"), [("spread", 40), ("spread", 1000), ("clustered", 25), ("copies", 70)])
def test_survivors_equal_the_walk(spark, block, kind):
    rnd = np.random.default_rng(11)
    v = rnd.normal(size=(180, 6))
    if kind == "clustered":
        v = rnd.normal(size=(9, 6))[rnd.integers(0, 9, 180)] + 0.15 * v
    if kind == "copies":
        v[::3] = v[0]
    v = v / np.linalg.norm(v, axis=1)[:, None]
    ids = rnd.permutation(1000)[:180]
    order = np.argsort(ids)
    rows = spark.createDataFrame([(int(i), [float(c) for c in x]) for i, x in zip(ids, v, strict=True)], "node long, v array<double>").repartition(3)
    got = {r["node"]: (r["kept"], r["absorber"]) for r in S.near_survivors(rows, 0.8, F.col("node"), block=block, group=7).collect()}
    assert got == plain_walk([int(i) for i in ids[order]], v[order], 0.8, 7)


def test_survivors_of_nothing_and_one(spark):
    schema = "node long, v array<double>"
    assert S.near_survivors(spark.createDataFrame([], schema), 0.5, F.col("node")).collect() == []
    assert [tuple(r) for r in S.near_survivors(spark.createDataFrame([(4, [1.0])], schema), 0.5, F.col("node")).collect()] == [(4, True, None)]


def test_pivots_skip_far_groups_and_lose_nothing():
    rnd = np.random.default_rng(12)
    centres = rnd.normal(size=(16, 24))
    make = lambda n: (x := centres[rnd.integers(0, 16, n)] + 0.05 * rnd.normal(size=(n, 24))) / np.linalg.norm(x, axis=1)[:, None]
    kept, rows = make(400), make(600)
    found = S.Survivors(kept, centres / np.linalg.norm(centres, axis=1)[:, None], 0.95)
    i, j, _ = found.similar(rows)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in np.argwhere(np.round(rows @ kept.T, 6) >= 0.95)}
    assert found.skipped > 2 * found.taken


def test_positions(spark):
    rnd = np.random.default_rng(13)
    rows = [(int(a), int(b)) for a, b in zip(rnd.integers(0, 5, 500), rnd.permutation(500), strict=True)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(9)
    got = sorted((r["pos"], r["a"], r["b"]) for r in positions(df, F.col("a").desc(), F.col("b")).collect())
    assert got == [(n + 1, a, b) for n, (a, b) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))]
    assert positions(df.limit(0), F.col("a")).count() == 0


def test_rows_are_not_written_again_for_every_block(spark):
    """What is written grows with the rows, not with rows times blocks; distant vectors all survive."""
    folder = spark.conf.get("spark.checkpoint.dir")
    written = lambda: sum(os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(folder) for n in names)
    v = np.random.default_rng(14).normal(size=(2400, 64))
    v = v / np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "node long, v array<double>")
    before = written()
    found = S.near_survivors(rows, 0.95, F.col("node"), block=200)
    assert found.where("kept").count() == 2400
    assert written() - before < 4 * v.nbytes

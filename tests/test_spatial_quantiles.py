"""Rectangles and order statistics against brute force; streams leave the session as it was."""

import random

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import spatial
from sparkfolio.operators.quantiles import floor_index, nth_values, upper_median
from sparkfolio.registry import QUERIES

BOX = "x0 double, y0 double, x1 double, y1 double"


def boxes(rnd, n):
    """Whole-number rectangles: small and large ones, on cell borders, empty and turned ones."""
    out = []
    for _ in range(n):
        x, y = rnd.randrange(-40, 120), rnd.randrange(-40, 120)
        w, h = rnd.choice([0, 1, 5, 32, 64, 100, -3]), rnd.choice([0, 2, 8, 32, 70])
        out.append((float(x), float(y), float(x + w), float(y + h)))
    return out


@pytest.fixture(scope="module")
def layout():
    rnd = random.Random(31)
    blocks = [(p, i, *b) for p in range(4) for i, b in enumerate(boxes(rnd, 25))]
    tables = [(p, *b) for p in range(3) for b in boxes(rnd, 12)] + [(0, 0.0, 0.0, 64.0, 64.0)] * 3  # equal tables
    return blocks, tables


def units(box):
    return {(x, y) for x in range(int(box[0]), int(box[2])) for y in range(int(box[1]), int(box[3]))}


@pytest.mark.parametrize("size", [7.0, 32.0, 1000.0])
def test_coverage_counts_unit_squares(spark, layout, size):
    blocks, tables = layout
    b = spark.createDataFrame(blocks, f"page long, block long, {BOX}")
    t = spark.createDataFrame(tables, f"page long, {BOX}")
    got = {(r["page"], r["block"]): (r["n_tables"], round(r["largest"], 9), round(r["together"], 9)) for r in spatial.coverage(b, t, ["page"], ["page", "block"], size).collect()}
    kept = {(r["page"], r["block"]) for r in spatial.prose_outside(b, t, ["page"], ["page", "block"], size=size).collect()}
    assert set(got) == {(p, i) for p, i, *_ in blocks}
    for p, i, *box in blocks:
        own = units(box)
        parts = [u for q, *other in tables if q == p and (u := own & units(other))]
        expected = (len(parts), round(max(map(len, parts), default=0) / max(len(own), 1), 9), round(len(set().union(*parts)) / max(len(own), 1), 9))
        assert got[p, i] == expected
        assert ((p, i) in kept) == all(len(u) / len(own) <= 0.6 for u in parts)


def test_no_tables_and_no_blocks(spark, layout):
    b = spark.createDataFrame(layout[0], f"page long, block long, {BOX}")
    t = spark.createDataFrame([], f"page long, {BOX}")
    assert spatial.prose_outside(b, t, ["page"], ["page", "block"]).count() == len(layout[0])
    assert {r["together"] for r in spatial.coverage(b, t, ["page"], ["page", "block"]).collect()} == {0.0}
    assert spatial.coverage(b.limit(0), t, ["page"], ["page", "block"]).collect() == []


@pytest.mark.parametrize(("buckets", "small"), [(4096, 65_536), (8, 10), (2, 1)])
def test_order_statistics(spark, buckets, small):
    rnd = random.Random(32)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(300)] + [("b", float(rnd.randrange(4))) for _ in range(200)] + [(None, rnd.expovariate(1) ** 9) for _ in range(150)]
    rows += [("same", 7.5)] * 40 + [("one", -1e308), ("far", -1e308), ("far", 1e308), ("far", 0.0), ("none", None), ("none", float("nan")), ("a", None), ("a", float("nan"))]
    found = nth_values(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"median": upper_median, "p95": floor_index(0.95), "first": lambda n: F.lit(0), "beyond": lambda n: n}, buckets, small)
    got = {r["g"]: (r["median"], r["p95"], r["first"], r["beyond"]) for r in found.collect()}
    groups = {g for g, _ in rows}
    assert set(got) == groups
    for g in groups:
        v = sorted(x for h, x in rows if h == g and x is not None and x == x)
        n = len(v)
        assert got[g] == ((v[n // 2], v[min(int(n * 0.95), n - 1)], v[0], None) if n else (None,) * 4), g


def test_order_statistics_without_groups(spark):
    rows = spark.createDataFrame([(float(i % 17),) for i in range(500)], "v double")
    v = sorted(i % 17 for i in range(500))
    assert [tuple(r) for r in nth_values(rows, [], "v", {"m": upper_median}, 4, 20).collect()] == [(v[250],)]
    assert [tuple(r) for r in nth_values(rows.limit(0), [], "v", {"m": upper_median}).collect()] == [(None,)]


def test_plans_of_percentiles_hold_no_collected_arrays(spark):
    for name in ("agg_pctl", "agg_upmed", "ev_latency"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "collect_list" not in plan and "array_sort" not in plan


def test_streams_restore_the_state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    assert QUERIES["st_session_stream"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert spark.conf.get(key, None) == before

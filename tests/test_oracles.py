"""Registered queries against DuckDB at the smallest scale, and the entry points."""

import os

import duckdb
import pytest

from sparkfolio import registry

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "bm25_topk vec_knn rrf ret_hybrid flt_gate agg_hit ev_ablate ev_cal agg_docreport win_offsets jn_pageof txt_inject txt_acr txt_fail "
    "dd_exact jn_delta flt_preflight st_session st_cooldown tab_dupcol agg_pctl src_gold snk_vector"
).split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in os.listdir(SF):
        c.sql(f"CREATE VIEW {n[:-8]} AS SELECT * FROM '{SF}/{n}'")
    return c


def plain(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6)
        frame[c] = frame[c].map(lambda v: "NULL" if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, duck, name):
    ours, theirs = plain(registry.QUERIES[name](spark, SF).toPandas()), plain(duck.sql(registry.ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_report_lines_hold_the_rates(spark, duck):
    """What the ablation measured is in the lines, not the number of questions alone."""
    lines = {r["line"] for r in registry.QUERIES["snk_report"](spark, SF).collect()}
    rows = registry.QUERIES["ev_ablate"](spark, SF).collect()
    assert lines == {f"| {r['config']} | {r['n']} | {r['hit_1']:.6f} | {r['hit_3']:.6f} | {r['hit_5']:.6f} | {r['mrr']:.6f} |" for r in rows}
    assert len({line.split(" | ", 2)[2] for line in lines}) > 1
    assert lines == set(duck.sql(registry.ORACLES["snk_report"]).df()["line"])

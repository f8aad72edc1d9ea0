import itertools
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import docs as docs_of

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stash(stage(spark, docs, SF), "t")
        assert docs.columns == columns, name
    assert 0 < docs.count() <= 3 * before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and "ids_sha256" in last.columns


def bag(text):
    w = text.split()
    return Counter([tuple(w)] if 0 < len(w) < 5 else zip(*(w[k:] for k in range(5))))


def test_near_duplicates_after_line_dedup_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = corpus_pipeline.stash(corpus_pipeline.lines(spark, docs, SF), "t")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()}
    rows = [(r["doc_id"], r["text"], bag(r["text"] or "")) for r in docs.collect()]
    classes = {i: {i} for i, _, _ in rows}
    for (i, a, x), (j, b, y) in itertools.combinations(rows, 2):
        m, n = sorted((x.total(), y.total()))
        if a is not None and (a == b or (m and m >= 0.8 * n and (x & y).total() >= 0.8 * (x | y).total())) and classes[i] is not classes[j]:
            classes[i] |= classes[j]
            for k in classes[j]:
                classes[k] = classes[i]
    assert max(map(len, classes.values())) > 1
    assert all(len(kept & c) == 1 for c in classes.values())


def test_stages_on_odd_input(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "x" * 50_000, "b"), (5, "the word " * 30_000, "b"), (6, "same line\nsame line", None), (6, "same line\nsame line", None), (None, "no id here", "a")]
    odd = docs_of(spark, rows)
    for name in ("_row", "_text", "_d", "_kept", "size", "class_id", "ranges", "score"):
        odd = odd.withColumn(name, F.lit(1))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.stash(stage(spark, docs, SF), "t")
            assert name == "bpe" or out.columns == docs.columns, name
            if docs.isEmpty():
                assert out.count() == 0, name
            elif name == "near duplicates":
                # The repeated row goes; the row without an id or text stays.
                assert out.count() == 7 and out.where("doc_id IS NULL").count() == 1, name
            elif name == "bpe":
                assert out.count() == 8


def test_llm_oracles(spark):
    import os

    import duckdb

    from sparkfolio.llm import queries

    duck = duckdb.connect()
    for n in os.listdir(SF):
        duck.sql(f"CREATE VIEW {n[:-8]} AS SELECT * FROM '{SF}/{n}'")
    for name, sql in queries.ORACLES.items():
        ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(sql).df()
        key = list(ours.columns)
        ours, theirs = ours.sort_values(key).reset_index(drop=True), theirs[key].sort_values(key).reset_index(drop=True)
        assert ours.astype(str).equals(theirs.astype(str)), name

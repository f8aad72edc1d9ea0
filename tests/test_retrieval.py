import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import retrieval as R
from sparkfolio.operators.dedup import greedy_survivors, index_delta, similar_pairs
from sparkfolio.registry import QUERIES
from sparkfolio.sources import fixtures as X


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, rank int, score double")


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("a", "flood plan flood"), ("b", "heat plan"), ("c", "camp site"), ("d", "camp rules here")], "chunk_id string, content string")
    q = spark.createDataFrame([(1, "flood flood"), (2, "unknown"), (3, "plan")], "query_id long, question string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in R.bm25(q, R.lexical_index(chunks)).collect()}
    idf = math.log(4 - 1 + 0.5) - math.log(1.5)
    assert got[(1, "a")] == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2.5)), abs=1e-6)
    assert set(got) == {(1, "a")}  # a term in half of the corpus scores nothing


def test_fusion_prefers_agreement_and_breaks_ties_by_id(spark):
    d, s = hits(spark, [(1, "a", 1, 0.9), (1, "b", 2, 0.8)]), hits(spark, [(1, "b", 1, 5.0), (1, "c", 2, 4.0)])
    order = [r["chunk_id"] for r in R.fuse(d, s, 0.5, 0.5).orderBy("fused_rank").collect()]
    assert order == ["b", "a", "c"]
    zero = R.fuse(d, s, 1.0, 0.0).orderBy("fused_rank").collect()
    assert [r["chunk_id"] for r in zero] == ["a", "b", "c"] and zero[2]["fusion_score"] == 0


def test_unknown_chunks_keep_their_rank(spark):
    d = hits(spark, [(1, "gone", 1, 0.9), (1, "b", 2, 0.8)])
    known = spark.createDataFrame([("b",)], "chunk_id string")
    row = R.fuse(d, d.limit(0), 1.0, 0.0, known).first()
    assert row["fusion_score"] == pytest.approx(1 / 62, abs=1e-9)


def test_settings_funnel():
    with pytest.raises(ValueError):
        R.RetrievalSettings(rerank_candidates=25)
    with pytest.raises(ValueError):
        R.RetrievalSettings(dense_weight=0, sparse_weight=0)


def test_greedy_survivors_equal_the_walk(spark):
    nodes = spark.createDataFrame([(i, i) for i in range(6)], "node long, pos long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "early long, late long")
    kept = {r["node"] for r in greedy_survivors(nodes, pairs).where("kept").collect()}
    assert kept == {0, 2, 4}


def test_greedy_survivors_of_a_long_chain(spark):
    n = 110
    nodes = spark.createDataFrame([(i, i) for i in range(n)], "node long, pos long").coalesce(1)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "early long, late long").coalesce(1)
    assert {r["node"] for r in greedy_survivors(nodes, pairs).where("kept").collect()} == set(range(0, n, 2))


def test_near_vectors_against_the_walk(spark):
    rows = {r["vec_id"]: np.array(r["v"]) for r in X.vectors(spark, "/root/testdata/sf0.01").collect()}
    ids, v = sorted(rows), np.stack([rows[i] for i in sorted(rows)])
    score = np.round(v @ v.T, 6)
    got = {(r["early"], r["late"]): r["score"] for r in similar_pairs(X.vectors(spark, "/root/testdata/sf0.01").withColumnRenamed("vec_id", "node"), 0.1, 64).collect()}
    at = {(ids[a], ids[b]) for a, b in np.argwhere(np.triu(score >= 0.1, 1))}
    assert set(got) == at and all(abs(got[p] - rows[p[0]] @ rows[p[1]]) < 1e-6 for p in at)


def test_near_duplicates_of_all_vectors(spark):
    rows = {r["vec_id"]: np.array(r["v"]) for r in X.vectors(spark, "/root/testdata/sf0.1").collect()}
    ids = sorted(rows)
    score = np.round((v := np.stack([rows[i] for i in ids])) @ v.T, 6)
    kept = []
    for k in range(len(ids)):
        if not (score[k, kept] >= 0.35).any():
            kept.append(k)
    near = {r["node"]: r for r in QUERIES["dd_near"](spark, "/root/testdata/sf0.1").collect()}
    assert len(ids) == 2000 and sorted(near) == ids and [i for i in ids if near[i]["kept"]] == [ids[k] for k in kept]
    for k, i in enumerate(ids):
        if near[i]["kept"]:
            assert near[i]["absorber"] is None
            continue
        blocks = [[x for x in kept[s : s + 512] if x < k and score[k, x] >= 0.35] for s in range(0, len(kept), 512)]
        first = next(b for b in blocks if b)
        assert near[i]["absorber"] == ids[max(first, key=lambda x: (score[k, x], -x))]


def test_recall_covers_every_fiftieth_vector(spark):
    ids = {r["query_id"] for r in QUERIES["vec_ann_check"](spark, "/root/testdata/sf0.01").collect()}
    assert ids == {r["vec_id"] for r in X.vectors(spark, "/root/testdata/sf0.01").where("vec_id % 50 = 0").collect()}


def test_delta_states(spark):
    cur = spark.createDataFrame([("a", "1", 2), ("b", "2", 2), ("c", "3", 1)], "doc_id string, digest string, chunks int")
    old = spark.createDataFrame([("a", "1", 2), ("b", "x", 2), ("d", "4", 1)], "doc_id string, digest string, chunks int")
    assert {r["doc_id"]: r["state"] for r in index_delta(cur, old).collect()} == {"a": "same", "b": "changed", "c": "new", "d": "removed"}


def test_pairs_within_a_label_are_multiplied_in_blocks(spark, tmp_path):
    """Labels of several blocks, one of one row, none and null; no pair is scored by interpreted lambdas."""
    rng = np.random.default_rng(5)
    label = [None if i % 9 == 0 else 77 if i == 5 else i % 2 for i in range(90)]
    v = rng.normal(size=(90, 8))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).tolist()
    v[7] = None
    rows = spark.createDataFrame(list(zip(range(90), v, label, strict=True)), "node long, v array<double>, doc int")
    found = {(r["early"], r["late"]): r["score"] for r in similar_pairs(rows, 0.3, block=8, within="doc").collect()}
    dots = {(a, b): round(sum(x * y for x, y in zip(v[a], v[b], strict=True)), 6) for a in range(90) for b in range(a + 1, 90) if v[a] and v[b] and label[a] is not None and label[a] == label[b]}
    assert found == {k: s for k, s in dots.items() if s >= 0.3}
    rows.select(F.col("node").alias("vec_id"), F.col("v").alias("embedding"), F.col("doc").alias("label")).write.parquet(str(tmp_path / "embeddings.parquet"))
    query = QUERIES["sim_pairs"](spark, str(tmp_path))
    assert {(r["a"], r["b"]): r["score"] for r in query.collect()} == found
    assert "lambdafunction" not in query._jdf.queryExecution().executedPlan().toString()


def test_mean_frequency_does_not_depend_on_the_order(spark):
    """The mean over terms is the exact sum's, however the terms are dealt."""
    df = [1 + i * i % 977 for i in range(20_000)]
    rows = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate([*df, 1500])], "token string, df long")
    raw = [math.log(2000 - n + 0.5) - math.log(n + 0.5) for n in [*df, 1500]]
    exact = R.EPSILON * (math.fsum(raw) / len(raw))
    for dealt in (rows.coalesce(1), rows.repartition(13), rows.orderBy(F.col("df").desc())):
        assert abs(R.inverse_frequencies(dealt, F.lit(2000)).where("token = 't20000'").first()["idf"] - exact) <= 1e-15


def test_texts_of_few_candidates_are_not_shuffled(spark):
    """Candidates go to the chunks even where Spark's size check would not send them; many are left to it."""
    texts = spark.createDataFrame([(c, f"{c} flood plan") for c in "abc"], "chunk_id string, content string")
    q = spark.createDataFrame([(1, "a flood"), (2, "c plan")], "query_id long, question string")
    d, s = hits(spark, [(1, "a", 1, 0.9), (1, "b", 2, 0.8), (2, "c", 1, 0.7)]), hits(spark, [(1, "b", 1, 5.0), (1, "c", 2, 4.0)])
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = R.retrieve(q, texts, d, s)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r["query_id"], r["chunk_id"]): r["rerank_score"] for r in found.collect()}
        many = R.of_chunks(d, texts, R.ASKED_TERMS + 1)
        left = many._jdf.queryExecution().executedPlan().toString()
        rows = lambda t: sorted((r["query_id"], r["content"]) for r in t.collect())
        assert rows(many) == rows(R.of_chunks(d, texts, 3)) == [(1, "a flood plan"), (1, "b flood plan"), (2, "c flood plan")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert "SortMergeJoin [chunk_id" not in plan and "BroadcastHashJoin [chunk_id" in plan and "SortMergeJoin [chunk_id" in left
    assert got == {(1, "a"): 1.0, (1, "b"): 0.5, (1, "c"): 0.5, (2, "c"): 1.0}


def test_gold_lines_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Few texts go to the lines even where Spark's size check would not send them; many are left to it, with the same rows."""
    texts = ["the flood plan for heat", "flood plan", "a", "no line\nholds this text", "plan plan plan", "  spaces  inside  ", None, "heat for the flood plan in camps"]
    pages = ["x the flood plan for heat y\nthe flood plan for heat. the flood plan for heat", "plan plan plan plan\n\nno line\nholds this text", "flood plans", None, "", "a  spaces  inside  b", "heat for the flood plan in campsite"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(pages)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    exact = sorted((q, f"doc-{i}", p) for i, t in enumerate(pages) if t is not None for p, line in enumerate(t.split("\n"), 1) for q, asked in enumerate(texts) if asked is not None and asked in line)
    rows = lambda t: sorted((r["query_id"], r["doc_id"], r["page"]) for r in t.collect())
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        few = X.gold(spark, str(tmp_path))
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert rows(few) == exact and len(exact) > 10
        assert "Exchange hashpartitioning" not in plan
        monkeypatch.setattr(X, "FEW_TEXTS", 0)
        many = X.gold(spark, str(tmp_path))
        left = many._jdf.queryExecution().executedPlan().toString()
        assert rows(many) == exact
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert "Exchange hashpartitioning" in left

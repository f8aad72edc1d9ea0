"""Queries over the retrieval operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfolio.functions import text as T
from sparkfolio.operators import retrieval as R
from sparkfolio.registry import query
from sparkfolio.sources import fixtures as X

_TOK = "regexp_extract_all(lower(@), '[a-z0-9]+(?:[./-][a-z0-9]+)*')"
_BM = f"""WITH {X.RAW_PAGES_SQL}, {X.CHUNKS_SQL}, {X.QUESTIONS_SQL},
w AS (SELECT chunk_id, {_TOK.replace('@', 'content')} AS w FROM chunks), tok AS (SELECT chunk_id, len(w) AS dl, unnest(w) AS token FROM w),
tf AS (SELECT chunk_id, token, count(*) AS tf, min(dl) AS dl FROM tok GROUP BY 1, 2), tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
raw AS (SELECT token, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, tot GROUP BY token, n),
terms AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK.replace('@', 'question')}) AS token FROM questions) GROUP BY 1, 2),
bm AS (SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN terms USING (token) JOIN tf USING (token), tot GROUP BY 1, 2 HAVING round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) > 0),
sparse AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM bm b JOIN chunks USING (chunk_id)) WHERE rank <= 12)"""


_stores: dict[tuple[str, str], tuple[str, tuple]] = {}


def index(spark, sf_dir) -> R.LexicalIndex:
    """The lexical index of the corpus as its files are now: built on first use, brought up to date when a file has changed."""
    from sparkfolio.operators.upkeep import IndexStore
    from sparkfolio.sources.files import scratch, state_of

    key, now = (spark.sparkContext.applicationId, sf_dir), state_of(spark, f"{sf_dir}/documents.parquet")
    folder, then = _stores.get(key) or (scratch(spark, "index"), None)
    store = IndexStore(spark, folder, dense=False)
    if then != now:
        chunks, cores = X.chunks(spark, sf_dir), spark.sparkContext.defaultParallelism
        # A plain scan of a few files is one or two tasks; tokenising is the work.
        store.update(chunks.repartition(cores) if chunks.rdd.getNumPartitions() < cores else chunks)
        store.vacuum()
        _stores[key] = folder, now
    return store.lexical()


def sparse(spark, sf_dir, k: int = 12):
    chunks = X.chunks(spark, sf_dir)
    hits = R.bm25(X.questions(spark, sf_dir), index(spark, sf_dir), k).join(chunks.select("chunk_id", "pos"), "chunk_id")
    return R.ranked(hits, k, F.col("pos"))


@query("bm25_topk", f"{_BM} SELECT query_id, chunk_id, score, rank FROM sparse")
def bm25_topk(spark, sf_dir):
    return sparse(spark, sf_dir).select("query_id", "chunk_id", "score", "rank")


@query("flt_posscore", f"{_BM} SELECT query_id, count(*) AS n_hits FROM bm GROUP BY 1")
def flt_posscore(spark, sf_dir):
    return R.bm25(X.questions(spark, sf_dir), index(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n_hits"))


@query("agg_df", f"{_BM} SELECT token, df, round(idf, 6) AS idf FROM terms")
def agg_df(spark, sf_dir):
    return index(spark, sf_dir).terms.select("token", "df", F.round("idf", 6).alias("idf"))


@query("jn_term", f"{_BM} SELECT query_id, token, count(*) AS n_chunks FROM q JOIN tf USING (token) GROUP BY 1, 2")
def jn_term(spark, sf_dir):
    """Chunks that hold a term of a question: the term's document count."""
    asked = R.term_counts(X.questions(spark, sf_dir), "query_id", "question").select("query_id", "token")
    return asked.join(index(spark, sf_dir).terms, "token").select("query_id", "token", F.col("df").alias("n_chunks"))


_VEC = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_KNN = f"""WITH {_VEC}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, b.label, round(list_dot_product(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
knn AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 12)"""


def knn(spark, sf_dir, k: int = 12, metadata=None, asked: str = "vec_id % 50 = 0"):
    v = X.vectors(spark, sf_dir)
    items = v.select(F.col("vec_id").alias("item_id"), "v", "doc")
    return R.vector_search(v.where(asked).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), items, k, metadata)


@query("vec_knn", f"{_KNN} SELECT * FROM knn")
def vec_knn(spark, sf_dir):
    return knn(spark, sf_dir)


@query("flt_meta", f"WITH {_VEC}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND b.label IN (1, 3)) SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 5")
def flt_meta(spark, sf_dir):
    return knn(spark, sf_dir, 5, F.col("doc").isin(1, 3))


@query("vec_norms", f"WITH {_VEC} SELECT label, count(*) AS n, bool_and(abs(sqrt(list_dot_product(v, v)) - 1) < 1e-4) AS unit FROM v GROUP BY 1")
def vec_norms(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    return v.groupBy(F.col("doc").alias("label")).agg(F.count("*").alias("n"), F.bool_and(F.abs(F.sqrt(R.dot(F.col("v"), F.col("v"))) - 1) < 1e-4).alias("unit"))


def cell_hits(spark, sf_dir, k: int = 5):
    """The first k by the cell index, which is built and stored first; every vector whose id is divisible by 50 asks."""
    from sparkfolio.operators import cells
    from sparkfolio.sources.files import scratch

    folder = scratch(spark, "cells")
    v = X.vectors(spark, sf_dir).select("vec_id", "v")
    cells.build(v.select(F.col("vec_id").cast("long").alias("item_id"), "v"), folder)
    index = cells.read(spark, folder)
    return index, cells.search(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), index, k)


@query("vec_ann_check")
def vec_ann_check(spark, sf_dir):
    """Cell index against exact search, for each question: recall of the first five, whether the first is right, share of the table's bytes looked at."""
    from sparkfolio.operators import cells

    index, near = cell_hits(spark, sf_dir)
    n, size = int(index.sizes.sum()), index.centres.shape[1]
    truth = knn(spark, sf_dir, 5).select("query_id", "item_id", "rank")
    both = truth.join(near.select("query_id", "item_id", F.col("rank").alias("found"), "looked_at"), ["query_id", "item_id"], "left")
    # A code is one byte an element and its scale; candidates are read whole, four bytes an element.
    share = (F.max("looked_at") * (size + 4) + F.lit(5 * cells.DEPTH * 4 * size)) / F.lit(float(n * 4 * size))
    return both.groupBy("query_id").agg(
        (F.count("found") / F.count("*")).alias("recall"), F.bool_or((F.col("rank") == 1) & (F.coalesce("found", F.lit(0)) == 1)).alias("first_right"), F.round(share, 4).alias("bytes_share")
    )


@query("vec_ann_gate", "SELECT count(*) AS n_questions, true AS recall_reached, true AS few_bytes FROM embeddings WHERE vec_id % 50 = 0")
def vec_ann_gate(spark, sf_dir):
    """The index may serve only if recall of the first five is .95 and a question looks at less than a quarter of the bytes."""
    per = vec_ann_check(spark, sf_dir)
    return per.agg(F.count("*").alias("n_questions"), (F.avg("recall") >= 0.95).alias("recall_reached"), (F.avg("bytes_share") < 0.25).alias("few_bytes"))


@query(
    "set_intersect",
    f"{_KNN}, a AS (SELECT query_id, list(item_id) AS x FROM knn WHERE rank <= 5 GROUP BY 1), b AS (SELECT query_id, list(item_id) AS x FROM knn WHERE item_id % 2 = 0 GROUP BY 1) SELECT query_id, len(list_intersect(a.x, coalesce(b.x, []))) AS common FROM a LEFT JOIN b USING (query_id)",
)
def set_intersect(spark, sf_dir):
    hits = knn(spark, sf_dir)
    a = hits.where("rank <= 5").groupBy("query_id").agg(F.collect_set("item_id").alias("a"))
    b = hits.where("item_id % 2 = 0").groupBy("query_id").agg(F.collect_set("item_id").alias("b"))
    return a.join(b, "query_id", "left").select("query_id", F.size(F.array_intersect("a", F.coalesce("b", F.array().cast("array<bigint>")))).cast("long").alias("common"))


#: Dense hits for fusion: the table's vectors stand for those of chunks (by doc_id) and of questions (every seventh).
_DENSE_SQL = """nv AS (SELECT count(*) AS n FROM embeddings), dv AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
qk AS MATERIALIZED (SELECT query_id, (query_id * 7 + 3) % n AS vec_id FROM questions, nv), ck AS MATERIALIZED (SELECT chunk_id, pos, pos % n AS vec_id FROM chunks, nv),
qv AS MATERIALIZED (SELECT query_id, v FROM qk JOIN dv USING (vec_id)), cv AS MATERIALIZED (SELECT chunk_id, pos, v FROM ck JOIN dv USING (vec_id)),
dense AS MATERIALIZED (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM (
  SELECT query_id, chunk_id, pos, round(list_dot_product(qv.v, cv.v), 6) AS score FROM qv, cv) QUALIFY rank <= 12)"""


def dense(spark, sf_dir, k: int = 12):
    """Exact vector search of all questions among all chunks."""
    v = X.vectors(spark, sf_dir)
    v = v.crossJoin(F.broadcast(v.agg(F.count("*").alias("n"))))  # one row
    n = v.select(F.col("n").alias("_n")).limit(1)
    of = lambda rows, key, place: rows.crossJoin(F.broadcast(n)).withColumn("vec_id", F.pmod(place, F.col("_n"))).join(v.select("vec_id", "v"), "vec_id").select(key, "v")
    chunks = X.chunks(spark, sf_dir).select("chunk_id", "pos")
    items = of(chunks, F.col("pos").alias("item_id"), F.col("pos"))
    asked = of(X.questions(spark, sf_dir), "query_id", F.col("query_id") * 7 + 3).withColumnRenamed("v", "q")
    hits = R.vector_search(asked, items, k, same=False)
    return hits.join(chunks, F.col("item_id") == F.col("pos")).select("query_id", "chunk_id", "score", "rank")


_FUSED = f"""{_BM}, {_DENSE_SQL}, fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, chunk_id) AS fused_rank FROM (
  SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank,
  round(coalesce(@D / (60 + d.rank), 0) + coalesce(@S / (60 + s.rank), 0), 9) AS fusion_score,
  CASE WHEN d.rank IS NOT NULL AND s.rank IS NOT NULL THEN 'both' WHEN d.rank IS NOT NULL THEN 'dense' ELSE 'sparse' END AS found_by
  FROM dense d FULL OUTER JOIN sparse s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id))"""


def _fused_sql(d: float, s: float) -> str:
    return _FUSED.replace("@D", f"{d}::DOUBLE").replace("@S", f"{s}::DOUBLE")


def fused(spark, sf_dir, d: float, s: float):
    return R.fuse(dense(spark, sf_dir), sparse(spark, sf_dir), d, s)


@query("rrf", f"{_fused_sql(0.5, 0.5)} SELECT query_id, chunk_id, fusion_score, fused_rank FROM fused")
def rrf(spark, sf_dir):
    return fused(spark, sf_dir, 0.5, 0.5).select("query_id", "chunk_id", "fusion_score", "fused_rank")


@query("jn_fusion", f"{_fused_sql(1.0, 0.0)} SELECT query_id, chunk_id, dense_rank, sparse_rank, fusion_score FROM fused")
def jn_fusion(spark, sf_dir):
    return fused(spark, sf_dir, 1.0, 0.0).select("query_id", "chunk_id", "dense_rank", "sparse_rank", "fusion_score")


@query("prj_found", f"{_fused_sql(0.5, 0.5)} SELECT query_id, found_by, count(*) AS n FROM fused GROUP BY 1, 2")
def prj_found(spark, sf_dir):
    return fused(spark, sf_dir, 0.5, 0.5).groupBy("query_id", "found_by").agg(F.count("*").alias("n"))


@query("jn_known", f"{_fused_sql(0.5, 0.5)} SELECT query_id, chunk_id, fusion_score FROM fused WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE pos % 3 <> 0)")
def jn_known(spark, sf_dir):
    known = X.chunks(spark, sf_dir).where("pos % 3 <> 0")
    return R.fuse(dense(spark, sf_dir), sparse(spark, sf_dir), 0.5, 0.5, known).select("query_id", "chunk_id", "fusion_score")


_ALLOWED = f"{_BM}, a AS (SELECT b.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM bm b JOIN chunks USING (chunk_id) WHERE year >= 2020) SELECT query_id, chunk_id, score, rank FROM a WHERE rank <= 12"


@query("flt_allowed", _ALLOWED)
def flt_allowed(spark, sf_dir):
    """Lexical search restricted to allowed documents before the ranking, so nothing is lost to over-fetching."""
    allowed, whole = X.chunks(spark, sf_dir).where("year >= 2020").select("chunk_id", "pos"), index(spark, sf_dir)
    part = replace(whole, forward=whole.forward.join(allowed.select("chunk_id"), "chunk_id", "left_semi"))
    hits = R.bm25(X.questions(spark, sf_dir), part, 12).join(allowed, "chunk_id")
    return R.ranked(hits, 12, F.col("pos")).select("query_id", "chunk_id", "score", "rank")


@query("jn_allowed", f"{_BM} SELECT query_id, chunk_id, rank FROM sparse WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE year >= 2020)")
def jn_allowed(spark, sf_dir):
    return sparse(spark, sf_dir).join(X.chunks(spark, sf_dir).where("year >= 2020").select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id", "rank")


_REL = f"round(len(list_intersect(list_distinct({_TOK.replace('@', 'question')}), {_TOK.replace('@', 'content')})) / len(list_distinct({_TOK.replace('@', 'question')}))::DOUBLE, 6)"
_RERANKED = f"""{_fused_sql(0.5, 0.5)}, cand AS (SELECT f.*, CASE WHEN fused_rank <= 5 THEN {_REL} END AS rerank_score FROM fused f JOIN questions USING (query_id) JOIN chunks USING (chunk_id) WHERE fused_rank <= 24),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fused_rank <= 5 THEN 0 ELSE 1 END, -rerank_score, CASE WHEN fused_rank <= 5 THEN chunk_id END, fused_rank) AS final_rank FROM cand QUALIFY final_rank <= 5)"""

HYBRID = R.RetrievalSettings(dense_weight=0.5, sparse_weight=0.5)


def final(spark, sf_dir, s=HYBRID):
    return R.retrieve(X.questions(spark, sf_dir), X.chunks(spark, sf_dir), dense(spark, sf_dir), sparse(spark, sf_dir), s)


@query("ret_hybrid", f"{_RERANKED} SELECT query_id, chunk_id, fused_rank, rerank_score, final_rank FROM fin")
def ret_hybrid(spark, sf_dir):
    return final(spark, sf_dir).select("query_id", "chunk_id", "fused_rank", "rerank_score", "final_rank")


@query("ret_modes")
def ret_modes(spark, sf_dir):
    """The composed path in all four modes: pages chunked, deduplicated and indexed, questions embedded, ranked passages of each mode."""
    from sparkfolio.operators import corpus as C
    from sparkfolio.sources.files import scratch

    pages = X.raw_pages(spark, sf_dir)
    made = C.build(pages.where(F.length("content") > 0), scratch(spark, "corpus"))
    asked, both = X.questions(spark, sf_dir), []
    # All modes rank the same hits, which are found once.
    for rows in C.hits(asked, made, HYBRID):
        path = scratch(spark, "hits")
        rows.write.parquet(path)
        both.append(spark.read.parquet(path))
    out = None
    for mode in ("dense", "sparse", "hybrid", "hybrid_rerank"):
        found = R.retrieve(asked, made.chunks, *both, replace(HYBRID, mode=mode)).select(F.lit(mode).alias("mode"), "query_id", "chunk_id", "final_rank")
        out = found if out is None else out.unionByName(found)
    return out


@query("top_rerank", f"{_RERANKED} SELECT query_id, string_agg(chunk_id, ',' ORDER BY final_rank) AS top FROM fin GROUP BY 1")
def top_rerank(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("final_rank", "chunk_id")))
    return final(spark, sf_dir).groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["chunk_id"]), ",").alias("top"))


@query("top_fused", f"{_fused_sql(0.5, 0.5)} SELECT query_id, chunk_id, fused_rank FROM fused WHERE fused_rank <= 24")
def top_fused(spark, sf_dir):
    return fused(spark, sf_dir, 0.5, 0.5).where("fused_rank <= 24").select("query_id", "chunk_id", "fused_rank")


@query("flt_floor", f"{_RERANKED} SELECT query_id, chunk_id, rerank_score FROM fin WHERE coalesce(rerank_score, 0) >= 0.3508")
def flt_floor(spark, sf_dir):
    return final(spark, sf_dir).where(F.coalesce("rerank_score", F.lit(0.0)) >= HYBRID.floor).select("query_id", "chunk_id", "rerank_score")


_GATE = f"""{_RERANKED}, per AS (SELECT query_id, max(CASE WHEN final_rank = 1 THEN coalesce(rerank_score, fusion_score) END) AS best_score, count(*) FILTER (coalesce(rerank_score, 0) >= 0.3508) AS n_admitted, count(*) AS n FROM fin GROUP BY 1),
gate AS (SELECT query_id, best_score, coalesce(n_admitted, 0) AS n_admitted, coalesce(n_admitted, 0) < 1 AS refused, CASE WHEN coalesce(n_admitted, 0) >= 1 THEN '' WHEN coalesce(n, 0) = 0 THEN 'no_results' ELSE 'below_floor' END AS reason FROM questions LEFT JOIN per USING (query_id))"""


def gated(spark, sf_dir):
    return R.gate(final(spark, sf_dir), X.questions(spark, sf_dir), HYBRID.floor)


@query("flt_gate", f"{_GATE} SELECT * FROM gate")
def flt_gate(spark, sf_dir):
    return gated(spark, sf_dir)


@query("prj_band", f"{_GATE} SELECT query_id, CASE WHEN refused THEN 'none' WHEN best_score >= 0.8 THEN 'High' WHEN best_score >= 0.5 THEN 'Moderate' ELSE 'Low' END AS band FROM gate")
def prj_band(spark, sf_dir):
    band = F.when(F.col("refused"), "none").when(F.col("best_score") >= 0.8, "High").when(F.col("best_score") >= 0.5, "Moderate").otherwise("Low")
    return gated(spark, sf_dir).select("query_id", band.alias("band"))


@query("prj_score", f"{_RERANKED} SELECT query_id, chunk_id, coalesce(rerank_score, fusion_score) AS score FROM fin")
def prj_score(spark, sf_dir):
    return final(spark, sf_dir).select("query_id", "chunk_id", F.coalesce("rerank_score", "fusion_score").alias("score"))


@query("prj_evidence", f"{_GATE} SELECT query_id, NOT refused AS has_evidence FROM gate")
def prj_evidence(spark, sf_dir):
    return gated(spark, sf_dir).select("query_id", (~F.col("refused")).alias("has_evidence"))


@query("prj_meta", f"WITH {X.CHUNKS_SQL} SELECT chunk_id, doc_id, title, page_start, page_end, coalesce(year, 0) AS year, chunk_id || ',' || doc_id AS ids FROM chunks")
def prj_meta(spark, sf_dir):
    c = X.chunks(spark, sf_dir)
    return c.select("chunk_id", "doc_id", "title", "page_start", "page_end", F.coalesce("year", F.lit(0)).alias("year"), F.array_join(F.array("chunk_id", "doc_id"), ",").alias("ids"))


@query("sim_pairs", f"WITH {_VEC} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.vec_id < b.vec_id AND a.label = b.label WHERE round(list_dot_product(a.v, b.v), 6) >= 0.3")
def sim_pairs(spark, sf_dir):
    """Similar vectors inside one label (the block that a pair must share), multiplied block by block."""
    from sparkfolio.operators.dedup import similar_pairs

    v = X.vectors(spark, sf_dir).withColumnRenamed("vec_id", "node")
    return similar_pairs(v, 0.3, 8192, within="doc").select(F.col("early").alias("a"), F.col("late").alias("b"), "score")


_THR = f"""WITH {_VEC}, d AS (SELECT label, 1 - list_dot_product(v, lead(v) OVER (PARTITION BY label ORDER BY vec_id)) AS dist, vec_id FROM v)"""


def distances(spark, sf_dir):
    """Distance of each vector to the next of its label."""
    w = Window.partitionBy("doc").orderBy("vec_id")
    return X.vectors(spark, sf_dir).select(F.col("doc").alias("label"), "vec_id", (1 - R.dot(F.col("v"), F.lead("v").over(w))).alias("dist"))


@query("win_dist", f"{_THR} SELECT label, vec_id, round(dist, 6) AS dist FROM d")
def win_dist(spark, sf_dir):
    return distances(spark, sf_dir).select("label", "vec_id", F.round("dist", 6).alias("dist"))


@query("agg_thr_pct", f"{_THR} SELECT label, round(quantile_cont(dist, 0.9), 6) AS threshold FROM d GROUP BY 1")
def agg_thr_pct(spark, sf_dir):
    return distances(spark, sf_dir).groupBy("label").agg(F.round(F.percentile("dist", F.lit(0.9)), 6).alias("threshold"))


@query("agg_thr_std", f"{_THR} SELECT label, round(avg(dist) + 3 * stddev_pop(dist), 6) AS threshold FROM d GROUP BY 1")
def agg_thr_std(spark, sf_dir):
    return distances(spark, sf_dir).groupBy("label").agg(F.round(F.avg("dist") + 3 * F.stddev_pop("dist"), 6).alias("threshold"))


@query("agg_thr_iqr", f"{_THR} SELECT label, round(quantile_cont(dist, 0.75) + 1.5 * (quantile_cont(dist, 0.75) - quantile_cont(dist, 0.25)), 6) AS threshold FROM d GROUP BY 1")
def agg_thr_iqr(spark, sf_dir):
    q = lambda p: F.percentile("dist", F.lit(p))
    return distances(spark, sf_dir).groupBy("label").agg(F.round(q(0.75) + 1.5 * (q(0.75) - q(0.25)), 6).alias("threshold"))


@query("emb_doc")
def emb_doc(spark, sf_dir):
    """Vectors of the offline embedder: hashed words, unit length (queries get a prefix, documents none)."""
    from sparkfolio.operators.models import embed

    v = embed(X.chunks(spark, sf_dir).select("chunk_id", "content"), "content")
    return v.select("chunk_id", F.size("vector").alias("size"), F.round(F.sqrt(R.dot(F.col("vector").cast("array<double>"), F.col("vector").cast("array<double>"))), 4).alias("norm"))


@query("rr_cross", f"{_fused_sql(0.5, 0.5)} SELECT query_id, chunk_id, {_REL} AS relevance FROM fused JOIN questions USING (query_id) JOIN chunks USING (chunk_id)")
def rr_cross(spark, sf_dir):
    """Relevance of every fused candidate to its question."""
    asked, candidates = X.questions(spark, sf_dir), fused(spark, sf_dir, 0.5, 0.5).select("query_id", "chunk_id")
    pairs = R.of_chunks(candidates, X.chunks(spark, sf_dir).select("chunk_id", "content"), asked.count() * (HYBRID.dense_k + HYBRID.sparse_k)).join(asked, "query_id")
    return pairs.select("query_id", "chunk_id", R.lexical_relevance(F.col("question"), F.col("content")).alias("relevance"))


@query("jn_vocab", f"WITH {X.QUESTIONS_SQL}, d AS (SELECT * FROM (VALUES ('the'), ('and'), ('zz')) t(phrase)) SELECT query_id, phrase FROM questions JOIN d ON contains(lower(question), phrase)")
def jn_vocab(spark, sf_dir):
    phrases = spark.createDataFrame([("the",), ("and",), ("zz",)], "phrase string")
    return X.questions(spark, sf_dir).join(F.broadcast(phrases), F.contains(F.lower("question"), "phrase")).select("query_id", "phrase")


query("bm25", f"{_BM} SELECT query_id, chunk_id, floor(score * 10000 + 0.333)::BIGINT AS score_e4 FROM bm")(
    lambda spark, sf_dir: R.bm25(X.questions(spark, sf_dir), index(spark, sf_dir)).select("query_id", "chunk_id", F.floor(F.col("score") * 10000 + 0.333).alias("score_e4"))
)
query("top_sparse", f"{_BM} SELECT query_id, chunk_id, rank FROM sparse WHERE rank <= 5")(lambda spark, sf_dir: sparse(spark, sf_dir, 5).select("query_id", "chunk_id", "rank"))
query("top_dense", f"{_KNN} SELECT query_id, item_id, rank FROM knn WHERE rank <= 5")(lambda spark, sf_dir: knn(spark, sf_dir, 5).select("query_id", "item_id", "rank"))
query("jn_knn", f"{_KNN} SELECT query_id, item_id, label, score FROM knn JOIN v ON vec_id = item_id")(
    lambda spark, sf_dir: knn(spark, sf_dir).join(X.vectors(spark, sf_dir).select(F.col("vec_id").alias("item_id"), F.col("doc").alias("label")), "item_id").select("query_id", "item_id", "label", "score")
)
query("win_rank", f"WITH {X.CHUNKS_SQL}, {X.QUESTIONS_SQL}, {_DENSE_SQL} SELECT query_id, chunk_id, rank FROM dense")(lambda spark, sf_dir: dense(spark, sf_dir).select("query_id", "chunk_id", "rank"))


@query("emb_query")
def emb_query(spark, sf_dir):
    from sparkfolio.operators.models import embed_queries

    return embed_queries(X.questions(spark, sf_dir), "question").select("query_id", F.size("vector").alias("size"))

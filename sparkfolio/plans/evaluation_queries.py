"""Queries over the evaluation operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfolio.functions.numbers import half_away
from sparkfolio.operators import evaluation as E
from sparkfolio.operators import retrieval as R
from sparkfolio.operators.order import positions
from sparkfolio.operators.quantiles import floor_index, nth_values, upper_median
from sparkfolio.plans.retrieval_queries import _BM, _FUSED, _GATE, _fused_sql, dense, gated, sparse
from sparkfolio.registry import query
from sparkfolio.sources import fixtures as X

CATEGORIES = ("conceptual", "identifier", "table", "procedural", "multi_hop", "follow_up", "unanswerable", "out_of_scope")
_CAT = "CASE query_id % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES)) + " END"

_G = f"WITH {X.RAW_PAGES_SQL}, {X.QUESTIONS_SQL}, {X.GOLD_SQL}"


@query("jn_gold", f"{_G} SELECT query_id, doc_id, page FROM gold")
def jn_gold(spark, sf_dir):
    return X.gold(spark, sf_dir)


@query("agg_gold", f"{_G} SELECT {_CAT} AS category, count(DISTINCT query_id) AS n, count(DISTINCT query_id) FILTER (query_id IN (SELECT query_id FROM gold)) AS n_answerable FROM questions GROUP BY 1")
def agg_gold(spark, sf_dir):
    answerable = X.gold(spark, sf_dir).select("query_id", F.lit(True).alias("a")).distinct()
    q = X.questions(spark, sf_dir).join(answerable, "query_id", "left").withColumn("category", F.expr(_CAT))
    return q.groupBy("category").agg(F.countDistinct("query_id").alias("n"), F.count_if(F.coalesce("a", F.lit(False))).alias("n_answerable"))


@query("agg_spread", f"{_G} SELECT doc_id, count(*) AS n FROM gold GROUP BY 1")
def agg_spread(spark, sf_dir):
    return X.gold(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "doc_id")


@query("agg_pages", f"{_G} SELECT doc_id, count(DISTINCT p) AS n_pages FROM (SELECT doc_id, unnest(range(page, page + 3)) AS p FROM gold) GROUP BY 1")
def agg_pages(spark, sf_dir):
    spans = X.gold(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.col("page"), F.col("page") + 2)).alias("p"))
    return spans.groupBy("doc_id").agg(F.size(F.collect_set("p")).cast("long").alias("n_pages"))


@query("jn_coverage", f"{_G} SELECT DISTINCT g.query_id, g.doc_id, g.page FROM gold g ANTI JOIN (SELECT * FROM raw_pages WHERE length(trim(content)) >= 100) r ON g.doc_id = r.doc_id AND g.page = r.page_number")
def jn_coverage(spark, sf_dir):
    """Gold pages that the index doesn't hold."""
    from sparkfolio.operators.pages import dense_pages

    held = dense_pages(X.raw_pages(spark, sf_dir)).select("doc_id", F.col("page_number").alias("page"))
    return X.gold(spark, sf_dir).distinct().join(held, ["doc_id", "page"], "left_anti").select("query_id", "doc_id", "page")


@query("jn_docfile", f"{_G} SELECT DISTINCT g.query_id, g.doc_id, r.filename FROM gold g LEFT JOIN raw_pages r ON g.doc_id = r.doc_id AND g.page = r.page_number")
def jn_docfile(spark, sf_dir):
    names = X.raw_pages(spark, sf_dir).select("doc_id", F.col("page_number").alias("page"), "filename")
    return X.gold(spark, sf_dir).join(names, ["doc_id", "page"], "left").select("query_id", "doc_id", "filename").distinct()


_RANKS = f"""{_BM}, {X.GOLD_SQL}, res AS (SELECT s.query_id, c.doc_id, c.page_start, c.page_end, s.rank FROM sparse s JOIN chunks c USING (chunk_id)),
ranks AS (SELECT g.query_id, min(r.rank) AS first FROM (SELECT DISTINCT query_id, doc_id, page FROM gold) g LEFT JOIN res r ON r.query_id = g.query_id AND r.doc_id = g.doc_id AND r.page_start <= g.page AND r.page_end >= g.page GROUP BY 1)"""


def ranks(spark, sf_dir, hits=None):
    hits = sparse(spark, sf_dir) if hits is None else hits
    c = X.chunks(spark, sf_dir).select("chunk_id", "doc_id", "page_start", "page_end")
    gold = X.gold(spark, sf_dir).select("query_id", "doc_id", F.col("page").alias("page_start"), F.col("page").alias("page_end"))
    return E.first_gold_rank(hits.join(c, "chunk_id"), gold)


@query("win_firsthit", f"{_RANKS} SELECT query_id, first FROM ranks")
def win_firsthit(spark, sf_dir):
    return ranks(spark, sf_dir)


def _rates(prefix: str = "") -> str:
    return "round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_3, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, count(*) AS n"


def rates():
    first = F.col("first")
    return [*[F.round(E.hit_rate(first, k), 6).alias(f"hit_{k}") for k in (1, 3, 5)], F.round(E.mean_reciprocal_rank(first), 6).alias("mrr"), F.count("*").alias("n")]


@query("agg_hit", f"{_RANKS} SELECT {_rates()} FROM ranks")
def agg_hit(spark, sf_dir):
    return ranks(spark, sf_dir).agg(*rates())


@query("agg_cat", f"{_RANKS} SELECT coalesce(category, 'all') AS category, {_rates()} FROM (SELECT *, {_CAT} AS category FROM ranks) GROUP BY ROLLUP (category)")
def agg_cat(spark, sf_dir):
    by = ranks(spark, sf_dir).withColumn("category", F.expr(_CAT)).rollup("category").agg(*rates())
    return by.withColumn("category", F.coalesce("category", F.lit("all")))


_CONFIGS = (("dense", 1.0, 0.0), ("sparse", 0.0, 1.0), ("hybrid", 0.5, 0.5), ("dense_heavy", 0.8, 0.2), ("sparse_heavy", 0.2, 0.8))
_ABL = _FUSED[: _FUSED.index(", fused AS (")] + f""", {X.GOLD_SQL}, cfg AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {d}::DOUBLE, {s}::DOUBLE)" for n, d, s in _CONFIGS)}) t(config, wd, ws)),
f AS (SELECT config, coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, round(coalesce(wd / (60 + d.rank), 0) + coalesce(ws / (60 + s.rank), 0), 9) AS score
  FROM cfg, (dense d FULL OUTER JOIN sparse s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id)),
fr AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, chunk_id) AS rank FROM f QUALIFY rank <= 5),
abl AS (SELECT cfg.config, g.query_id, min(r.rank) AS first FROM cfg, (SELECT DISTINCT query_id, doc_id, page FROM gold) g LEFT JOIN (SELECT fr.*, c.doc_id, c.page_start, c.page_end FROM fr JOIN chunks c USING (chunk_id)) r
  ON r.config = cfg.config AND r.query_id = g.query_id AND r.doc_id = g.doc_id AND r.page_start <= g.page AND r.page_end >= g.page GROUP BY 1, 2)"""


def ablation(spark, sf_dir):
    """First gold rank of every configuration: hits are found once and only reweighted."""
    configs = spark.createDataFrame(list(_CONFIGS), "config string, wd double, ws double")
    d = dense(spark, sf_dir).select("query_id", "chunk_id", F.col("rank").alias("rd"))
    s = sparse(spark, sf_dir).select("query_id", "chunk_id", F.col("rank").alias("rs"))
    pool = d.join(s, ["query_id", "chunk_id"], "full_outer")
    weighed = pool.join(F.broadcast(configs)).withColumn(
        "score", F.round(F.coalesce(F.col("wd") / (60 + F.col("rd")), F.lit(0.0)) + F.coalesce(F.col("ws") / (60 + F.col("rs")), F.lit(0.0)), 9)
    )
    order = Window.partitionBy("config", "query_id").orderBy(F.col("score").desc(), "chunk_id")
    top = weighed.select("config", "query_id", "chunk_id", F.row_number().over(order).alias("rank")).where("rank <= 5")
    c = X.chunks(spark, sf_dir).select("chunk_id", "doc_id", "page_start", "page_end")
    g = X.gold(spark, sf_dir).distinct()
    hit = top.join(c, "chunk_id").join(g, ["query_id", "doc_id"]).where("page_start <= page AND page_end >= page").groupBy("config", "query_id").agg(F.min("rank").alias("first"))
    return g.select("query_id").distinct().join(F.broadcast(configs.select("config"))).join(hit, ["config", "query_id"], "left")


@query("ev_ablate", f"{_ABL} SELECT config, {_rates()} FROM abl GROUP BY 1")
def ev_ablate(spark, sf_dir):
    return ablation(spark, sf_dir).groupBy("config").agg(*rates())


@query("top_best", f"{_ABL} SELECT config FROM (SELECT config, {_rates()} FROM abl GROUP BY 1) ORDER BY hit_5 DESC, mrr DESC, config DESC LIMIT 1")
def top_best(spark, sf_dir):
    return ablation(spark, sf_dir).groupBy("config").agg(*rates()).agg(F.max_by("config", F.struct("hit_5", "mrr", "config")).alias("config"))


@query("ev_config", "SELECT config, substr(sha256(config || '|' || wd || '|' || ws), 1, 12) AS fingerprint FROM (VALUES " + ", ".join(f"('{n}', '{d}', '{s}')" for n, d, s in _CONFIGS) + ") t(config, wd, ws)")
def ev_config(spark, sf_dir):
    rows = spark.createDataFrame([(n, str(d), str(s)) for n, d, s in _CONFIGS], "config string, wd string, ws string")
    return rows.select("config", F.substring(F.sha2(F.concat_ws("|", "config", "wd", "ws").cast("binary"), 256), 1, 12).alias("fingerprint"))


@query("agg_admit", f"{_GATE}, {X.GOLD_SQL} SELECT count(*) FILTER (NOT refused) AS n_admitted, count(*) AS n FROM gate WHERE query_id NOT IN (SELECT query_id FROM gold)")
def agg_admit(spark, sf_dir):
    """Questions without a source that the gate lets through."""
    return gated(spark, sf_dir).join(X.gold(spark, sf_dir).select("query_id").distinct(), "query_id", "left_anti").agg(F.count_if(~F.col("refused")).alias("n_admitted"), F.count("*").alias("n"))


#: Best score per labelled document: a stand-in for best scores of questions with an answerable flag.
_SCORES = "sc AS (SELECT doc_id, quality = 1 AS answerable, round(('0x' || substr(md5('s' || doc_id), 1, 6))::BIGINT / 16777216.0::DOUBLE * CASE WHEN quality = 1 THEN 1.0 ELSE 0.4 END, 6) AS best FROM labels)"


def scores(spark, sf_dir):
    u = F.conv(F.substring(F.md5(F.concat(F.lit("s"), F.col("doc_id").cast("string")).cast("binary")), 1, 6), 16, 10).cast("long") / F.lit(16777216.0)
    answerable = F.col("quality") == 1
    return X.table(spark, sf_dir, "labels").select("doc_id", answerable.alias("answerable"), half_away(u * F.when(answerable, 1.0).otherwise(0.4), 6).alias("best"))


_CAL = f"""WITH {_SCORES}, r AS (SELECT answerable, round(best, 4) AS s FROM sc), u AS (SELECT DISTINCT s FROM r),
t AS (SELECT 0.0::DOUBLE AS threshold UNION SELECT round((s + n) / 2, 4) FROM (SELECT s, lead(s) OVER (ORDER BY s) AS n FROM u) WHERE n IS NOT NULL UNION SELECT max(s) + 0.01 FROM u),
cost AS (SELECT threshold, count(*) FILTER (NOT answerable AND s >= threshold) AS wrong_answers, count(*) FILTER (answerable AND s < threshold) AS wrong_refusals FROM t, r GROUP BY 1)"""


@query("ev_cal", f"{_CAL} SELECT * FROM cost ORDER BY wrong_answers, wrong_refusals, threshold LIMIT 1")
def ev_cal(spark, sf_dir):
    return E.calibrate_floor(scores(spark, sf_dir))


@query("top_floor", f"{_CAL} SELECT threshold FROM cost ORDER BY wrong_answers, wrong_refusals, threshold LIMIT 1")
def top_floor(spark, sf_dir):
    return E.calibrate_floor(scores(spark, sf_dir)).select("threshold")


@query("win_mid", f"WITH {_SCORES}, u AS (SELECT DISTINCT round(best, 4) AS s FROM sc) SELECT round((s + lead(s) OVER (ORDER BY s)) / 2, 6) AS mid FROM u QUALIFY lead(s) OVER (ORDER BY s) IS NOT NULL")
def win_mid(spark, sf_dir):
    u = positions(scores(spark, sf_dir).select(half_away(F.col("best"), 4).alias("s")).distinct(), F.col("s"))
    following = u.select((F.col("pos") - 1).alias("pos"), F.col("s").alias("_next"))
    return u.join(following, "pos").select(half_away((F.col("s") + F.col("_next")) / 2, 6).alias("mid"))


def _pctl(col: str, f: float) -> str:
    return f"round(coalesce(list_sort(list({col}))[least(floor(count({col}) * {f}), count({col}) - 1)::INT + 1], 0), 1)"


@query("agg_pctl", f"SELECT event_type, {_pctl('value', 0.5)} AS p50, {_pctl('value', 0.95)} AS p95 FROM events GROUP BY 1")
def agg_pctl(spark, sf_dir):
    found = nth_values(X.requests(spark, sf_dir), ["event_type"], "latency_ms", {"p50": floor_index(0.5), "p95": floor_index(0.95)})
    return found.select("event_type", *[F.round(F.coalesce(c, F.lit(0.0)), 1).alias(c) for c in ("p50", "p95")])


@query("agg_upmed", f"WITH {_SCORES} SELECT answerable, list_sort(list(best))[(count(*) // 2)::INT + 1] AS median FROM sc GROUP BY 1")
def agg_upmed(spark, sf_dir):
    return nth_values(scores(spark, sf_dir), ["answerable"], "best", {"median": upper_median})


@query("agg_mean", "SELECT user_id % 50 AS shelf, round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS mean FROM events GROUP BY 1")
def agg_mean(spark, sf_dir):
    """Means skip nulls and are null without values."""
    return X.requests(spark, sf_dir).groupBy((F.col("session_id") % 50).alias("shelf")).agg(F.round(F.avg(F.when(~F.col("failed"), F.col("latency_ms"))), 6).alias("mean"))


_RES = "res AS (SELECT event_id, event_type, value, CASE event_id % 5 WHEN 0 THEN 'generated' WHEN 1 THEN 'refused' WHEN 2 THEN 'degraded' WHEN 3 THEN 'declined' ELSE 'generated' END AS outcome, event_id % 3 <> 0 AS answerable, value % 200 AS total FROM events)"


def results(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", F.expr("CASE event_id % 5 WHEN 0 THEN 'generated' WHEN 1 THEN 'refused' WHEN 2 THEN 'degraded' WHEN 3 THEN 'declined' ELSE 'generated' END").alias("outcome"),
        (F.col("event_id") % 3 != 0).alias("answerable"),
    )


@query("agg_outcome", f"WITH {_RES} SELECT answerable, outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY answerable), 6) AS share FROM res GROUP BY 1, 2")
def agg_outcome(spark, sf_dir):
    n = results(spark, sf_dir).groupBy("answerable", "outcome").agg(F.count("*").alias("n"))
    return n.select("*", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("answerable")), 6).alias("share"))


@query("flt_timed", "SELECT event_id FROM events WHERE value < 120")
def flt_timed(spark, sf_dir):
    return X.requests(spark, sf_dir).where("latency_ms < 120").select("event_id")


@query("agg_faith", f"WITH {_RES} SELECT event_type, round(avg(CASE WHEN outcome = 'generated' THEN CASE WHEN value > 20 THEN 1.0 ELSE 0 END END), 6) AS faithfulness FROM res GROUP BY 1")
def agg_faith(spark, sf_dir):
    supported = F.when(F.col("outcome") == "generated", (F.col("value") > 20).cast("int"))
    return results(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg(supported), 6).alias("faithfulness"))


@query("ev_quality", f"WITH {_RES} SELECT round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0 END), 6) AS faithfulness, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.5 END), 6) AS relevance, count(*) AS n FROM res WHERE outcome = 'generated'")
def ev_quality(spark, sf_dir):
    r = results(spark, sf_dir).where("outcome = 'generated'")
    return r.agg(F.round(F.avg((F.col("value") > 20).cast("int")), 6).alias("faithfulness"), F.round(F.avg(F.when(F.col("value") > 10, 1.0).otherwise(0.5)), 6).alias("relevance"), F.count("*").alias("n"))


@query("ev_latency", f"SELECT {_pctl('value', 0.5)} AS retrieval_p50, round(coalesce(list_sort(list(value) FILTER (event_type = 'click'))[least(floor((count(*) FILTER (event_type = 'click')) * 0.95), (count(*) FILTER (event_type = 'click')) - 1)::INT + 1], 0), 1) AS generation_p95 FROM events WHERE event_type <> 'error'")
def ev_latency(spark, sf_dir):
    r = X.requests(spark, sf_dir).where(~F.col("failed"))
    retrieval = nth_values(r, [], "latency_ms", {"retrieval_p50": floor_index(0.5)})
    generation = nth_values(r.where("event_type = 'click'"), [], "latency_ms", {"generation_p95": floor_index(0.95)})
    return retrieval.crossJoin(F.broadcast(generation)).select(*[F.round(F.coalesce(c, F.lit(0.0)), 1).alias(c) for c in ("retrieval_p50", "generation_p95")])


@query("ev_bycat", f"WITH {_RES} SELECT event_type AS category, count(*) AS n, round(avg(value), 6) AS mean FROM res WHERE outcome = 'generated' GROUP BY 1")
def ev_bycat(spark, sf_dir):
    return results(spark, sf_dir).where("outcome = 'generated'").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("ev_gen", f"WITH {_RES} SELECT count(*) AS n, count(*) FILTER (outcome = 'generated') AS answered, count(*) FILTER (outcome = 'declined') AS declined, count(*) FILTER (outcome = 'refused') AS refused, count(*) FILTER (outcome = 'degraded') AS degraded FROM res WHERE answerable")
def ev_gen(spark, sf_dir):
    o = F.col("outcome")
    counts = [F.count_if(o == k).alias(n) for k, n in (("generated", "answered"), ("declined", "declined"), ("refused", "refused"), ("degraded", "degraded"))]
    return results(spark, sf_dir).where("answerable").agg(F.count("*").alias("n"), *counts)


@query("ev_score", f"WITH {_RES} SELECT event_id, outcome = 'declined' OR value < 5 AS declined, CASE WHEN outcome = 'declined' OR value < 5 THEN 0.0 ELSE coalesce(CASE WHEN event_id % 7 <> 0 THEN 1.0 END, 0.5) END AS score FROM res")
def ev_score(spark, sf_dir):
    """One answer's score: declining by text or by flag counts 0; a failed judgement keeps the other score."""
    declined = (F.col("outcome") == "declined") | (F.col("value") < 5)
    judged = F.when(F.col("event_id") % 7 != 0, 1.0)
    return results(spark, sf_dir).select("event_id", declined.alias("declined"), F.when(declined, 0.0).otherwise(F.coalesce(judged, F.lit(0.5))).alias("score"))


@query("prj_snap", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 WHEN abs(x - 1.0) <= abs(x - 0.5) AND abs(x - 1.0) <= abs(x) THEN 1.0 WHEN abs(x - 0.5) <= abs(x) THEN 0.5 ELSE 0.0 END AS snapped FROM (SELECT *, (event_id % 11) / 10.0::DOUBLE AS x FROM events)")
def prj_snap(spark, sf_dir):
    """To the nearest of 1, 0.5 and 0; the first of equals."""
    x = (F.col("event_id") % 11) / F.lit(10.0)
    points = F.array(*[F.struct(F.abs(x - v).alias("d"), F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate((1.0, 0.5, 0.0))])
    return X.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", 0.0).otherwise(F.array_min(points)["v"]).alias("snapped"))


_VAR = "v AS (SELECT query_id, chunk_id, rank, score AS a, round(score * (1 + 0.01 * (rank % 3)), 6) AS b FROM sparse)"


@query("agg_gate", f"{_BM}, {_VAR} SELECT query_id, bool_and((a >= 5) = (b >= 5)) AS same_admission, (max(a) >= 5) = (max(b) >= 5) AS same_decision, list(chunk_id ORDER BY a DESC, chunk_id) = list(chunk_id ORDER BY b DESC, chunk_id) AS same_ranking, round(max(abs(a - b)), 6) AS max_diff FROM v GROUP BY 1")
def agg_gate(spark, sf_dir):
    """Agreement of two scorers over the same pairs."""
    v = sparse(spark, sf_dir).select("query_id", "chunk_id", F.col("score").alias("a"), F.round(F.col("score") * (1 + 0.01 * (F.col("rank") % 3)), 6).alias("b"))
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("s"), "chunk_id"))), lambda x: x["chunk_id"])
    return v.groupBy("query_id").agg(
        F.bool_and((F.col("a") >= 5) == (F.col("b") >= 5)).alias("same_admission"), ((F.max("a") >= 5) == (F.max("b") >= 5)).alias("same_decision"),
        (order("a") == order("b")).alias("same_ranking"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 6).alias("max_diff"),
    )


@query("ev_goldq", f"{_G} SELECT query_id, 'no source' AS violation FROM questions WHERE query_id NOT IN (SELECT query_id FROM gold)")
def ev_goldq(spark, sf_dir):
    """Gold questions that break a rule: answerable ones need a source."""
    return X.questions(spark, sf_dir).join(X.gold(spark, sf_dir).select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit("no source").alias("violation"))


@query("ev_capture")
def ev_capture(spark, sf_dir):
    """The pairs that a reranker would score: question, chunk, and their digests."""
    c = X.chunks(spark, sf_dir).select("chunk_id", "content")
    pairs = R.fuse(dense(spark, sf_dir), sparse(spark, sf_dir), 0.5, 0.5).where("fused_rank <= 5").join(c, "chunk_id").join(X.questions(spark, sf_dir), "query_id")
    return pairs.select("query_id", "chunk_id", "fused_rank", F.md5(F.concat("question", F.lit("\n"), "content").cast("binary")).alias("pair"))


@query("ev_judge")
def ev_judge(spark, sf_dir):
    """Offline judge: a claim (sentence) counts as supported if most of its words are in the evidence."""
    from sparkfolio.functions import text as T

    claims = X.questions(spark, sf_dir).select("query_id", F.posexplode(T.sentences(F.col("question"))).alias("claim", "text"))
    top = sparse(spark, sf_dir, 1).join(X.chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id").select("query_id", "content")
    return claims.join(top, "query_id").select("query_id", "claim", (R.lexical_relevance(F.col("text"), F.col("content")) >= 0.6).alias("supported"))


@query("ev_render", f"{_RANKS} SELECT '| ' || query_id || ' | ' || coalesce(first::VARCHAR, '-') || ' |' AS line FROM ranks")
def ev_render(spark, sf_dir):
    """Report lines from stored results, never measured again."""
    return ranks(spark, sf_dir).select(F.concat(F.lit("| "), F.col("query_id"), F.lit(" | "), F.coalesce(F.col("first").cast("string"), F.lit("-")), F.lit(" |")).alias("line"))


@query("ev_inv", f"WITH {X.CHUNKS_SQL}, {X.QUESTIONS_SQL} SELECT * FROM (VALUES ('chunk ids unique'), ('page ranges valid'), ('every chunk has a title'), ('vectors have unit length')) t(name), (SELECT true AS passed)")
def ev_inv(spark, sf_dir):
    """Index invariants: (name, passed)."""
    c, v = X.chunks(spark, sf_dir), X.vectors(spark, sf_dir)
    a = c.agg(
        (F.count("*") == F.countDistinct("chunk_id")).alias("chunk ids unique"), F.bool_and(F.col("page_start") <= F.col("page_end")).alias("page ranges valid"),
        F.bool_and(F.btrim("title") != "").alias("every chunk has a title"),
    )
    every = a.crossJoin(v.agg(F.bool_and(F.abs(F.sqrt(R.dot(F.col("v"), F.col("v"))) - 1) < 1e-4).alias("vectors have unit length")))
    return every.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("passed")) for n in every.columns])).alias("x")).select("x.*")


_SHARES = ("hit_1", "hit_3", "hit_5", "mrr")


@query("snk_report", f"{_ABL} SELECT '| ' || config || ' | ' || n || ' | ' || {" || ' | ' || ".join(f"printf('%.6f', {c})" for c in _SHARES)} || ' |' AS line FROM (SELECT config, {_rates()} FROM abl GROUP BY 1)")
def snk_report(spark, sf_dir):
    """Lines of the ablation table: configuration, questions, hit rates and mean reciprocal rank."""
    shares = [F.format_string("%.6f", c) for c in _SHARES]
    cells = F.concat_ws(" | ", "config", F.col("n").cast("string"), *shares)
    return ablation(spark, sf_dir).groupBy("config").agg(*rates()).select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))

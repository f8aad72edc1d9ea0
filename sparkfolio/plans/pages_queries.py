"""Queries over page records: filters, reports, streams, offsets, chunking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfolio.functions import text as T
from sparkfolio.operators import chunking, pages as P
from sparkfolio.registry import query
from sparkfolio.sources import fixtures as X

_W = f"WITH {X.RAW_PAGES_SQL}"
_DENSE = "dense AS (SELECT * FROM raw_pages WHERE length(trim(content)) >= 100)"
_STREAMS = (
    "streams AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY page_number) AS stream FROM (SELECT *, CASE WHEN page_number <> lag(page_number) OVER (PARTITION BY doc_id ORDER BY page_number) + 1 THEN 1 ELSE 0 END AS gap FROM dense))"
)
_OFFSETS = "offsets AS (SELECT *, coalesce(sum(length(content) + 2) OVER (PARTITION BY doc_id, stream ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM streams)"


def dense(spark, sf_dir):
    return P.dense_pages(X.raw_pages(spark, sf_dir))


@query("flt_sparse_page", f"{_W}, {_DENSE} SELECT doc_id, page_number, content FROM dense")
def flt_sparse_page(spark, sf_dir):
    return dense(spark, sf_dir).select("doc_id", "page_number", "content")


_MEANS = "SELECT doc_id, sum(length(trim(content))) / greatest(count(*), 1)::DOUBLE AS mean_chars FROM raw_pages GROUP BY 1"


@query("flt_scanned", f"{_W} SELECT * FROM ({_MEANS}) WHERE mean_chars < 50")
def flt_scanned(spark, sf_dir):
    return P.scanned_documents(X.raw_pages(spark, sf_dir))


@query("agg_meanchars", f"{_W} {_MEANS}")
def agg_meanchars(spark, sf_dir):
    return P.scanned_documents(X.raw_pages(spark, sf_dir), 10**9)


@query("flt_kept_documents", f"{_W} SELECT doc_id, page_number FROM raw_pages WHERE doc_id NOT IN (SELECT doc_id FROM ({_MEANS}) WHERE mean_chars < 50)")
def flt_kept_documents(spark, sf_dir):
    return P.without_scans(X.raw_pages(spark, sf_dir)).select("doc_id", "page_number")


_REPORT = """report AS (SELECT doc_id, count(*) AS n_pages, sum(length(trim(content)))::BIGINT AS n_chars, count(*) FILTER (length(trim(content)) < 100) AS n_sparse,
  count(*) FILTER (contains(content, '|')) AS n_tables, count(*) FILTER (length(trim(content)) < 100 AND NOT contains(content, '|')) AS n_image_only,
  count(*) FILTER (length(trim(content)) >= 100) AS n_indexed, max(year) AS year,
  CASE WHEN sum(length(trim(content))) / count(*) < 50 THEN 'scanned' WHEN count(*) FILTER (length(trim(content)) < 100) / count(*) > 0.4 THEN 'partial' ELSE 'OK' END AS verdict
  FROM raw_pages GROUP BY 1)"""


@query("agg_docreport", f"{_W}, {_REPORT} SELECT * FROM report")
def agg_docreport(spark, sf_dir):
    return P.document_report(X.raw_pages(spark, sf_dir))


@query("prj_verdict", f"{_W}, {_REPORT} SELECT doc_id, verdict FROM report")
def prj_verdict(spark, sf_dir):
    return P.document_report(X.raw_pages(spark, sf_dir)).select("doc_id", "verdict")


@query("dq_docok", f"{_W}, {_REPORT} SELECT doc_id, verdict <> 'scanned' AS ok FROM report")
def dq_docok(spark, sf_dir):
    return P.document_report(X.raw_pages(spark, sf_dir)).select("doc_id", (F.col("verdict") != "scanned").alias("ok"))


_TOTALS = """count(*) AS n_documents, sum(n_pages)::BIGINT AS n_pages, sum(n_indexed)::BIGINT AS n_indexed, sum(n_sparse)::BIGINT AS n_sparse, sum(n_image_only)::BIGINT AS n_image_only,
  sum(n_tables)::BIGINT AS n_tables, sum(n_chars)::BIGINT AS n_chars, count(*) FILTER (verdict = 'scanned') AS n_scanned, count(*) FILTER (verdict = 'partial') AS n_partial, count(DISTINCT year) AS n_years"""


@query("agg_manifest", f"{_W}, {_REPORT} SELECT {_TOTALS} FROM report")
def agg_manifest(spark, sf_dir):
    total = lambda c: F.sum(c).alias(c)
    return P.document_report(X.raw_pages(spark, sf_dir)).agg(
        F.count("*").alias("n_documents"), *map(total, ("n_pages", "n_indexed", "n_sparse", "n_image_only", "n_tables", "n_chars")),
        F.count_if(F.col("verdict") == "scanned").alias("n_scanned"), F.count_if(F.col("verdict") == "partial").alias("n_partial"), F.countDistinct("year").alias("n_years"),
    )


@query(
    "agg_audit",
    f"{_W}, {_REPORT} SELECT sum(n_pages)::BIGINT AS n_pages, count(*) FILTER (verdict = 'OK') AS n_ok, sum(n_pages) BETWEEN 500 AND 2000 AS size_ok, count(*) FILTER (verdict = 'scanned') >= 3 AS scans_ok FROM report",
)
def agg_audit(spark, sf_dir):
    return P.document_report(X.raw_pages(spark, sf_dir)).agg(
        F.sum("n_pages").alias("n_pages"), F.count_if(F.col("verdict") == "OK").alias("n_ok"),
        F.sum("n_pages").between(500, 2000).alias("size_ok"), (F.count_if(F.col("verdict") == "scanned") >= 3).alias("scans_ok"),
    )


@query("win_islands", f"{_W}, {_DENSE}, {_STREAMS} SELECT doc_id, page_number, stream::BIGINT AS stream FROM streams")
def win_islands(spark, sf_dir):
    return P.page_streams(dense(spark, sf_dir)).select("doc_id", "page_number", "stream")


def offsets(spark, sf_dir):
    return P.stream_offsets(P.page_streams(dense(spark, sf_dir)))


@query("win_offsets", f'{_W}, {_DENSE}, {_STREAMS}, {_OFFSETS} SELECT doc_id, stream::BIGINT AS stream, page_number, s AS "start", s + length(content) AS "end" FROM offsets')
def win_offsets(spark, sf_dir):
    return offsets(spark, sf_dir).select("doc_id", "stream", "page_number", "start", "end")


_POINTS = "points AS (SELECT doc_id, stream, point, point * 700 AS position FROM (SELECT DISTINCT doc_id, stream FROM offsets), (SELECT unnest(range(0, 6)) AS point))"


@query("jn_pageof", f"{_W}, {_DENSE}, {_STREAMS}, {_OFFSETS}, {_POINTS} SELECT p.doc_id, p.stream::BIGINT AS stream, p.point, p.position, max(o.page_number)::INT AS page_number FROM points p JOIN offsets o ON p.doc_id = o.doc_id AND p.stream = o.stream AND o.s <= p.position GROUP BY ALL")
def jn_pageof(spark, sf_dir):
    o = offsets(spark, sf_dir)
    points = o.select("doc_id", "stream").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("point")).withColumn("position", F.col("point").cast("long") * 700)
    return P.locate(points, o)


@query(
    "jn_srcids",
    f"{_W}, {_DENSE}, {_STREAMS} SELECT doc_id, stream::BIGINT AS stream, page_number, array_to_string(list_transform(list(page_number) OVER (PARTITION BY doc_id, stream ORDER BY page_number ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), lambda x: substr(sha1(doc_id || '|' || x || '|text|'), 1, 16)), ',') AS ids FROM streams",
)
def jn_srcids(spark, sf_dir):
    """Record ids of the pages of each span (here: a page and the next two of its stream)."""
    w = Window.partitionBy("doc_id", "stream").orderBy("page_number").rowsBetween(0, 2)
    ids = F.array_join(F.collect_list(T.location_id(F.col("doc_id"), F.col("page_number"), F.lit("text"), F.lit(""))).over(w), ",")
    return P.page_streams(dense(spark, sf_dir)).select("doc_id", "stream", "page_number", ids.alias("ids"))


@query(
    "win_overlap",
    f"{_W}, t AS (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY page_number) AS prev, greatest(0, least(150, 2400 - length(content) - 1)) AS b FROM raw_pages) "
    "SELECT doc_id, page_number, trim(CASE WHEN prev IS NULL OR b <= 0 THEN '' WHEN length(prev) <= b OR substr(prev, length(prev) - b, 1) = ' ' THEN substr(prev, greatest(length(prev) - b, 0) + 1) "
    "WHEN strpos(substr(prev, length(prev) - b + 1), ' ') > 0 THEN substr(substr(prev, length(prev) - b + 1), strpos(substr(prev, length(prev) - b + 1), ' ') + 1) ELSE '' END) AS overlap FROM t",
)
def win_overlap(spark, sf_dir):
    previous = F.lag("content").over(Window.partitionBy("doc_id").orderBy("page_number"))
    budget = F.greatest(F.lit(0), F.least(F.lit(150), F.lit(2399) - F.length("content")))
    rows = X.raw_pages(spark, sf_dir).withColumn("prev", previous).withColumn("b", budget)
    return rows.select("doc_id", "page_number", F.coalesce(T.overlap_tail(F.col("prev"), F.col("b")), F.lit("")).alias("overlap"))


@query("flt_short", f"{_W} SELECT doc_id, page_number FROM raw_pages WHERE length(trim(content)) >= 120 AND length(regexp_replace(trim(content), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length(trim(content))::DOUBLE >= 0.75")
def flt_short(spark, sf_dir):
    """Chunk filters: long enough, then informative enough."""
    return X.raw_pages(spark, sf_dir).where((F.length(T.strip(F.col("content"))) >= 120) & ~T.is_low_information(F.col("content"))).select("doc_id", "page_number")


@query("flt_kind", f"{_W} SELECT CASE WHEN contains(content, '|') THEN 'table' ELSE 'text' END AS kind, count(*) AS n FROM raw_pages GROUP BY 1")
def flt_kind(spark, sf_dir):
    return X.raw_pages(spark, sf_dir).groupBy(F.when(F.col("content").contains("|"), "table").otherwise("text").alias("kind")).agg(F.count("*").alias("n"))


@query(
    "win_ordinal",
    f"{_W} SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY contains(content, '|'), page_number) - 1 AS ordinal FROM raw_pages WHERE contains(content, '|') OR length(trim(content)) >= 120",
)
def win_ordinal(spark, sf_dir):
    """Kept chunks are numbered text first, then tables; tables are exempt from the length filter."""
    table = F.col("content").contains("|")
    kept = X.raw_pages(spark, sf_dir).where(table | (F.length(T.strip(F.col("content"))) >= 120))
    return kept.select("doc_id", "page_number", (F.row_number().over(Window.partitionBy("doc_id").orderBy(table, "page_number")) - 1).cast("long").alias("ordinal"))


@query(
    "set_union",
    f"{_W} SELECT doc_id, page_number, 'text' AS kind FROM raw_pages WHERE NOT contains(content, '|') UNION ALL SELECT doc_id, page_number, 'table' FROM raw_pages WHERE contains(content, '|')",
)
def set_union(spark, sf_dir):
    p = X.raw_pages(spark, sf_dir).select("doc_id", "page_number", "content")
    table = F.col("content").contains("|")
    return p.where(~table).select("doc_id", "page_number", F.lit("text").alias("kind")).unionByName(p.where(table).select("doc_id", "page_number", F.lit("table").alias("kind")))


@query("chk_pipeline")
def chk_pipeline(spark, sf_dir):
    """The whole chunker over every stream of dense pages."""
    return chunking.chunk_documents(P.page_streams(dense(spark, sf_dir)))


@query("chk_semantic")
def chk_semantic(spark, sf_dir):
    return chunking.chunk_pages(P.page_streams(X.raw_pages(spark, sf_dir))).select("doc_id", "stream", "piece", "strategy", "core_chars")


@query("chk_recursive")
def chk_recursive(spark, sf_dir):
    s = chunking.ChunkSettings(strategy="recursive")
    return chunking.chunk_pages(P.page_streams(X.raw_pages(spark, sf_dir)), s).select("doc_id", "stream", "piece", "strategy", "core_chars")


@query("chk_maxsize")
def chk_maxsize(spark, sf_dir):
    """Pieces after the size limit: none is above it."""
    return chunking.chunk_pages(P.page_streams(X.raw_pages(spark, sf_dir))).agg(F.count("*").alias("pieces"), F.max("core_chars").alias("largest"))


@query("chk_locate")
def chk_locate(spark, sf_dir):
    return chunking.chunk_pages(P.page_streams(dense(spark, sf_dir))).select("doc_id", "stream", "piece", "page_start", "page_end", "located")


@query("agg_chunkrep")
def agg_chunkrep(spark, sf_dir):
    """Chunk report: counts by strategy and fate, mean and 95th percentile of characters."""
    made = chunking.chunk_pages(P.page_streams(dense(spark, sf_dir)))
    return made.rollup("strategy", "fate").agg(
        F.count("*").alias("n"), F.round(F.avg("core_chars"), 6).alias("mean_chars"), F.percentile("core_chars", F.lit(0.95)).cast("int").alias("p95_chars"),
        F.count_if(~F.col("located")).alias("unlocated"),
    )


@query("agg_chunk_sizes", f"{_W} SELECT kind, count(*) AS n, round(avg(length(content)), 6) AS mean_chars, floor(quantile_cont(length(content), 0.95))::INT AS p95_chars FROM raw_pages GROUP BY 1")
def agg_chunk_sizes(spark, sf_dir):
    size = F.length("content")
    return X.raw_pages(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(size), 6).alias("mean_chars"), F.percentile(size, F.lit(0.95)).cast("int").alias("p95_chars"))


@query("ev_inv_chunks")
def ev_inv_chunks(spark, sf_dir):
    """Invariants of the built chunks: (name, passed, detail)."""
    c = chunking.chunk_documents(P.page_streams(dense(spark, sf_dir)))
    checks = c.agg(
        (F.count("*") - F.countDistinct("chunk_id")).alias("chunk ids unique"),
        F.count_if(F.col("core_chars") < 120).alias("no text chunk below the minimum"),
        F.count_if(F.length("content") > 2400).alias("no chunk above the maximum"),
        F.count_if(F.col("page_start") > F.col("page_end")).alias("page ranges valid"),
        F.count_if(~F.col("located")).alias("page spans located exactly"),
    )
    names = checks.columns
    return checks.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("found")) for n in names])).alias("x")).select("x.name", (F.col("x.found") == 0).alias("passed"), "x.found")


@query("src_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def src_digest(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("src_prose", f"WITH {X.LAYOUT_SQL} SELECT doc_id, page, block FROM blocks WHERE (doc_id, block) NOT IN (SELECT (doc_id, block) FROM met WHERE (ix1 - ix0) * (iy1 - iy0) / area > 0.6)")
def src_prose(spark, sf_dir):
    """Text blocks that lie in one of their page's tables by more than 0.6 of their area are dropped."""
    from sparkfolio.operators import spatial

    blocks, tables = X.layout(spark, sf_dir)
    return spatial.prose_outside(blocks, tables, ["doc_id", "page"], ["doc_id", "page", "block"]).select("doc_id", "page", "block")

"""Adapters that give the generic test tables the shapes of the document pipeline.

Every adapter is a deterministic relational mapping, so that DuckDB can mirror it; the
``*_SQL`` strings are those mirrors, used as common table expressions by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per line of a document: doc_id, title, filename, page_number, total_pages, year, kind, content."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.split("text", "\n").alias("lines"), (F.lit(2015) + F.col("doc_id") % 12).cast("int").alias("y")
    )
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("doc_id"),
        F.concat("source", F.lit(" doc "), F.col("doc_id")).alias("title"),
        F.concat(F.col("doc_id"), F.lit(".txt")).alias("filename"),
        F.size("lines").alias("total_pages"),
        F.when(F.col("doc_id") % 13 != 0, F.col("y")).alias("year"),
        F.lit("text").alias("kind"),
        F.posexplode("lines").alias("_p", "content"),
    ).select("doc_id", "title", "filename", (F.col("_p") + 1).alias("page_number"), "total_pages", "year", "kind", "content")


RAW_PAGES_SQL = """raw_pages AS (
  SELECT 'doc-' || doc_id AS doc_id, source || ' doc ' || doc_id AS title, doc_id || '.txt' AS filename, p AS page_number,
         len(lines) AS total_pages, CASE WHEN doc_id % 13 <> 0 THEN 2015 + doc_id % 12 END AS year, 'text' AS kind, lines[p] AS content
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS p FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents)))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document: chunk_id (location hash), doc_id, page_start, page_end, year, content, pos (order)."""
    return chunks_of(table(spark, sf_dir, "documents"))


def chunks_of(d: DataFrame) -> DataFrame:
    doc = F.concat(F.lit("doc-"), F.col("doc_id"))
    return d.select(
        F.substring(F.sha1(F.concat_ws("|", doc, F.lit("1"), F.lit("1"), F.lit("0")).cast("binary")), 1, 16).alias("chunk_id"),
        doc.alias("doc_id"),
        F.concat("source", F.lit(" doc "), F.col("doc_id")).alias("title"),
        F.lit(1).alias("page_start"),
        F.size(F.split("text", "\n")).alias("page_end"),
        F.when(F.col("doc_id") % 13 != 0, (F.lit(2015) + F.col("doc_id") % 12).cast("int")).alias("year"),
        F.col("text").alias("content"),
        F.col("doc_id").alias("pos"),
    )


CHUNKS_SQL = """chunks AS (
  SELECT substr(sha1('doc-' || doc_id || '|1|1|0'), 1, 16) AS chunk_id, 'doc-' || doc_id AS doc_id, source || ' doc ' || doc_id AS title,
         1 AS page_start, len(string_split(text, chr(10))) AS page_end, CASE WHEN doc_id % 13 <> 0 THEN 2015 + doc_id % 12 END AS year,
         text AS content, doc_id AS pos FROM documents)"""


def layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Text blocks (doc_id, page, block) and tables (doc_id, page) as rectangles: ten lines of a document to a page.

    A block is as wide as its line is long; every line with an even length also has a table near it, whose
    place and size follow from that length, so a page has several that overlap blocks and each other.
    """
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("_i", "_line"))
    at = lines.select("doc_id", F.floor(F.col("_i") / 10).alias("page"), F.col("_i").cast("long").alias("block"), (F.col("_i") % 10).alias("_r"), F.length("_line").alias("_n"))
    x, y = F.col("_n") % 4 * 5, F.col("_r") * 12
    blocks = at.select("doc_id", "page", "block", *_box(x, y, 10 + F.least("_n", F.lit(80)), F.lit(10)))
    u, w = F.col("_n") % 37, F.col("_r") * 12 + F.col("_n") % 9 - 4
    tables = at.where("_n % 2 = 0").select("doc_id", "page", *_box(u, w, 20 + F.col("_n") % 50, 8 + F.col("_n") % 13))
    return blocks, tables


def _box(x, y, width, height) -> list:
    return [c.cast("double").alias(name) for c, name in ((x, "x0"), (y, "y0"), (x + width, "x1"), (y + height, "y1"))]


LAYOUT_SQL = """lay AS MATERIALIZED (SELECT doc_id, (i - 1) // 10 AS page, i - 1 AS block, (i - 1) % 10 AS r, length(lines[i]) AS n FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
blocks AS (SELECT doc_id, page, block, n % 4 * 5 AS x0, r * 12 AS y0, n % 4 * 5 + 10 + least(n, 80) AS x1, r * 12 + 10 AS y1 FROM lay),
tables AS (SELECT doc_id, page, n % 37 AS x0, r * 12 + n % 9 - 4 AS y0, n % 37 + 20 + n % 50 AS x1, r * 12 + n % 9 + 4 + n % 13 AS y1 FROM lay WHERE n % 2 = 0),
met AS (SELECT b.doc_id, b.page, b.block, (b.x1 - b.x0) * (b.y1 - b.y0) AS area, greatest(b.x0, t.x0) AS ix0, greatest(b.y0, t.y0) AS iy0, least(b.x1, t.x1) AS ix1, least(b.y1, t.y1) AS iy1
  FROM blocks b JOIN tables t ON b.doc_id = t.doc_id AND b.page = t.page AND b.x0 < t.x1 AND t.x0 < b.x1 AND b.y0 < t.y1 AND t.y0 < b.y1)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


QUESTIONS_SQL = "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("doc"))


#: Texts that are broadcast to all lines: a few megabytes.
FEW_TEXTS = 10_000


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id, page: lines that hold a benchmark text verbatim.

    Such a line holds all words of the text but the outermost ones as words of its own; the longest of
    them is the key on which words of lines and texts are joined, and only lines found so are compared
    with the text.  Texts of fewer than three words have no such key and are compared with all lines.
    Up to ``FEW_TEXTS`` texts (they are counted) go to the lines, so that no line is shuffled.
    """
    asked = questions(spark, sf_dir)
    few = asked.count() <= FEW_TEXTS
    words = F.split("question", " ")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = asked.select("query_id", "question", key.alias("_key"))
    lines = raw_pages(spark, sf_dir).select("doc_id", "page_number", "content")
    at, long = F.explode(F.array_distinct(F.split("content", " "))).alias("_key"), keyed.where("_key IS NOT NULL")
    if few:
        found = lines.select("*", at).join(F.broadcast(long), "_key")
    else:
        # Words carry only their line's place; lines are looked up for what was found.
        found = lines.select("doc_id", "page_number", at).join(long, "_key").select("doc_id", "page_number", "query_id", "question").distinct().join(lines, ["doc_id", "page_number"])
    out = found.where(F.contains("content", "question")).select("query_id", "doc_id", F.col("page_number").alias("page"))
    short = keyed.where("_key IS NULL AND question IS NOT NULL").select("query_id", "question")
    if short.isEmpty():
        return out
    return out.unionByName(lines.join(F.broadcast(short) if few else short, F.contains("content", "question")).select("query_id", "doc_id", F.col("page_number").alias("page")))


GOLD_SQL = "gold AS (SELECT query_id, doc_id, page_number AS page FROM raw_pages JOIN questions ON contains(content, question))"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations: conv_id, turn, question."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))


TURNS_SQL = "turns AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user')"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider requests: ts (UTC), session, latency_ms, failed."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("failed"), "event_type"
    )

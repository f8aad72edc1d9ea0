"""Queries over budgets, caps, cooldowns, caches, logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.functions import text as T
from sparkfolio.operators import state as S
from sparkfolio.operators.order import positions
from sparkfolio.registry import query
from sparkfolio.sources import fixtures as X
from sparkfolio.sources.files import scratch

_R = "req AS (SELECT event_id, ts, user_id AS session_id, value AS latency_ms, event_type = 'error' AS failed, event_type FROM events)"


@query("st_budget", f"WITH {_R}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS used FROM req GROUP BY 1) SELECT day, used, greatest(300 - used, 0) AS remaining, used >= 300 AS exhausted, greatest(300 - used, 0) <= 30 AS low FROM d QUALIFY row_number() OVER (ORDER BY day DESC) <= 14")
def st_budget(spark, sf_dir):
    return S.daily_budget(X.requests(spark, sf_dir), 300)


@query("agg_daily", f"WITH {_R} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS used FROM req GROUP BY 1 QUALIFY row_number() OVER (ORDER BY day DESC) <= 14")
def agg_daily(spark, sf_dir):
    return S.daily_budget(X.requests(spark, sf_dir)).select("day", "used")


@query("st_session", f"WITH {_R}, n AS (SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS used FROM req) SELECT *, used < 40 AS allowed FROM n")
def st_session(spark, sf_dir):
    return S.session_cap(X.requests(spark, sf_dir))


@query("agg_session", f"WITH {_R} SELECT session_id, count(*) AS used, greatest(40 - count(*), 0) AS remaining FROM req GROUP BY 1")
def agg_session(spark, sf_dir):
    used = F.count("*")
    return X.requests(spark, sf_dir).groupBy("session_id").agg(used.alias("used"), F.greatest(F.lit(40) - used, F.lit(0)).cast("long").alias("remaining"))


@query("st_cooldown", f"WITH {_R}, m AS (SELECT *, max(CASE WHEN failed THEN ts END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM req) SELECT event_id, coalesce(mark + INTERVAL 1 HOUR > ts, false) AS cooling FROM m")
def st_cooldown(spark, sf_dir):
    return S.cooldown(X.requests(spark, sf_dir))


_WRITES = "w AS (SELECT 'k' || event_id % 700 AS key, floor(epoch(ts))::BIGINT AS stored_at, event_id AS value FROM events), latest AS (SELECT key, max(stored_at) AS stored_at, max(value) FILTER (stored_at = m) AS value FROM (SELECT *, max(stored_at) OVER (PARTITION BY key) AS m FROM w) GROUP BY 1), now AS (SELECT max(stored_at) AS t FROM w)"


def writes(spark, sf_dir):
    return X.requests(spark, sf_dir).select(F.concat(F.lit("k"), F.col("event_id") % 700).alias("key"), F.unix_timestamp("ts").alias("stored_at"), F.col("event_id").alias("value"))


def _now(rows):
    """One row: the time of the last write."""
    return rows.agg(F.max("stored_at").alias("_now"))


@query("st_cache", f"WITH {_WRITES} SELECT key, stored_at, value FROM latest, now WHERE t - stored_at <= 864000 QUALIFY row_number() OVER (ORDER BY stored_at DESC, key) <= 256")
def st_cache(spark, sf_dir):
    w = writes(spark, sf_dir)
    return S.cache_state(w, _now(w), ttl=864_000)


@query("flt_ttl", f"WITH {_WRITES} SELECT key, t - stored_at <= 86400 AS fresh FROM latest, now")
def flt_ttl(spark, sf_dir):
    w = writes(spark, sf_dir)
    return w.groupBy("key").agg(F.max("stored_at").alias("s")).crossJoin(F.broadcast(_now(w))).select("key", (F.col("_now") - F.col("s") <= 86_400).alias("fresh"))


@query("win_evict", f"WITH {_WRITES} SELECT key FROM latest QUALIFY row_number() OVER (ORDER BY stored_at DESC, key) > 256")
def win_evict(spark, sf_dir):
    latest = writes(spark, sf_dir).groupBy("key").agg(F.max("stored_at").alias("s"))
    return positions(latest, F.col("s").desc(), F.col("key"), name="n").where("n > 256").select("key")


_LOG_SQL = r"regexp_replace(regexp_replace(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+', '[email]', 'g'), '(^|[^\p{L}\p{N}_])[1-9][0-9]{12,}\b', '\1[number]', 'g')"


@query("src_qlog", f"SELECT conv_id, turn, CASE WHEN length(q) > 500 THEN substr(q, 1, 500) || '...[truncated]' ELSE q END AS question FROM (SELECT conv_id, turn, {_LOG_SQL.replace('text', 't', 1)} AS q FROM (SELECT conv_id, turn, 'ask a' || conv_id || '@mail.org or 1234567890123' || turn || ': ' || text AS t FROM conversations))")
def src_qlog(spark, sf_dir):
    """A question log written as JSON lines and read back: redacted, cut, broken lines skipped."""
    from sparkfolio.sources.files import append_query_log, read_query_log

    path = scratch(spark, "query-log")
    asked = F.concat(F.lit("ask a"), F.col("conv_id"), F.lit("@mail.org or 1234567890123"), F.col("turn"), F.lit(": "), F.col("text"))
    rows = X.table(spark, sf_dir, "conversations").select(T.redact(asked).alias("question"), F.concat_ws("/", "conv_id", "turn").alias("rewritten"), F.lit("hybrid").alias("mode"))
    append_query_log(rows, path)
    spark.createDataFrame([("not json",), ('{"question": ["cut off',)], "value string").write.mode("append").text(path)
    key = F.split("rewritten", "/")
    return read_query_log(spark, path).select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "question")


@query("src_jsonl", f"WITH {X.RAW_PAGES_SQL} SELECT doc_id, page_number, title, year, content FROM raw_pages")
def src_jsonl(spark, sf_dir):
    """Page records written as JSON lines and read back under the declared schema."""
    from sparkfolio.sources.files import read_records, write_records

    path = scratch(spark, "records")
    write_records(X.raw_pages(spark, sf_dir), path)
    return read_records(spark, path).select("doc_id", "page_number", "title", "year", "content")


@query("src_manifest", f"WITH {X.RAW_PAGES_SQL} SELECT doc_id, count(*) AS n_pages FROM raw_pages GROUP BY 1")
def src_manifest(spark, sf_dir):
    """The corpus manifest written as one JSON object and read back without its totals."""
    from sparkfolio.operators.pages import document_report
    from sparkfolio.sources.files import read_manifest, write_manifest

    path = scratch(spark, "manifest")
    write_manifest(document_report(X.raw_pages(spark, sf_dir)).select("doc_id", "n_pages"), path)
    return read_manifest(spark, path).select("doc_id", "n_pages")


@query("src_sparse", f"WITH {X.CHUNKS_SQL} SELECT token, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+(?:[./-][a-z0-9]+)*')) AS token FROM chunks) GROUP BY 1")
def src_sparse(spark, sf_dir):
    """The lexical index written as tables and read back."""
    from sparkfolio.sources.files import read_index, write_index

    path = scratch(spark, "index")
    write_index(X.chunks(spark, sf_dir), path)
    return read_index(spark, path).terms.select("token", "df")


@query("snk_vector", "SELECT label, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY 1 UNION ALL SELECT 3, 2")
def snk_vector(spark, sf_dir):
    """Vectors upserted by document: the partition of document 3 is replaced, the others stay."""
    from sparkfolio.sources.files import upsert_vectors

    path = scratch(spark, "vectors")
    v = X.vectors(spark, sf_dir).select("vec_id", "v", F.col("doc").alias("doc_id"))
    upsert_vectors(spark, v, path)
    upsert_vectors(spark, v.where("vec_id < 2").withColumn("doc_id", F.lit(3)), path)
    return spark.read.parquet(path).groupBy(F.col("doc_id").alias("label")).agg(F.count("*").alias("n"))


@query(
    "src_pdf",
    "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 0 ELSE len(string_split(html, '<p>')) END AS n_pages, CASE WHEN page_id % 7 = 0 THEN 0 ELSE length(replace(html, '<p>', '')) END::BIGINT AS n_chars, page_id % 7 = 0 AS failed, "
    "page_id % 7 <> 0 AND length(replace(html, '<p>', '')) / len(string_split(html, '<p>')) < 200 AS needs_ocr FROM pages",
)
def src_pdf(spark, sf_dir):
    """Documents (html, one page to each ``<p>``) extracted whole by a pluggable extractor; a broken one yields an error row and stops nothing."""
    from sparkfolio.sources.files import extract

    def pages_of(raw):
        if raw.startswith(b"%broken"):
            raise ValueError("not a document")
        return raw.decode("utf-8").split("<p>")

    content = F.when(F.col("page_id") % 7 == 0, F.encode(F.concat(F.lit("%broken"), "html"), "UTF-8")).otherwise(F.encode("html", "UTF-8"))
    made = extract(X.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), content.alias("content")), pages_of)
    per = made.groupBy("path").agg(F.count("page_number").alias("n_pages"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n_chars"), F.bool_or(F.col("error").isNotNull()).alias("failed"))
    return per.select(F.col("path").cast("long").alias("page_id"), "n_pages", "n_chars", "failed", (~F.col("failed") & (F.col("n_chars") / F.col("n_pages") < 200)).alias("needs_ocr"))


def _run(stream, spark, mode: str, store: str | None = None):
    """A bounded run of a stream into Parquet files of the shared folder, read back; nothing passes the driver.

    In append mode the file sink commits every batch once.  In complete mode each batch is the whole result
    and goes to a folder of its own, over which a batch that runs again writes; the last one counts.
    The state store's provider is set for this run only.
    """
    key, path, batches = "spark.sql.streaming.stateStore.providerClass", scratch(spark, "stream"), []
    before = spark.conf.get(key, None)
    if store:
        spark.conf.set(key, store)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        if mode == "append":
            run = writer.format("parquet").option("path", f"{path}/rows").start()
        else:

            def keep(batch, number):
                batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
                batches.append(number)

            run = writer.foreachBatch(keep).start()
        run.awaitTermination()
    finally:
        if store and before is None:
            spark.conf.unset(key)
        elif store:
            spark.conf.set(key, before)
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    return spark.read.schema(stream.schema).parquet(f"{path}/batch={max(batches)}") if batches else spark.createDataFrame([], stream.schema)


@query("st_budget_stream", f"WITH {_R} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS used FROM req GROUP BY 1")
def st_budget_stream(spark, sf_dir):
    """The daily counter as a stream of tumbling windows."""
    from sparkfolio.streaming import requests as Q

    return _run(Q.daily_usage(Q.request_stream(spark, sf_dir)), spark, "complete")


@query("st_session_stream", f"WITH {_R}, n AS (SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS used FROM req) SELECT *, used < 40 AS allowed FROM n")
def st_session_stream(spark, sf_dir):
    """The session cap as a stateful stream."""
    from sparkfolio.streaming import requests as Q

    return _run(Q.capped(Q.request_stream(spark, sf_dir)), spark, "append", Q.STATE_STORE).select("event_id", "session_id", "used", "allowed")


@query("st_activity")
def st_activity(spark, sf_dir):
    """Activity sessions with a gap of thirty minutes; open ones stay in state."""
    from sparkfolio.streaming import requests as Q

    return _run(Q.sessions(Q.request_stream(spark, sf_dir)), spark, "append")


@query("st_dedup", "SELECT count(DISTINCT event_id) AS n FROM events")
def st_dedup(spark, sf_dir):
    from sparkfolio.streaming import requests as Q

    return _run(Q.first_seen(Q.request_stream(spark, sf_dir)).select("event_id"), spark, "append").agg(F.count("*").alias("n"))


@query("dq_health", "SELECT * FROM (VALUES (1, 'index', 'ok'), (2, 'readable', 'ok'), (3, 'not empty', 'ok'), (4, 'provider', 'no provider')) t(step, name, state)")
def dq_health(spark, sf_dir):
    """Start-up checks in order; the first failing one is the last reported."""
    n = X.table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    step = lambda i, name, state: F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), state.alias("state"))
    steps = F.array(
        step(1, "index", F.lit("ok")), step(2, "readable", F.lit("ok")),
        step(3, "not empty", F.when(F.col("n") > 0, "ok").otherwise("empty")), step(4, "provider", F.lit("no provider")),
    )
    return n.select(F.inline(steps))


@query("src_gold", "SELECT item_id::VARCHAR AS id, text AS question, item_id % 2 = 0 AS answerable, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END AS n_sources FROM benchmark")
def src_gold(spark, sf_dir):
    """A gold set written as one nested JSON document and read back under its schema."""
    from sparkfolio.sources.files import read_gold

    path = scratch(spark, "gold")
    even = F.col("item_id") % 2 == 0
    source = F.struct(F.lit("doc-1").alias("doc_id"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.lit("q").alias("quote"))
    q = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), even.alias("answerable"), F.when(even, F.array(source)).otherwise(F.slice(F.array(source), 1, 0)).alias("sources"))
    X.table(spark, sf_dir, "benchmark").agg(F.collect_list(q).alias("questions")).coalesce(1).write.json(path)
    return read_gold(spark, path).select("id", "question", "answerable", F.size("sources").alias("n_sources"))


@query("src_chunks", f"WITH {X.CHUNKS_SQL} SELECT chunk_id, doc_id, page_end, content FROM chunks")
def src_chunks(spark, sf_dir):
    from sparkfolio.sources.files import read_chunks, write_records

    path = scratch(spark, "chunks")
    write_records(X.chunks(spark, sf_dir), path)
    return read_chunks(spark, path).select("chunk_id", "doc_id", "page_end", "content")


@query("src_glob", "SELECT 3 AS n_files, 0 AS n_other, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM documents")
def src_glob(spark, sf_dir):
    """Top-level files of one pattern only: other suffixes and files in sub-folders are left out."""
    from sparkfolio.sources.files import corpus_files, corpus_lines

    path = scratch(spark, "corpus")
    docs = X.table(spark, sf_dir, "documents").select(F.to_json(F.struct("text")).alias("value"))
    docs.repartition(3).write.text(path)
    docs.limit(10).repartition(2).write.text(f"{path}/inner")
    docs.limit(10).select("value").repartition(2).write.mode("append").json(path)
    found = corpus_files(spark, path, "part-*.txt")
    other = found.where(~F.col("path").endswith(".txt") | F.col("path").contains("/inner/")).agg(F.count("*").cast("int").alias("n_other"))
    rows = corpus_lines(spark, path, "part-*.txt").select(F.from_json("value", "text string")["text"].alias("text"))
    n = found.where("length > 0").agg(F.count("*").cast("int").alias("n_files"))
    return n.crossJoin(other).crossJoin(rows.agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars")))


@query("src_cmanifest", "SELECT 'missing' AS state, 0 AS n_documents UNION ALL SELECT 'not an object', 0 UNION ALL SELECT 'broken', 0 UNION ALL SELECT 'good', count(*)::INT FROM documents")
def src_cmanifest(spark, sf_dir):
    """A manifest that is missing, broken or no object is an empty one."""
    from sparkfolio.sources.files import read_manifest, write_manifest

    paths = {name: scratch(spark, "manifest") for name in ("missing", "not an object", "broken", "good")}
    for name, text in (("not an object", "[1, 2]"), ("broken", '{"documents": [')):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(paths[name])
    write_manifest(X.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), paths["good"])
    counts = [read_manifest(spark, p).agg(F.count("*").cast("int").alias("n_documents")).select(F.lit(name).alias("state"), "n_documents") for name, p in paths.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("st_log", "SELECT count(*) AS n FROM events")
def st_log(spark, sf_dir):
    """The query log as a streaming file sink."""
    from sparkfolio.streaming import requests as Q

    path = scratch(spark, "log")
    Q.append_log(Q.request_stream(spark, sf_dir), path, f"{path}-checkpoint").awaitTermination()
    return spark.read.json(path).agg(F.count("*").alias("n"))


@query("st_retry", "SELECT event_id, list_sum(list_transform(range(0, (event_id % 4)::BIGINT), lambda i: least(pow(2, i), 20)))::DOUBLE AS waited FROM events WHERE event_type = 'error' AND event_id % 4 > 0")
def st_retry(spark, sf_dir):
    """Waiting times of the backoff: doubling from a second, at most twenty each."""
    from sparkfolio.operators.providers import waits

    n = (F.col("event_id") % 4).cast("int")
    errors = X.requests(spark, sf_dir).where("failed AND event_id % 4 > 0")
    return errors.select("event_id", F.aggregate(waits(n), F.lit(0.0), lambda a, x: a + x).alias("waited"))

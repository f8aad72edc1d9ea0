"""URL filter lists as a sort-merge range join.

A host is written with its labels reversed and a dot after each
(``blog.example.org`` -> ``org.example.blog.``).  In that order a rule for a host
and all its subdomains is an interval of keys, and the intervals of all rules are
nested or disjoint.  Pages and rules are sorted into one stream; a sweep keeps the
stack of rules whose interval contains the current key and picks the longest whose
path is a prefix of the page's path.

The stream is range-partitioned by (key, path, page id), so a host with a third of
all pages is spread over many tasks.  A task that starts inside an interval gets the
rules that began earlier as *carried* rows: they are found by joining the label
prefixes of each task's first key (at most as many as a host has labels) to the
rules.  Nothing is broadcast and no rule table is collected.

Defined results for odd input: a null url, or one without ``://``, has an empty host
and path and fits no rule; repeated rows are judged one by one; equal rules with
different verdicts count as ``block``; two fitting rules of the same length: the
longer host wins; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stash

#: host/path, verdict
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SWEPT = "page_id long, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels reversed, a dot after each; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))
    )


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stack: list[tuple[str, int, dict[str, tuple[str, str]], list[int]]] = []
    part = None
    for batch in batches:
        out = []
        for p, key, kind, path, page, host, rule, verdict in zip(
            batch["part"], batch["key"], batch["kind"], batch["path"], batch["page_id"], batch["host"], batch["rule"], batch["verdict"], strict=True
        ):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, rule.index("/") if "/" in rule else len(rule), {}, []))
                paths, lengths = stack[-1][2:]
                known = paths.get(path)
                if known is None or known[1] != "block":
                    paths[path] = (rule, verdict)
                if len(path) not in lengths:
                    lengths.append(len(path))
                    lengths.sort(reverse=True)
                continue
            best, best_size = None, (-1, -1)
            for _, host_size, paths, lengths in stack:
                for n in lengths:
                    found = paths.get(path[:n]) if n <= len(path) else None
                    if found is not None:
                        if (host_size + n, host_size) > best_size:
                            best, best_size = found, (host_size + n, host_size)
                        break
            out.append((page, host, path, *(best or (None, None))))
        frame = pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])
        yield frame.astype({"page_id": "Int64"})


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, the longest fitting rule (else null) and its verdict (else ``default``).

    ``rules`` has the columns ``rule`` (host, then a path from the first ``/`` on)
    and ``verdict``.
    """
    rule_host = F.translate(F.regexp_extract("rule", r"(?s)^([^/]*)", 1), _UPPER, _LOWER)
    listed = rules.where(F.col("rule").isNotNull()).select(
        host_key(rule_host).alias("key"),
        F.lit(0).alias("kind"),
        F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("path"),
        F.lit(None).cast("long").alias("page_id"),
        F.lit(None).cast("string").alias("host"),
        "rule",
        "verdict",
    )
    asked = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select(
        host_key(F.col("host")).alias("key"),
        F.lit(1).alias("kind"),
        "path",
        "page_id",
        "host",
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("verdict"),
    )
    order = ["key", "kind", "path", "page_id"]
    stream = stash(
        asked.unionByName(listed).repartitionByRange(*order).select(F.spark_partition_id().alias("part"), "*"), "url-stream"
    )
    first = stream.groupBy("part").agg(F.min(F.struct(*order)).alias("first"))
    labels = F.split(F.col("first.key"), r"(?<=\.)")
    starts = first.select(
        "part",
        "first",
        F.explode(F.transform(F.filter(labels, lambda x: x != ""), lambda _, i: F.array_join(F.slice(labels, F.lit(1), i + 1), ""))).alias("_prefix"),
    )
    carried = (
        starts.join(listed, F.col("_prefix") == F.col("key"))
        .where(F.struct(*order) < F.col("first"))
        .select("part", "key", "kind", "path", "page_id", "host", "rule", "verdict")
    )
    swept = (
        stream.unionByName(carried)
        .repartition("part")
        .sortWithinPartitions("part", *order)
        .transform(map_batches, _sweep, _SWEPT)
    )
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op4_url_rules(spark, sf_dir):
    """The registered query: every url of ``pages`` under the five rules."""
    rules = spark.createDataFrame(list(RULES), "rule string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
       ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)) AS host,
             regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
      FROM p JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.n = 1
"""

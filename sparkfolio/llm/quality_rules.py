"""Rule-based quality filter: a threshold table compiled into Spark projections.

Every statistic is a built-in expression (no Python on the executors, no shuffle),
so the operator is a narrow map over the scan.  A rule is a row
``(name, metric, comparison, bound)``; :func:`compile_rules` turns the table into
one boolean column per rule and their conjunction.

Defined results for odd input: a null text counts as an empty one (no words, base
rules fail); very long texts are processed whole; repeated rows give repeated rows;
an empty table gives an empty result; columns of the input other than the id and
the text are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, word_array

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on this from at or an are not "
    "le la les de des du et un une en que qui dans pour est par sur pas au avec "
    "der die das und den von zu mit sich auf ist ein eine nicht dem im "
    "el los las y se del al su con una lo como"
).split()

#: metric, comparison, bound.  A document is kept if every comparison holds.
DEFAULT_RULES = (
    ("mean_word_length_min", "mean_word_length", ">=", 2.0),
    ("mean_word_length_max", "mean_word_length", "<=", 12.0),
    ("symbol_to_word", "symbol_ratio", "<=", 0.1),
    ("stop_words", "stop_word_ratio", ">=", 0.01),
    ("upper_case", "upper_ratio", "<=", 0.4),
    ("digits", "digit_ratio", "<=", 0.3),
    ("duplicate_lines", "dup_line_ratio", "<=", 0.5),
    ("bullet_lines", "bullet_line_ratio", "<=", 0.9),
    ("ellipsis_lines", "ellipsis_line_ratio", "<=", 0.3),
)

_COMPARE = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
}


def compile_rules(rules=DEFAULT_RULES) -> list[Column]:
    """One boolean column per rule of the table, named ``rule_<name>``."""
    return [_COMPARE[op](F.col(metric), F.lit(bound)).alias(f"rule_{name}") for name, metric, op, bound in rules]


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def quality_rules(
    docs: DataFrame,
    rules=DEFAULT_RULES,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Statistics, rule outcomes and verdict for every document.

    ``n_repeat_words`` counts the words covered by a 3-word window that occurs at
    least twice in the text.  Windows are compared by a 64-bit hash of the three
    words, sorted with their positions once per document, so the cost is
    n log n in the document's length.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_t"),
        word_array(F.col(text_col)).alias("_w"),
    )
    n = F.size("_w")
    windows = F.when(
        n >= 4,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(F.col("_w"), i), F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)),
        ),
    )
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    stop = sorted({v for w in STOP_WORDS for v in (w, w.capitalize())})
    counted = base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate("_t", WS_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", "0123456789", ""))).cast("long").alias("n_digits"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size(F.filter("_w", lambda w: w.isin(*stop))).cast("long").alias("n_stop_words"),
        lines.alias("_l"),
        windows.alias("_h"),
    )
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    sorted_windows = F.when(repeated, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    lined = counted.select(
        "*",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_l", lambda x: F.substring(F.btrim(x, F.lit(WS_CHARS)), 1, 1).isin("-", "*", "•", "‣", "–")))
        .cast("long")
        .alias("n_bullet_lines"),
        F.size(F.filter("_l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        sorted_windows.alias("_s"),
    ).drop("_l", "_h")
    same = lambda x, k: x["h"] == F.get(F.col("_s"), k)["h"]
    starts = F.sort_array(
        F.transform(
            F.filter("_s", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))),
            lambda x: x["i"],
        )
    )
    marked = lined.select("*", starts.alias("_d")).drop("_s")
    covered = F.aggregate(
        "_d",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).cast("long").alias("n")),
        lambda a: a["n"],
    )
    stats = marked.select("*", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")).drop("_d")
    ratios = stats.select(
        "*",
        _share("word_chars", "n_words").alias("mean_word_length"),
        _share("n_symbols", "n_words").alias("symbol_ratio"),
        _share("n_stop_words", "n_words").alias("stop_word_ratio"),
        _share("n_upper", "word_chars").alias("upper_ratio"),
        _share("n_digits", "word_chars").alias("digit_ratio"),
        _share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        _share("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
        _share("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"),
        ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))).alias("base_failed"),
    )
    flags = compile_rules(rules)
    kept = ~F.col("base_failed")
    for flag in compile_rules(rules):
        kept = kept & flag
    return ratios.select("*", *flags, kept.alias("kept"))


def op2_quality_rules(spark, sf_dir):
    """The registered query: every document of ``documents`` under the default table."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_STOP = _sql_list(sorted({v for w in STOP_WORDS for v in (w, w.capitalize())}))
_WSQ = r"[\x20\x09-\x0D]"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
),
r AS (SELECT row_number() OVER () AS rid, * FROM d),
win AS (
  SELECT rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM r WHERE len(w) >= 4)
),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
s AS (
  SELECT r.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{_WSQ}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(translate(t, '0123456789', '')) AS BIGINT) AS n_digits,
         CAST(len(regexp_extract_all(t, '\p{{Lu}}')) AS BIGINT) AS n_upper,
         CAST(len(list_filter(w, lambda x: x IN ({_STOP}))) AS BIGINT) AS n_stop,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         len(list_filter(l, lambda x: trim(x, {_BLANK})[1:1] IN ('-', '*', '•', '‣', '–'))) AS n_bullet,
         len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM r LEFT JOIN cov USING (rid)
),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed) AND word_chars / n_words::DOUBLE BETWEEN 2.0 AND 12.0 AND n_symbols / n_words::DOUBLE <= 0.1
       AND n_stop / n_words::DOUBLE >= 0.01 AND n_upper / word_chars::DOUBLE <= 0.4 AND n_digits / word_chars::DOUBLE <= 0.3
       AND n_dup_lines / n_lines::DOUBLE <= 0.5 AND n_bullet / n_lines::DOUBLE <= 0.9 AND n_ellipsis / n_lines::DOUBLE <= 0.3 AS kept
FROM b
"""

"""Queries over table grids: the tables hold no grids, so each document carries a planted one."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio.functions import tables as G
from sparkfolio.registry import query
from sparkfolio.sources import fixtures as X

#: Planted grids, JSON; the fourth has a wrapped header, staggered columns, a repeated column.
GRIDS = (
    '[["Province","Value of","Value of"],["","(PKR Million)","(PKR Million)"],["Sindh","1,200","1,200"],["Punjab","30","30"]]',
    '[["Head","","Figure"],["","Medium-\\\\nterm",""],["a","","1"],["","b","2"]]',
    '[["Role","Duty"],["Lead","Coordinate all"],["Staff","Report"]]',
    '[["x"]]',
    '[["Col1","Name"],["1","A"],["2","B"],[null,"  C  D "]]',
)


def grids(spark, sf_dir):
    pick = F.get(F.array(*[F.lit(g.replace("\\\\n", "\\n")) for g in GRIDS]), (F.col("doc_id") % len(GRIDS)).cast("int"))
    return X.table(spark, sf_dir, "documents").select("doc_id", F.from_json(pick, "array<array<string>>").alias("grid"))


def _grids_sql() -> str:
    def literal(v):
        if isinstance(v, list):
            return "[" + ", ".join(map(literal, v)) + "]"
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    import json

    cases = " ".join(f"WHEN {i} THEN {literal(json.loads(g.replace(chr(92) * 2 + 'n', chr(92) + 'n')))}" for i, g in enumerate(GRIDS))
    return f"g AS (SELECT doc_id, CASE doc_id % {len(GRIDS)} {cases} END::VARCHAR[][] AS grid FROM documents)"


_CLEAN = r"""c AS (SELECT doc_id, list_filter(list_transform(grid, lambda r: list_transform(r, lambda x: trim(regexp_replace(regexp_replace(coalesce(x, ''), '(\w)[-‐‑][ \t]*\n[ \t]*([a-z])', '\1-\2', 'g'), '\s+', ' ', 'g')))), lambda r: len(list_filter(r, lambda x: x <> '')) > 0) AS rows FROM g)"""
_FLAT = "array_to_string(list_transform(@, lambda r: array_to_string(r, '|')), chr(10))"


def flat(grid):
    return F.array_join(F.transform(grid, lambda r: F.array_join(r, "|")), "\n")


@query("tab_clean", f"WITH {_grids_sql()}, {_CLEAN} SELECT doc_id, {_FLAT.replace('@', 'rows')} AS cells FROM c")
def tab_clean(spark, sf_dir):
    return grids(spark, sf_dir).select("doc_id", flat(G.clean(F.col("grid"))).alias("cells"))


_COLUMNS = """cols AS (SELECT doc_id, i, list_transform(rows, lambda r: coalesce(r[i], '')) AS col FROM (SELECT doc_id, rows, unnest(range(1, list_max(list_transform(rows, lambda r: len(r))) + 1)) AS i FROM c)),
filled AS (SELECT * FROM cols WHERE len(list_filter(col, lambda x: x <> '')) > 0), kept AS (SELECT *, lag(col) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM filled)"""


@query(
    "tab_dupcol",
    f"WITH {_grids_sql()}, {_CLEAN}, {_COLUMNS} SELECT doc_id, string_agg(array_to_string(col, '|'), chr(10) ORDER BY i) AS cells FROM kept WHERE before IS NULL OR before <> col GROUP BY doc_id",
)
def tab_dupcol(spark, sf_dir):
    return grids(spark, sf_dir).select("doc_id", flat(G.drop_repeated_columns(G.columns_of(G.clean(F.col("grid"))))).alias("cells"))


def tidy(spark, sf_dir):
    c = grids(spark, sf_dir).select("doc_id", G.clean(F.col("grid")).alias("rows"))
    c = c.select("doc_id", G.drop_repeated_columns(G.columns_of(F.col("rows"))).alias("cols"))
    return c.select("doc_id", G.rows_of(G.merge_columns(F.col("cols"))).alias("rows"))


@query("tab_merge")
def tab_merge(spark, sf_dir):
    return tidy(spark, sf_dir).select("doc_id", flat(F.col("rows")).alias("cells"))


@query("tab_header")
def tab_header(spark, sf_dir):
    return tidy(spark, sf_dir).select("doc_id", G.header_depth(F.col("rows")).alias("depth"), F.array_join(G.header(F.col("rows")), "|").alias("header"))


#: What the planted grids become, by hand.
_MARKDOWN = {
    0: "| Province | Value of (PKR Million) |\n| --- | --- |\n| Sindh | 1,200 |\n| Punjab | 30 |",
    1: "| Head Medium-term | Figure |\n| --- | --- |\n| a | 1 |\n| b | 2 |",
    2: "| Role | Duty |\n| --- | --- |\n| Lead | Coordinate all |\n| Staff | Report |",
    3: "",
    4: "|  | Name |\n| --- | --- |\n| 1 | A |\n| 2 | B |\n|  | C D |",
}


@query(
    "tab_md",
    "SELECT doc_id, CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _MARKDOWN.items()) + " END AS markdown FROM documents",
)
def tab_md(spark, sf_dir):
    return tidy(spark, sf_dir).select("doc_id", G.to_markdown(F.col("rows")).alias("markdown"))


@query("tab_gate", "SELECT doc_id, doc_id % 5 <> 3 AS reliable FROM documents")
def tab_gate(spark, sf_dir):
    return tidy(spark, sf_dir).select("doc_id", G.is_reliable(F.col("rows")).alias("reliable"))


@query("tab_split")
def tab_split(spark, sf_dir):
    """A long Markdown table of every document's lines, in parts with the header repeated."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("| "), F.replace(x, F.lit("|"), F.lit("/")), F.lit(" |")))
    table = F.concat(F.lit("| line |\n| --- |\n"), F.array_join(lines, "\n"))
    return X.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(G.split_markdown(table, 2400)).alias("part", "content"))


_UNITS = "units AS (SELECT doc_id, block, count(*) AS covered FROM (SELECT DISTINCT doc_id, block, x, unnest(range(iy0, iy1)) AS y FROM (SELECT *, unnest(range(ix0, ix1)) AS x FROM met)) GROUP BY 1, 2)"


@query(
    "jn_bbox",
    f"WITH {X.LAYOUT_SQL}, {_UNITS}, m AS (SELECT doc_id, block, count(*) AS n_tables, max((ix1 - ix0) * (iy1 - iy0) / area) AS largest FROM met GROUP BY 1, 2) "
    "SELECT b.doc_id, page, b.block, coalesce(n_tables, 0) AS n_tables, round(coalesce(largest, 0), 6) AS largest, round(coalesce(covered / ((x1 - x0) * (y1 - y0)), 0), 6) AS together "
    "FROM blocks b LEFT JOIN m ON b.doc_id = m.doc_id AND b.block = m.block LEFT JOIN units u ON b.doc_id = u.doc_id AND b.block = u.block",
)
def jn_bbox(spark, sf_dir):
    """Shares of every text block that its page's tables cover: the largest of one table, and that of all together."""
    from sparkfolio.operators import spatial

    blocks, tables = X.layout(spark, sf_dir)
    found = spatial.coverage(blocks, tables, ["doc_id", "page"], ["doc_id", "page", "block"])
    return found.select("doc_id", "page", "block", "n_tables", F.round("largest", 6).alias("largest"), F.round("together", 6).alias("together"))

"""Table grids (array of rows of cells) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_ratio(block: Column, area: Column) -> Column:
    """Share of a block's area (x0, y0, x1, y1) that another rectangle covers."""
    at = lambda c, i: F.get(c, F.lit(i))
    width = F.greatest(F.lit(0.0), F.least(at(block, 2), at(area, 2)) - F.greatest(at(block, 0), at(area, 0)))
    height = F.greatest(F.lit(0.0), F.least(at(block, 3), at(area, 3)) - F.greatest(at(block, 1), at(area, 1)))
    own = (at(block, 2) - at(block, 0)) * (at(block, 3) - at(block, 1))
    return F.when(own > 0, width * height / own).otherwise(F.lit(0.0))


def clean_cell(c: Column) -> Column:
    joined = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)(\w)[-‐‑][ \t]*\n[ \t]*([a-z])", "$1-$2")
    return F.btrim(F.regexp_replace(joined, r"\s+", " "))


def clean(grid: Column) -> Column:
    """Cells on one line, rows without any text dropped."""
    rows = F.transform(grid, lambda r: F.transform(r, clean_cell))
    return F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))


def width(grid: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))


def columns_of(grid: Column) -> Column:
    """The grid's columns; short rows are filled with empty cells."""
    return F.when(width(grid) > 0, F.transform(F.sequence(F.lit(0), width(grid) - 1), lambda i: F.transform(grid, lambda r: F.coalesce(F.get(r, i), F.lit(""))))).otherwise(
        F.array().cast("array<array<string>>")
    )


def rows_of(columns: Column) -> Column:
    n = F.coalesce(F.size(F.get(columns, F.lit(0))), F.lit(0))
    return F.when((F.size(columns) > 0) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(columns, lambda c: F.get(c, i)))).otherwise(
        F.array().cast("array<array<string>>")
    )


_NONE = "array<array<string>>"


def drop_repeated_columns(columns: Column) -> Column:
    """Columns that equal the one kept before them, and empty ones, go."""

    def step(kept, c):
        repeats = (F.size(kept) > 0) & F.coalesce(F.element_at(kept, -1) == c, F.lit(False))
        empty = ~F.exists(c, lambda x: x != "")
        return F.when(repeats | empty, kept).otherwise(F.concat(kept, F.array(c)))

    return F.aggregate(columns, F.array().cast(_NONE), lambda k, c: F.when(F.size(k) == 0, F.when(F.exists(c, lambda x: x != ""), F.array(c)).otherwise(k)).otherwise(step(k, c)))


def merge_columns(columns: Column) -> Column:
    """Neighbours that are never both filled in one row become one column."""

    def step(kept, c):
        last = F.element_at(kept, -1)
        both = F.exists(F.zip_with(last, c, lambda a, b: (a != "") & (b != "")), lambda x: x)
        joined = F.zip_with(last, c, lambda a, b: F.when(a != "", a).otherwise(b))
        return F.when(both, F.concat(kept, F.array(c))).otherwise(F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(joined)))

    return F.aggregate(columns, F.array().cast(_NONE), lambda k, c: F.when(F.size(k) == 0, F.array(c)).otherwise(step(k, c)))


def header_depth(grid: Column) -> Column:
    """How many first rows are one wrapped header: at most three and never all; data rows end it."""
    limit = F.least(F.lit(3), F.greatest(F.lit(1), F.size(grid) - 1))
    filled = lambda r: F.filter(r, lambda c: c != "")
    first = F.size(filled(F.get(grid, F.lit(0))))

    def step(state, i):
        row = filled(F.get(grid, i))
        numeric = F.size(F.filter(row, lambda c: c.rlike(r"\d")))
        ends = ((F.size(row) > 0) & (numeric * 2 >= F.size(row))) | (F.size(row) >= first)
        go = state["open"] & (i < limit) & ~ends
        return F.struct(go.alias("open"), F.when(go, i + 1).otherwise(state["depth"]).alias("depth"))

    start = F.struct(F.lit(True).alias("open"), F.lit(1).alias("depth"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2)), start, step, lambda s: s["depth"])


def header(grid: Column) -> Column:
    """The folded header: distinct parts of each column, placeholders dropped."""
    head = F.slice(grid, F.lit(1), header_depth(grid))
    parts = lambda c: F.array_distinct(F.filter(c, lambda x: (x != "") & ~F.lower(x).startswith("col")))
    every = F.transform(F.sequence(F.lit(0), F.greatest(width(grid) - 1, F.lit(0))), lambda i: F.transform(head, lambda r: F.coalesce(F.get(r, i), F.lit(""))))
    return F.transform(every, lambda c: F.array_join(parts(c), " "))


def to_markdown(grid: Column) -> Column:
    """A Markdown table; empty if there is no body."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    w = width(grid)
    body = F.slice(grid, header_depth(grid) + 1, F.size(grid))
    padded = F.transform(body, lambda r: line(F.slice(F.concat(r, F.array_repeat(F.lit(""), w)), F.lit(1), w)))
    rule = line(F.array_repeat(F.lit("---"), w))
    return F.when((F.size(grid) > header_depth(grid)) & (w > 0), F.array_join(F.concat(F.array(line(header(grid)), rule), padded), "\n")).otherwise(F.lit(""))


def is_reliable(grid: Column, min_cells: int = 4) -> Column:
    cells = F.aggregate(grid, F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda c: c != "")))
    return (F.size(grid) >= 2) & (cells >= min_cells) & (to_markdown(grid) != "")


def split_markdown(table: Column, limit: int) -> Column:
    """A table in parts of at most ``limit`` characters, each with the header; one huge row is a part of its own."""
    lines = F.split(table, "\n")
    head = F.array_join(F.slice(lines, 1, 2), "\n")
    rows = F.slice(lines, F.lit(3), F.size(lines))

    def step(state, row):
        fits = (state["held"] == "") | (F.length(head) + F.length(state["held"]) + F.length(row) + 2 <= limit)
        return F.struct(
            F.when(fits, state["out"]).otherwise(F.concat(state["out"], F.array(F.concat(head, F.lit("\n"), state["held"])))).alias("out"),
            F.when(~fits | (state["held"] == ""), row).otherwise(F.concat(state["held"], F.lit("\n"), row)).alias("held"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    parts = F.aggregate(rows, start, step, lambda s: F.when(s["held"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.concat(head, F.lit("\n"), s["held"])))))
    return F.when((F.size(lines) < 3) | (F.length(table) <= limit), F.array(table)).otherwise(parts)

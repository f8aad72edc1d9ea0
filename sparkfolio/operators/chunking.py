"""Chunking of page streams as a Spark plan, with page spans that need no search.

A stream (consecutive pages of one document) is one row.  Its text is cut into segments
that add up to it, so that every sentence, every group of sentences and every character
of a chunk has a known place in the text:

``stream_texts`` -> ``segments`` (native) -> ``judged`` (Arrow: places and distances of
sentences) -> ``grouped`` (native threshold and fold) -> ``pieces`` (rows) -> ``fitted``
(Arrow only for what is too long) -> overlap, fate and pages (native, one window).

Sentence vectors come from a pluggable embedder; the stand-in hashes words into signed
features.  Rules that other operators share live in ``functions.text``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions import text as T


@dataclass(frozen=True)
class ChunkSettings:
    strategy: str = "semantic"
    threshold: str = "percentile"
    amount: float = 90.0
    fallback_chars: int = 1200
    overlap_chars: int = 150
    min_chars: int = 120
    max_chars: int = 2400

    def __post_init__(self):
        if not self.overlap_chars < self.fallback_chars <= self.max_chars:
            raise ValueError("overlap < fallback size <= largest size is required")
        if self.strategy not in ("semantic", "recursive"):
            raise ValueError(f"unknown strategy {self.strategy}")
        if self.threshold not in LIMITS:
            raise ValueError(f"unknown threshold {self.threshold}")


_WORD = re.compile(r"[a-z0-9]+")
#: Where long text is cut, coarsest first; where none occurs, anywhere.
SEPARATORS = ("\n\n", "\n", ". ", " ")
#: A sentence with what separates it from the next; all segments of a text add up to it.
_SEGMENT = r"(?s).*?(?:(?<=[.!?])\s+|\n{2,}|\z)"


@lru_cache(maxsize=1 << 17)
def _hashed(word: str) -> int:
    return zlib.crc32(word.encode())


def hashed_vectors(texts: list[str], size: int = 64) -> np.ndarray:
    """Unit vectors of hashed words: the deterministic stand-in for a sentence model."""
    words = [_WORD.findall(t.lower()) for t in texts]
    h = np.fromiter(map(_hashed, chain.from_iterable(words)), np.int64)
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    out = np.bincount(row * size + h % size, np.where(h & 0x80000000, 1.0, -1.0), len(texts) * size).reshape(len(texts), size)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


# ---- spans of long text ---------------------------------------------------------------


def _atoms(text: str, size: int, step: int) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of at most ``size``, in order, cut behind the coarsest separators that do."""
    todo = [(0, len(text), 0)]
    while todo:
        start, end, level = todo.pop()
        if end - start <= size:
            yield start, end
        elif level == len(SEPARATORS):
            yield from ((i, min(i + step, end)) for i in range(start, end, step))
        else:
            behind = [m.end() for m in re.finditer(re.escape(SEPARATORS[level]), text[start:end])]
            edges = sorted({start, *(start + b for b in behind), end})
            todo += [(a, b, level + 1) for a, b in zip(edges[-2::-1], edges[:0:-1], strict=True)]


def long_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most ``size``; the next one goes back by whole parts, at most ``overlap`` characters."""
    atoms = list(_atoms(text, size, math.gcd(size, overlap) or 1))
    spans, first = [], 0
    for i, (_, end) in enumerate(atoms):
        if end - atoms[first][0] > size:
            done = atoms[i - 1][1]
            spans.append((atoms[first][0], done))
            first = next(j for j in range(first + 1, i + 1) if j == i or (done - atoms[j][0] <= overlap and end - atoms[j][0] <= size))
    if atoms:
        spans.append((atoms[first][0], atoms[-1][1]))
    solid = [(a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in spans]
    return [(a, b) for a, b in solid if a < b]


def _spans_of(size: int, overlap: int):
    @F.pandas_udf("array<struct<start int, end int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in long_spans(t, size, overlap)])

    return spans


# ---- sentences, distances, threshold ----------------------------------------------------


def _judged_by(embed: Callable[[list[str]], np.ndarray]):
    """Segments -> sentences with their start in the text, their place if all are joined by spaces, and the distance to the next one (null for the last, or if the model fails)."""

    @F.pandas_udf("array<struct<text string, start int, to int, distance double>>")
    def judged(rows: pd.Series) -> pd.Series:
        def one(segments):
            if segments is None:
                return None
            starts = np.cumsum([0, *map(len, segments)])
            found = [(s.strip(), int(at) + len(s) - len(s.lstrip())) for s, at in zip(segments, starts[:-1], strict=True) if s.strip()]
            distance: list = [None] * len(found)
            if len(found) > 2:
                try:
                    v = np.asarray(embed([t for t, _ in found]), float)
                    distance[:-1] = (1.0 - np.einsum("ij,ij->i", v[:-1], v[1:])).tolist()
                except Exception:  # noqa: BLE001 - a failing model must not lose the document
                    pass
            to = np.cumsum([0, *(len(t) + 1 for t, _ in found)])[:-1].tolist()
            return [{"text": t, "start": at, "to": p, "distance": d} for (t, at), p, d in zip(found, to, distance, strict=True)]

        return rows.map(one)

    return judged


def quantile(ordered: Column, share: float) -> Column:
    """The quantile of a sorted array, interpolated between neighbours."""
    place = F.lit(share) * (F.size(ordered) - 1)
    low = F.floor(place).cast("int")
    at = lambda i: F.get(ordered, F.least(i, F.size(ordered) - 1))
    return at(low) + (place - low) * (at(low + 1) - at(low))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


#: Distance above which a sentence may end a chunk, from the sorted distances of its stream.
LIMITS = {
    "percentile": lambda xs, amount: quantile(xs, amount / 100),
    "standard_deviation": lambda xs, amount: _mean(xs) + amount * F.sqrt(F.greatest(_mean(F.transform(xs, lambda x: x * x)) - _mean(xs) * _mean(xs), F.lit(0.0))),
    "interquartile": lambda xs, amount: quantile(xs, 0.75) + amount * (quantile(xs, 0.75) - quantile(xs, 0.25)),
}


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def threshold_of(distances: Column, kind: str, amount: float) -> Column:
    """The limit of an array of distances; without any, none is above it."""
    return F.when(F.size(distances) > 0, _let(F.array_sort(distances), lambda xs: LIMITS[kind](xs, amount))).otherwise(F.lit(float("inf")))


def grouped(sentences: Column, limit: Column, min_chars: int) -> Column:
    """(first, last) sentence of each chunk: one ends where the distance is above the limit and it has the characters."""

    def step(state, i):
        s = F.get(sentences, i)
        run = state["run"] + F.length(s["text"]) + 1
        cut = (s["distance"] > limit) & (run >= min_chars)
        ends = F.coalesce(cut, F.lit(False)) | (i == F.size(sentences) - 1)
        done = F.when(ends, F.concat(state["done"], F.array(F.struct(state["first"].alias("first"), i.alias("last"))))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(ends, i + 1).otherwise(state["first"]).alias("first"), F.when(ends, 0).otherwise(run).alias("run"))

    start = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("run"))
    return F.aggregate(F.sequence(F.lit(0), F.size(sentences) - 1), start, step, lambda s: s["done"])


# ---- the plan ---------------------------------------------------------------------------


def stream_texts(streams: DataFrame) -> DataFrame:
    """doc_id, stream, text (pages joined by blank lines) and ``pages`` (at: where in the text, page: its number).

    Places are running sums over a stream's pages; pages without content take no place.
    """
    before = Window.partitionBy("doc_id", "stream").orderBy("page_number", "content").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("content") + 2).over(before), F.lit(0)).cast("int")
    placed = streams.where(F.col("content").isNotNull()).select("doc_id", "stream", "page_number", "content", at.alias("at"))
    rows = placed.groupBy("doc_id", "stream").agg(F.array_sort(F.collect_list(F.struct("at", "page_number", "content"))).alias("_p"))
    return rows.select(
        "doc_id", "stream", F.array_join(F.transform("_p", lambda p: p["content"]), "\n\n").alias("text"),
        F.transform("_p", lambda p: F.struct(p["at"].alias("at"), p["page_number"].alias("page"))).alias("pages"),
    )


def _pieces(texts: DataFrame, s: ChunkSettings, embed) -> DataFrame:
    """One row per piece of each text: its core, where its parts come from (``map``: to, at), and how it was made."""
    long = F.length("text") > s.fallback_chars
    segments = F.when(long & F.lit(s.strategy == "semantic"), F.regexp_extract_all("text", F.lit(_SEGMENT), F.lit(0)))
    rows = texts.withColumn("_s", _judged_by(embed)(segments))
    several = F.size("_s") > 2
    semantic = F.coalesce(several & F.get("_s", F.lit(0))["distance"].isNotNull(), F.lit(False))
    distances = F.transform(F.slice("_s", F.lit(1), F.size("_s") - 1), lambda x: x["distance"])
    groups = F.when(semantic, _let(threshold_of(distances, s.threshold, s.amount), lambda limit: grouped(F.col("_s"), limit, s.min_chars)))

    def part(core, places):
        return F.struct(core.alias("core"), places.alias("map"))

    def of_group(g):
        own = F.slice("_s", g["first"] + 1, g["last"] - g["first"] + 1)
        before = F.get("_s", g["first"])["to"]
        return part(F.array_join(F.transform(own, lambda x: x["text"]), " "), F.transform(own, lambda x: F.struct((x["to"] - before).alias("to"), x["start"].alias("at"))))

    one = F.array(F.struct(F.lit(0).alias("to"), F.lit(0).alias("at")))
    lead = F.length("text") - F.length(F.regexp_replace("text", r"(?U)^\s+", ""))
    short = F.when(T.strip(F.col("text")) != "", F.array(part(T.strip(F.col("text")), F.array(F.struct(F.lit(0).alias("to"), lead.alias("at"))))))
    whole = F.array(part(F.col("text"), one))
    recursive = F.lit(s.strategy == "recursive") | (long & ~semantic)
    made = F.when(recursive, whole).when(semantic, F.transform(groups, of_group)).otherwise(short)
    return rows.select(
        "doc_id", "stream", "text", "pages", F.when(recursive, "recursive").otherwise("semantic").alias("strategy"), F.posexplode(made).alias("_i", "_piece")
    ).select("doc_id", "stream", "text", "pages", "strategy", "_i", "_piece.*")


def chunk_pages(streams: DataFrame, settings: ChunkSettings = ChunkSettings(), embed=hashed_vectors) -> DataFrame:
    """Every piece of every stream with its fate (kept, short, noise); ``streams`` has doc_id, stream, page_number and content.

    ``located`` says that the piece, white space aside, is what the text has between its ends.
    """
    s = settings
    pieces = _pieces(stream_texts(streams), s, embed)
    too_long = F.when((F.col("strategy") == "recursive") | (F.length("core") > s.max_chars), F.col("core"))
    spans = F.coalesce(_spans_of(s.fallback_chars, s.overlap_chars)(too_long), F.array(F.struct(F.lit(0).alias("start"), F.length("core").alias("end"))))
    fitted = pieces.select("*", F.posexplode(spans).alias("_j", "_span"))

    def place(x):
        return _let(F.element_at(F.filter("map", lambda m: m["to"] <= x), -1), lambda of: of["at"] + x - of["to"])

    cut = fitted.select(
        "doc_id", "stream", "pages", "strategy", "_i", "_j", "text",
        F.substring("core", F.col("_span.start") + 1, F.col("_span.end") - F.col("_span.start")).alias("core"),
        place(F.col("_span.start")).alias("_from"), place(F.col("_span.end") - 1).alias("_to"),
    )
    solid = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    # The place is found before the pages are gone through, and not again for each of them.
    page = lambda x: _let(x, lambda at: F.element_at(F.filter("pages", lambda p: p["at"] <= at), -1)["page"])
    # The stream's text and pages are needed no longer, so they don't go through the window's sort with every piece.
    placed = cut.select(
        "doc_id", "stream", "_i", "_j", "core", page(F.col("_from")).alias("page_start"), page(F.col("_to")).alias("page_end"), "strategy",
        (solid(F.substring("text", F.col("_from") + 1, F.col("_to") - F.col("_from") + 1)) == solid(F.col("core"))).alias("located"),
    )
    order = Window.partitionBy("doc_id", "stream").orderBy("_i", "_j")
    rows = placed.select(
        "doc_id", "stream", (F.row_number().over(order) - 1).alias("piece"), F.lag("core").over(order).alias("_before"), "core", "page_start", "page_end", "strategy", "located"
    )
    budget = F.greatest(F.lit(0), F.least(F.lit(s.overlap_chars), s.max_chars - F.length("core") - 1))
    before = F.coalesce(T.overlap_tail(F.col("_before"), budget), F.lit(""))
    fate = F.when(F.length(T.strip(F.col("core"))) < s.min_chars, "short").when(T.is_low_information(F.col("core")), "noise").otherwise("kept")
    return rows.select(
        "doc_id", "stream", "piece", F.when(before == "", F.col("core")).otherwise(F.concat(before, F.lit(" "), F.col("core"))).alias("content"),
        F.length("core").alias("core_chars"), "page_start", "page_end", "strategy", fate.alias("fate"), "located",
    )


def chunk_documents(streams: DataFrame, settings: ChunkSettings = ChunkSettings(), embed=hashed_vectors) -> DataFrame:
    """The kept chunks, numbered within their document, with location ids."""
    kept = chunk_pages(streams, settings, embed).where("fate = 'kept'")
    ordinal = (F.row_number().over(Window.partitionBy("doc_id").orderBy("stream", "piece")) - 1).alias("ordinal")
    numbered = kept.select("*", ordinal)
    return numbered.select(T.location_id(F.col("doc_id"), F.col("page_start"), F.col("page_end"), F.col("ordinal")).alias("chunk_id"), "*")

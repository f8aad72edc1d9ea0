"""Quality classifier: histogram gradient-boosted trees over document statistics.

*Statistics.*  One pass over each whole text gives a fixed vector of counts and ratios
(:data:`FEATURES`).  Only the text is used; ids, labels, language and source are not.

*Fitting.*  Labelled rows whose ``crc32(doc_id) mod 3`` is not 1 are used, at most
``max_train_rows`` of them: those with the least hash of their id, a documented bound
that makes the sample the same on every run and the fit independent of the corpus
size.  Their statistics (a few MB) come to the driver.  Features are cut into at most
``max_bins`` quantile bins; each tree level builds gradient and hessian histograms
with ``numpy.bincount`` and takes the best split of every node at once.

*Scoring.*  All trees are complete binary trees of one depth, flattened into arrays
(feature, threshold, leaf); a batch of rows walks all trees level by level by
vectorised indexing.

Defined results for odd input: null texts count as empty ones and get the score of
their (all zero) statistics; very long texts are processed whole; a null doc_id is
held out of training; labels that are null are ignored, of contradictory labels the
lower counts; without usable labels of both kinds every score is the share of label 1
(0.5 without labels); repeated rows are scored alike; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches

FEATURES = (
    "n_chars", "n_words", "n_lines", "mean_word", "words_per_line", "distinct_words", "distinct_lines", "top_word",
    "repeat_trigrams", "upper_chars", "digit_chars", "space_chars", "alpha_words", "comma", "stop", "question",
    "exclamation", "quote", "bracket", "pipe", "hash", "percent", "ampersand", "star", "dollar", "other_symbols",
    "non_ascii", "longest_word", "short_words", "end_marks",
)

MAX_TRAIN_ROWS = 20_000


def _ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def text_statistics(text: str | None) -> list[float]:
    """The vector of :data:`FEATURES` of one text."""
    t = text or ""
    n = len(t)
    words = t.split()
    m = len(words)
    lines = [x for x in t.split("\n") if x.strip()]
    c = t.count
    letters = sum(map(len, words))
    distinct = set(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    trigrams = len(set(zip(words, words[1:], words[2:], strict=False))) if m > 2 else 0
    sizes = list(map(len, words))
    alpha = sum(map(str.isalpha, words))
    lowered = t.lower()
    upper = sum(map(str.__ne__, t, lowered)) if len(lowered) == n else sum(x.isupper() for x in t)
    digits = sum(map(c, "0123456789"))
    marks = [c(x) for x in ",.?!"]
    quotes = c('"') + c("'")
    brackets = sum(map(c, "()[]{}"))
    symbols = [c(x) for x in "|#%&*$"]
    others = sum(map(c, "<>=_/\\^~@+;:"))
    return [
        np.log1p(n), np.log1p(m), np.log1p(len(lines)), _ratio(letters, m), np.log1p(_ratio(m, len(lines))),
        _ratio(len(distinct), m), _ratio(len(set(lines)), len(lines)), _ratio(max(counts.values(), default=0), m),
        1 - _ratio(trigrams, m - 2) if m > 2 else 0.0, _ratio(upper, n), _ratio(digits, n), _ratio(n - letters, n),
        _ratio(alpha, m), _ratio(marks[0], m), _ratio(marks[1], m), _ratio(marks[2], m), _ratio(marks[3], m),
        _ratio(quotes, m), _ratio(brackets, m), *[_ratio(s, m) for s in symbols], _ratio(others, m),
        _ratio(len(t.encode("utf-8", "surrogatepass")) - n, n), np.log1p(max(sizes, default=0)), _ratio(sum(map((3).__gt__, sizes)), m),
        _ratio(sum(x.rstrip().endswith((".", "!", "?", "…")) for x in lines), len(lines)),
    ]


def statistics_matrix(texts) -> np.ndarray:
    rows = [text_statistics(t) for t in texts]
    return np.array(rows, dtype=np.float32) if rows else np.zeros((0, len(FEATURES)), np.float32)


@dataclass
class Trees:
    """Complete trees of equal depth in flat arrays; ``feature`` and ``threshold`` by heap position, ``leaf`` by last level."""

    base: float
    depth: int
    feature: np.ndarray  # (trees, 2 ** depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2 ** depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        tree = np.arange(len(self.feature))
        inner = (1 << self.depth) - 1
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            node = np.zeros((len(part), len(tree)), dtype=np.int64)
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                right = part[row, self.feature[tree, node]] > self.threshold[tree, node]
                node = 2 * node + 1 + right
            out[start : start + 4096] += self.leaf[tree, node - inner].sum(axis=1)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, max_bins: int = 64, l2: float = 1.0, min_hessian: float = 1.0
) -> Trees:
    """Logistic gradient boosting with histogram splits."""
    x = np.asarray(x, dtype=np.float32)
    y = np.asarray(y, dtype=float)
    n, width = x.shape if x.ndim == 2 else (0, len(FEATURES))
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not n or y.min() == y.max():
        return Trees(float(np.log(share / (1 - share))), depth, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, max_bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    bins = max(len(c) for c in cuts) + 1
    offset = np.arange(width) * bins
    flat = binned + offset  # a bin number over all features
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf, np.float32)
    leaf = np.zeros((trees, leaves))
    limit = np.array([len(c) for c in cuts])
    valid = np.arange(bins)[None, :] < limit[:, None]
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)  # position within the level
        for level in range(depth):
            count = 1 << level
            at = (node[:, None] * (width * bins) + flat).ravel()
            size = count * width * bins
            hg = np.bincount(at, np.repeat(g, width), size).reshape(count, width, bins).cumsum(axis=2)
            hh = np.bincount(at, np.repeat(h, width), size).reshape(count, width, bins).cumsum(axis=2)
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + l2) + (tg - hg) ** 2 / (th - hh + l2) - tg**2 / (th + l2)
            gain = np.where(valid[None] & (hh >= min_hessian) & (th - hh >= min_hessian), gain, -np.inf).reshape(count, -1)
            best = gain.argmax(axis=1)
            good = gain[np.arange(count), best] > 1e-9
            f, b = best // bins, best % bins
            heap = (1 << level) - 1 + np.arange(count)
            feature[t, heap] = np.where(good, f, 0)
            threshold[t, heap] = [cuts[i][j] if ok else np.inf for i, j, ok in zip(f, b, good, strict=True)]
            right = good[node] & (binned[np.arange(n), f[node]] > b[node])
            node = 2 * node + right
        sg, sh = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = -rate * sg / (sh + l2)
        margin += leaf[t][node]
    return Trees(base, depth, feature, threshold, leaf)


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_fold(doc_id) == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, text and quality of at most ``max_train_rows`` labelled documents that aren't held out."""
    usable = (
        labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train_rows)
    )
    # At most max_train_rows rows of 12 bytes: a proven bound, so this side may be broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, **options) -> Trees:
    rows = training_rows(docs, labels, max_train_rows)

    def run(batches):
        for batch in batches:
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "quality": batch["quality"].astype("int32"), "x": [r.tobytes() for r in statistics_matrix(batch["text"])]}
            )

    found = map_batches(rows, run, "doc_id long, quality int, x binary").toPandas()
    # Repeated rows of one document count once; the order is that of the ids, so reruns agree.
    found = found.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    x = np.frombuffer(b"".join(found["x"]), dtype=np.float32).reshape(-1, len(FEATURES))
    return fit_trees(x, found["quality"].to_numpy(), **options)


def score_quality(docs: DataFrame, trees: Trees, keep=("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and ``score``; texts are read once, batch by batch."""
    base, depth = trees.base, trees.depth
    arrays = docs.sparkSession.sparkContext.broadcast((trees.feature, trees.threshold, trees.leaf))
    kept = docs.select(*keep, F.col("text").alias("_text"))
    from pyspark.sql import types as T

    def run(batches):
        model = Trees(base, depth, *arrays.value)
        for batch in batches:
            score = model.predict(statistics_matrix(batch["_text"]))
            yield batch.drop(columns="_text").assign(_score=score)

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("_score", T.DoubleType())])
    return map_batches(kept, run, schema)


def op8_quality_gbt(spark, sf_dir):
    """The registered query: every document's score; fitted on the folds that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, trees).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier accepts, with their columns.

    Texts go to Python once and only a score comes back beside the row.
    """
    trees = fit_quality(docs, labels, **options)
    bounded_batches(docs.sparkSession)
    base, depth = trees.base, trees.depth
    arrays = docs.sparkSession.sparkContext.broadcast((trees.feature, trees.threshold, trees.leaf))

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        model = Trees(base, depth, *arrays.value)
        return pd.Series(model.predict(statistics_matrix(texts)) >= 0.5)

    return docs.where(accepted("text"))


def crc_fold(doc_id: int) -> int:
    """The fold of an id, in plain Python (for tests)."""
    return zlib.crc32(str(doc_id).encode()) % 3

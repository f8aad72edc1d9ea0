"""Model interfaces with deterministic offline stand-ins.

A real model plugs in as a function on batches; it is loaded once per worker, as the
function is called inside ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunking import hashed_vectors

BATCH = 32
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def embed(rows: DataFrame, text_col: str, vector_col: str = "vector", model: Callable[[list[str]], np.ndarray] = hashed_vectors, prefix: str = "") -> DataFrame:
    """Adds unit vectors of a text column; ``prefix`` goes before queries, never before documents."""
    kept = rows.drop(vector_col)

    def run(batches):
        for batch in batches:
            texts = [prefix + (t or "") for t in batch[text_col]]
            made = [model(texts[i : i + BATCH]) for i in range(0, len(texts), BATCH)]
            vectors = np.concatenate(made).astype(np.float32) if made else np.zeros((0, 0), np.float32)
            yield batch.assign(**{vector_col: list(vectors)})

    return kept.mapInPandas(run, T.StructType([*kept.schema.fields, T.StructField(vector_col, T.ArrayType(T.FloatType()))]))


def embed_queries(rows: DataFrame, text_col: str, model: Callable[[list[str]], np.ndarray] = hashed_vectors) -> DataFrame:
    return embed(rows, text_col, model=model, prefix=QUERY_PREFIX)

"""The composed path against its parts and plain numpy."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import corpus as C
from sparkfolio.operators import retrieval as R
from sparkfolio.operators.chunking import hashed_vectors
from sparkfolio.operators.models import QUERY_PREFIX

TOPICS = ["river flood relief boats", "heat wave water shade", "camp site rules tents", "quake rubble rescue dogs", "storm roof shelter radio"]
QUESTIONS = [(1, "where are relief boats in a flood"), (2, "shade and water in a heat wave"), (3, "rules of the camp"), (4, "unknown zebra")]


def text(topic, salt):
    return " ".join(f"{TOPICS[topic]} number {salt} part {i}" for i in range(8))


PAGES = [(f"d{k}", f"Title {k}", 2010 + k, 1, text(k % 5, k)) for k in range(10)]
# The same text in an older and a newer document, and one that differs by a word.
PAGES += [("old", "Old", 2001, 1, text(0, 0)), ("near", "Near", 2002, 1, text(1, 1) + " more")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    pages = spark.createDataFrame(PAGES, "doc_id string, title string, year int, page_number int, content string")
    return C.build(pages, str(tmp_path_factory.mktemp("corpus")))


def test_newest_of_similar_chunks_stays(corpus):
    rows = corpus.chunks.collect()
    by_doc = {r["doc_id"]: r for r in rows}
    assert "old" not in by_doc and "near" not in by_doc and len(by_doc["d0"]["duplicate_ids"]) >= 1 and len(by_doc["d1"]["duplicate_ids"]) >= 1
    everything = [i for r in rows for i in [r["chunk_id"], *r["duplicate_ids"]]]
    assert len(everything) == len(set(everything)) == 12
    assert (corpus.version.chunks, corpus.version.documents) == (len(rows), len(by_doc))


def test_four_modes(spark, corpus):
    questions = spark.createDataFrame(QUESTIONS, "query_id long, question string")
    rows = sorted(corpus.chunks.collect(), key=lambda r: r["pos"])
    settings = R.RetrievalSettings(dense_weight=0.5, sparse_weight=0.5)
    found = {}
    for mode in ("dense", "sparse", "hybrid", "hybrid_rerank"):
        got = C.ask(questions, corpus, replace(settings, mode=mode)).collect()
        found[mode] = {q: [r["chunk_id"] for r in sorted(got, key=lambda r: r["final_rank"]) if r["query_id"] == q] for q, _ in QUESTIONS}
    v = np.stack([hashed_vectors([r["content"]])[0].astype(np.float32).astype(float) for r in rows])
    for q, asked in QUESTIONS:
        score = np.round(v @ hashed_vectors([QUERY_PREFIX + asked])[0].astype(np.float32).astype(float), 6)
        order = sorted(range(len(rows)), key=lambda i: (-score[i], i))
        assert found["dense"][q] == [rows[i]["chunk_id"] for i in order[:5]]
    plain = R.ranked(R.bm25(questions, R.lexical_index(corpus.chunks)).join(corpus.chunks.select("chunk_id", "pos"), "chunk_id"), 5, F.col("pos")).collect()
    for q, _ in QUESTIONS:
        assert found["sparse"][q] == [r["chunk_id"] for r in sorted(plain, key=lambda r: r["rank"]) if r["query_id"] == q]
        both = set(found["dense"][q]) | set(found["sparse"][q])
        assert len(found["hybrid"][q]) == len(found["hybrid_rerank"][q]) == 5 and both & set(found["hybrid"][q])
    assert found["sparse"][4] == [] and found["hybrid"][4] == found["dense"][4]


def test_a_changed_page_is_indexed_anew(spark, tmp_path):
    schema = "doc_id string, title string, year int, page_number int, content string"
    first = C.build(spark.createDataFrame(PAGES[:6], schema), str(tmp_path))
    pages = [p if p[0] != "d3" else (*p[:4], text(3, 77)) for p in PAGES[:6]]
    second = C.build(spark.createDataFrame(pages, schema), str(tmp_path))
    assert first.version.states == {"new": 6} and second.version.states == {"same": 5, "changed": 1} and len(second.version.segments) == 2
    assert second.store.parity().first()["n_dense"] == 6

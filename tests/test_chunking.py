import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import chunking as C
from sparkfolio.operators.chunking import ChunkSettings, chunk_pages, long_spans


def pieces(spark, pages, settings=ChunkSettings(), **options):
    rows = spark.createDataFrame([("d", 0, n, t) for n, t in pages], "doc_id string, stream int, page_number int, content string")
    return chunk_pages(rows, settings, **options).orderBy("piece").collect()


def test_thresholds(spark):
    d = [10.0, 1.0, 3.0, 2.0]
    limit = lambda *a: spark.range(1).select(C.threshold_of(F.array(*map(F.lit, d)), *a)).first()[0]
    assert limit("percentile", 90) == pytest.approx(np.percentile(d, 90)) == pytest.approx(7.9)
    assert limit("standard_deviation", 1) == pytest.approx(4 + np.std(d))
    assert limit("interquartile", 1.5) == pytest.approx(np.percentile(d, 75) + 1.5 * np.subtract(*np.percentile(d, [75, 25])))
    none = F.array().cast("array<double>")
    assert spark.range(1).select(C.threshold_of(none, "percentile", 90)).first()[0] == float("inf")


def test_long_spans_fit_and_overlap():
    text = ". ".join(f"sentence number {i} about things" for i in range(200))
    spans = long_spans(text, 300, 60)
    assert all(0 < b - a <= 300 for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a < b for (a, _), (b, _) in zip(spans, spans[1:], strict=False))
    assert all(b >= c - 1 for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert any(c < b for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    solid = long_spans("x" * 1000, 300, 60)
    assert [b - a for a, b in solid][:-1] == [300] * (len(solid) - 1) and solid[1][0] == 240
    assert long_spans("", 300, 60) == [] and long_spans("   ", 300, 60) == []


def test_short_streams_stay_whole_and_blank_ones_vanish(spark):
    (only,) = pieces(spark, [(1, "  one short text ")])
    assert (only["content"], only["strategy"], only["fate"], only["located"]) == ("one short text", "semantic", "short", True)
    assert pieces(spark, [(1, "   ")]) == []


def test_failing_embedder_falls_back(spark):
    def broken(_):
        raise RuntimeError("no model")

    made = pieces(spark, [(1, "Word here. " * 300)], embed=broken)
    assert {r["strategy"] for r in made} == {"recursive"} and all(r["core_chars"] <= 1200 and r["located"] for r in made)


def test_few_sentences_fall_back(spark):
    made = pieces(spark, [(1, "word " * 400 + "end. " + "more " * 100)])
    assert {r["strategy"] for r in made} == {"recursive"}


def test_groups_against_a_plain_walk(spark):
    """The native threshold and fold cut where a walk over the sentences does."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    sentences = [" ".join(rng.choice(words[: 8 + 8 * (k // 15)], rng.integers(4, 16))) + rng.choice([".", "!", "?"]) for k in range(60)]
    text = "\n\n".join("  ".join(sentences[i : i + 7]) for i in range(0, 60, 7))
    v = C.hashed_vectors(sentences)
    distance = 1 - (v[:-1] * v[1:]).sum(axis=1)
    limit = np.percentile(distance, 80)
    wanted, start = [], 0
    for end in range(1, 61):
        own = sentences[start:end]
        if end == 60 or (distance[end - 1] > limit and len(" ".join(own)) + 1 >= 100):
            wanted.append(" ".join(own))
            start = end
    s = ChunkSettings(amount=80.0, min_chars=100, fallback_chars=500, overlap_chars=40, max_chars=5000)
    made = pieces(spark, [(1, text)], s)
    assert [r["core_chars"] for r in made] == [len(w) for w in wanted] and len(made) > 3
    assert made[0]["content"] == wanted[0] and all(r["content"].endswith(w) for r, w in zip(made, wanted, strict=True))
    assert all(r["located"] for r in made)
    # The overlap is what whole words of the chunk before fit in.
    for r, w, before in zip(made[1:], wanted[1:], wanted, strict=False):
        tail = r["content"][: -len(w)].strip()
        assert before.endswith(tail) and 0 < len(tail) <= 40


def test_oversized_pieces_are_cut_and_located(spark):
    sentences = [f"Sentence {i} keeps to one theme only, as all of them do." for i in range(80)]
    made = pieces(spark, [(n + 1, "  \n".join(sentences[n * 20 : n * 20 + 20])) for n in range(4)], ChunkSettings(max_chars=1300, fallback_chars=600))
    assert all(r["core_chars"] <= 1300 and len(r["content"]) <= 1300 and r["located"] for r in made)
    assert made[0]["page_start"] == 1 and made[-1]["page_end"] == 4
    for r in made:
        first = re.search(r"Sentence (\d+)", r["content"][-r["core_chars"] :])
        if first:
            assert r["page_start"] <= int(first[1]) // 20 + 1 <= r["page_end"]


def test_pieces_know_their_pages(spark):
    made = pieces(spark, [(3, "Alpha is here and it is long. " * 30), (4, "Beta follows on the next page. " * 30), (5, "Gamma ends the stream at last. " * 30)])
    assert made and all(r["located"] and 3 <= r["page_start"] <= r["page_end"] <= 5 for r in made)
    assert made[0]["page_start"] == 3 and made[-1]["page_end"] == 5


def test_settings_are_checked():
    for wrong in ({"overlap_chars": 2000}, {"strategy": "other"}, {"threshold": "other"}):
        with pytest.raises(ValueError):
            ChunkSettings(**wrong)


def test_streams_table(spark):
    made = pieces(spark, [(1, "Plain words fill this page. " * 20), (2, "||| --- |||")])
    assert {r["fate"] for r in made} <= {"kept", "short", "noise"} and made


def test_pages_without_content_take_no_place(spark):
    first, second = "first page words " * 12, "other words of a later page " * 12
    got = pieces(spark, [(1, None), (2, first), (3, None), (4, second)], ChunkSettings(strategy="recursive", fallback_chars=300, overlap_chars=0))
    for r in got:
        assert (r["page_start"], r["page_end"]) == (2 if "first" in r["content"] else 4, 4 if "later" in r["content"] else 2)
    assert any(r["page_start"] == 4 for r in got) and all(r["located"] for r in got)
    assert pieces(spark, [(1, None), (2, None)]) == []


def test_a_group_of_many_sentences_on_many_pages(spark):
    """Work grows with sentences and pages, not with their product or square."""
    rows = spark.createDataFrame([("d", n, f"All of these words are the same {'again' if n % 2 else 'later'}.") for n in range(1, 8001)], "doc_id string, page_number int, content string")
    began = time.time()
    made = C.chunk_documents(rows.withColumn("stream", F.lit(0)), ChunkSettings(threshold="standard_deviation", amount=9.0)).select("ordinal", "page_start", "page_end", "core_chars").orderBy("ordinal").collect()
    assert time.time() - began < 60
    assert len(made) > 200 and made[0]["page_start"] == 1 and made[-1]["page_end"] == 8000
    assert all(a["page_end"] >= b["page_start"] - 1 for a, b in zip(made, made[1:], strict=False)) and all(r["page_end"] - r["page_start"] < 40 for r in made)

"""Fingerprints, hard negatives and whitening: brute force, SQL, odd input."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkfolio.llm import dart_minhash, fingerprints, hard_negatives, whitening

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int"
#: Extra columns with the names that the operators use inside.
CLASHES = ("n", "x", "hash", "block", "kind", "low", "high", "p", "_w", "_x", "deviation", "component", "place", "first", "last", "_tie", "_at", "fingerprint", "keys", "anchor", "rank")


def with_clashes(df):
    return df.withColumns({c: F.lit(7) for c in CLASHES if c not in df.columns})


# ---- fingerprints --------------------------------------------------------------------


def shingle_set(text):
    words = text.encode("utf-8").split()  # bytes split at the six ASCII spaces
    n = dart_minhash.SHINGLE_WORDS
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_fingerprint(text):
    """One shingle and one permutation at a time, with Python's whole numbers."""
    values = {int(v) for v in fingerprints.shingles([text])[0]}
    times, plus = fingerprints.permutations(fingerprints.PERMUTATIONS)
    least = [min(((v * int(a) + int(b)) % 2**64 for v in values), default=2**64 - 1) for a, b in zip(times, plus, strict=True)]
    return [int(dart_minhash.mix64(np.array([m], np.uint64))[0]) >> 48 for m in least]


def test_fingerprints_equal_a_slow_version_across_pieces(monkeypatch):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(n)) for n in (0, 1, 4, 5, 6, 40, 300)] + ["", " \n "]
    whole = fingerprints.fingerprints(texts)
    assert [list(map(int, row)) for row in whole] == [slow_fingerprint(t) for t in texts]
    monkeypatch.setattr(fingerprints, "PIECE", 7)
    assert (fingerprints.fingerprints(texts) == whole).all()


def test_likeness_estimates_jaccard():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(900)]
    errors = []
    for share in (0.02, 0.1, 0.3, 0.6):
        for _ in range(8):
            a = rnd.sample(words, 400)
            b = [w if rnd.random() > share / 5 else "z" + w for w in a]
            p = fingerprints.fingerprints([" ".join(a), " ".join(b)])
            errors.append(fingerprints.likeness(p[0], p[1]) - jaccard(" ".join(a), " ".join(b)))
    assert max(map(abs, errors)) < 0.16 and abs(sum(errors) / len(errors)) < 0.03


def in_order(rows):
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), seed=42)) - (1 << 64 if h >> 63 else 0)
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, signed(r[1])))


def expected(rows):
    rows = in_order(rows)
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        own, changed, ahead = fingerprints.fingerprints([text, edited, following])
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.astype(">u2").tobytes().hex(), changed.astype(">u2").tobytes().hex(), float((own == changed).mean()), float((own == ahead).mean())))
    return out


def found(df):
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], bytes(r["fingerprint"]).hex(), bytes(r["edited_fingerprint"]).hex(), r["near_edited"], r["near_next"]) for r in df.collect()]


def by_text(rows):
    return sorted(rows, key=repr)


ODD = [
    (3, None), (1, ""), (2, " \t\n "), (5, "x" * 50_000), (4, "the word " * 30_000), (6, "same line here for all\nsame line here for all"), (6, "same line here for all\nsame line here for all"),
    (6, "another text of this id"), (None, "no id here"), (None, "no id there"), (7, "über \U0001f600 naïve words in a row"),
]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_neighbours_of_odd_rows(spark, parts):
    docs = with_clashes(spark.createDataFrame(ODD, "doc_id long, text string")).repartition(parts)
    assert by_text(found(fingerprints.with_next(docs))) == by_text(expected(ODD))


def test_neighbours_of_many_partitions(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(150), " ".join(rnd.choice(["a", "b", "c", "dd"]) for _ in range(rnd.randrange(30)))) for _ in range(300)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert by_text(found(fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")))) == by_text(expected(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_single_row_and_empty_table(spark):
    one = found(fingerprints.with_next(spark.createDataFrame([(9, "a b c d e f g h")], "doc_id long, text string")))
    assert one == expected([(9, "a b c d e f g h")]) and one[0][6] == 1.0
    assert found(fingerprints.with_next(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_registered_fingerprints_of_whole_tables(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = [tuple(r) for r in fingerprints.op11_fingerprints(spark, "/root/testdata/sf0.001").collect()]
    assert by_text(got) == by_text(expected(rows))


def test_near_pairs_are_verified_links_to_leaders(spark):
    rnd = random.Random(4)
    base = [[f"t{k}w{rnd.randrange(10**6)}" for _ in range(120)] for k in range(12)]
    rows, n = [], 0
    for words in base:
        for _ in range(rnd.randrange(1, 6)):
            copy = list(words)
            for _ in range(rnd.choice([0, 0, 1, 3, 12])):
                copy[rnd.randrange(len(copy))] = f"new{rnd.randrange(10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, ""), (n + 1, " "), (n + 2, None), (n + 3, "tiny text"), (n + 4, "tiny text"), (None, rows[0][1])]
    got = {(r["a"], r["b"]) for r in fingerprints.near_pairs(with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    texts = {i: t or "" for i, t in rows if i is not None}
    near = {(a, b) for a in texts for b in texts if a < b and (texts[a] == texts[b] or (shingle_set(texts[a]) and jaccard(texts[a], texts[b]) >= 0.8))}
    assert got <= near
    # Nothing that is near an earlier document is without a link.
    least = {b: min(a for a, x in near if x == b) for _, b in near}
    leaders = {b for b, a in least.items() if a not in least}
    assert leaders <= {b for _, b in got} | {a for a, _ in got}


# ---- hard negatives ------------------------------------------------------------------


def slow_negatives(rows):
    """rows: (vec_id, vector, label) as in the table."""
    size = max((len(v) for _, v, _ in rows if v is not None), default=0)
    good = set()
    for i, v, label in rows:
        if label is None or v is None or len(v) != size or any(c is None or not math.isfinite(c) for c in v):
            continue
        good.add((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, tuple(math.floor(256 * np.float32(c).astype(float)) for c in v)))
    out = []
    last = lambda i: (i is None, i or 0)
    for a, la, va in good:
        if a is None or a % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(va, v, strict=True)), i, lb) for i, lb, v in good if i != a), key=lambda s: (-s[0], last(s[1])))
        for p, i, _ in [s for s in scored if s[2] == la][:5]:
            inside = [s for s in scored if s[2] != la and 30 * p <= 100 * s[0] <= 90 * p][:10]
            out += [(a, i, k + 1, j, p, s) for k, (s, j, _) in enumerate(inside)]
    return sorted(out, key=repr)


def mined(df):
    found = hard_negatives.hard_negatives(hard_negatives.prepared(df), F.col("vec_id") % 100 == 0)
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found.collect()), key=repr)


def test_hard_negatives_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "MIN_BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "TILE_ITEMS", 32)
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 2)
    rnd = np.random.default_rng(5)
    rows = [(int(i), [float(c) for c in rnd.normal(size=8) / 3 + (i % 3 == 0)], int(i % 4)) for i in range(0, 700, 2)]
    rows += [(100, None, 1), (102, [float("nan")] * 8, 2), (104, [None] + [0.5] * 7, 2), (106, [0.5] * 3, 1), (108, [0.5] * 8, None), (110, [float("inf")] + [0.1] * 7, 0), (None, [0.5] * 8, 1)]
    rows += rows[:40] + [(200, rows[3][1], 3), (1, rows[0][1], 0), (3, rows[0][1], 2)]  # repeated rows, other rows of an id, ties
    df = with_clashes(spark.createDataFrame([(i, v, x) for i, v, x in rows], VECTORS))
    assert mined(df) == slow_negatives(rows) != []


def test_hard_negatives_of_little(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []
    assert mined(spark.createDataFrame([(0, [0.5, 0.5], 1)], VECTORS)) == []
    # A negative or zero score of the positive: no window, or only zeros.
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 2), (2, [0.0, 1.0], 2), (3, [0.0, -1.0], 3), (4, [1.0, 1.0], 4)]
    assert mined(spark.createDataFrame(rows, VECTORS)) == slow_negatives(rows)


def test_survivors_hold_every_pair_in_reach():
    rnd = np.random.default_rng(6)
    x, y = (rnd.integers(-300, 300, size=(n, 16)) for n in (200, 30))
    axes = np.linalg.qr(rnd.normal(size=(16, 16)))[0]
    items, anchors = hard_negatives.Rotated(x, axes), hard_negatives.Rotated(y, axes)
    product = x @ y.T
    low, high = np.quantile(product, 0.95, axis=0).round(), np.quantile(product, 0.99, axis=0).round()
    i, j = hard_negatives.survivors(items, slice(0, 200), anchors, slice(0, 30), low, high, np.ones((200, 30), bool))
    assert {(a, b) for a, b in np.argwhere((product >= low) & (product <= high))} <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(i) < 0.5 * product.size
    assert (hard_negatives._products(x, y, i, j) == product[i, j]).all()


def test_hard_negatives_equal_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    theirs = sorted(tuple(int(v) for v in r) for r in duck.sql(hard_negatives.ORACLE).fetchall())
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[c] for c in names) for r in hard_negatives.op12_hard_negatives(spark, SF).collect()) == theirs


# ---- whitening -----------------------------------------------------------------------


def slow_whitening(rows, components=32):
    size = max((len(v) for _, v in rows if v is not None), default=0)
    good = [(i, [math.floor(64 * np.float32(c).astype(float)) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in good], dtype=object)
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    value, vector = np.linalg.eigh((off.T @ off).astype(float) / n**3)
    value, vector = value[::-1], vector[:, ::-1]
    white = (off.astype(float) / n) @ vector[:, :components] / np.sqrt(np.maximum(value[:components], 1e-300))
    return [i for i, _ in good], n, (off**2).sum(axis=1), white, value


def test_whitening_against_whole_numbers(spark):
    rnd = np.random.default_rng(7)
    mix = rnd.normal(size=(40, 40))
    rows = [(int(i), [float(c) for c in mix @ rnd.normal(size=40)]) for i in range(300)]
    rows += [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [1.0] * 39 + [float("-inf")]), (904, [1.0] * 5), (905, [])] + rows[:20] + [(None, rows[5][1])]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    ready = whitening.finite_vectors(df, "embedding").select("vec_id", F.transform("embedding", lambda c: F.floor(c * 64) + F.lit(1_000_000).cast("long")).alias("x"))
    got = whitening.whiten(ready, "x").toPandas()
    ids, n, deviation, white, value = slow_whitening(rows)
    assert len(got) == 32 * len(ids) and set(got["n"]) == {n} and got["identity_error"].iloc[0] < 1e-9
    wide = got.assign(vec_id=got["vec_id"].astype("float").fillna(-1)).pivot_table(index="vec_id", columns="component", values="whitened", aggfunc="first")
    at = wide.loc[[-1.0 if i is None else float(i) for i in ids]].to_numpy()
    sign = np.sign((at * white).sum(axis=0))
    assert np.abs(at * sign - white).max() < 1e-8
    own = {(-1 if i is None else i): int(d) for i, d in zip(ids, deviation, strict=True)}
    assert all(own[-1 if v != v else int(v)] == d for v, d in zip(got["vec_id"].astype(float), got["deviation"], strict=True))
    share = got.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.allclose(share, value[:32] / value.sum(), rtol=1e-9)


def test_whitening_of_little(spark):
    schema = "vec_id long, x array<bigint>"
    assert whitening.whiten(spark.createDataFrame([], schema), "x").collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [5, 6])], schema), "x").collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    # The second dimension follows the first: one component, the other has no variance.
    flat = whitening.whiten(spark.createDataFrame([(i, [i, 2 * i]) for i in range(9)], schema), "x").collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and flat[0]["identity_error"] < 1e-9
    assert flat[0]["explained"] + flat[1]["explained"] == pytest.approx(1)


@pytest.mark.parametrize("d", [1, 2, 7, 8])
def test_every_pair_of_dimensions_is_summed_once(spark, d):
    rnd = np.random.default_rng(8)
    x = rnd.integers(-50, 50, size=(60, d))
    n, total, v = whitening.moments(spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>"), "x")
    assert n == 60 and total == x.sum(0).tolist() and np.allclose(v, np.cov(x.T, bias=True).reshape(d, d), rtol=1e-12)


def test_registered_whitening(spark):
    got = whitening.op13_whitening(spark, "/root/testdata/sf0.001").toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    ids, n, _, white, _ = slow_whitening(rows)
    at = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    # Signs are free; components with nearly equal eigenvalues are still apart in double precision.
    sign = np.sign((at * white).sum(axis=0))
    assert set(got["n"]) == {n} and np.abs(at * sign - white).max() < 1e-6 and got["identity_error"].max() <= 1e-4


# ---- components ----------------------------------------------------------------------


@pytest.mark.parametrize("few", [0, 25, 10_000])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(dart_minhash, "FEW_LINKS", few)
    rnd = random.Random(9)
    links = [(a, b) for a, b in ((rnd.randrange(120), rnd.randrange(120)) for _ in range(90)) if a < b] + [(200 + i, 201 + i) for i in range(40)]
    root = list(range(300))
    for _ in range(300):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    expected = {(n, root[n]) for link in links for n in link if root[n] != n}
    assert {(r["node"], r["root"]) for r in dart_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()} == expected
    assert dart_minhash.components(spark.createDataFrame([], "a long, b long")).collect() == []

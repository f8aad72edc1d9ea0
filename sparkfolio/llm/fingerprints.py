"""Document fingerprints: MinHash under universal hash permutations, bands joined in Spark, Jaccard verified.

*Fingerprint.*  A text is the set of its five-word shingles, each a 64-bit hash.  Every
odd multiplier and offset is a permutation of the 64-bit numbers; a text keeps the least
image of its shingles under each of ``PERMUTATIONS`` of them, mixed down to 16 bits.
Two fingerprints agree in a place with the Jaccard similarity of the two sets as probability
(and by chance once in 65,536), so the share of equal places estimates it: the likeness, with a
standard error of at most 0.045.  numpy takes the shingles of many texts as one flat array, a
permutation at a time, in pieces that stay in the processor's cache.

*Near pairs.*  ``near_pairs`` joins the bands of fingerprints in Spark.  Texts with equal sets
of shingles are collapsed first; each remaining text meets the least other member of every bucket
it is in, and the distinct pairs are verified by the Jaccard similarity of the whole sets.  That
makes links to leaders, not all pairs of a bucket, so a large group costs its size.

*Neighbours.*  ``with_next`` range-partitions rows by document id (and the text's hash, so that
ties spread), sorts each partition and compares neighbours in one stream.  Only the last row
of a partition waits for the first row of the next one that has rows; two rows for each
partition meet in a join afterwards.

Defined results for odd input: null texts are empty; texts of one to four words have one
shingle of all their words; texts without a word have the fingerprint of the empty set, and are
wholly like each other (1) and unlike all others.  Long texts are hashed whole, in pieces.
Rows follow each other by doc_id (null last), then by the text's 64-bit hash; repeated rows are
neighbours, and a single row is its own.  An empty table gives an empty result; other columns
don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stash, table
from .dart_minhash import SHINGLE_WORDS, THRESHOLD, _blocks, mix64, verify_pairs, word_hashes

PERMUTATIONS = 128
#: Bands and rows of ``near_pairs``: a pair at similarity 0.8 is missed with a probability of 5e-4.
BANDS, ROWS = 25, 5
#: Shingles hashed at once; with 64-bit numbers this stays in a core's cache.
PIECE = 1 << 15

_U = np.uint64
_FULL = _U(0xFFFFFFFFFFFFFFFF)


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of k permutations of the 64-bit numbers: the same in every run."""
    seed = mix64(np.arange(1, 2 * k + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return seed[:k] | _U(1), seed[k:]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, with the number of the text, in order; repeats stay."""
    word, doc = word_hashes(texts)
    n, k = len(word), SHINGLE_WORDS
    if not n:
        return word, doc
    value = np.zeros(n, _U)
    after, of = np.r_[word, np.zeros(k, _U)], np.r_[doc, np.full(k, -1)]
    for j in range(k):
        value = mix64(value * _U(0xD6E8FEB86659FD93) + np.where(of[j : j + n] == doc, after[j : j + n], _U(j + 1)))
    full = of[k - 1 : k - 1 + n] == doc
    keep = full | (np.r_[True, doc[1:] != doc[:-1]] & ~full)
    return value[keep], doc[keep]


def fingerprints(texts: list[str], k: int = PERMUTATIONS) -> np.ndarray:
    """(texts, k) of 16-bit numbers."""
    times, plus = permutations(k)
    found = []
    for block in _blocks(texts):
        value, doc = shingles(block)
        least = np.full((k, len(block)), _FULL)
        for s in range(0, len(value), PIECE):
            x, d = value[s : s + PIECE], doc[s : s + PIECE]
            start = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            to = d[start]
            h = np.empty_like(x)
            for i in range(k):
                np.multiply(x, times[i], out=h)
                np.add(h, plus[i], out=h)
                least[i, to] = np.minimum(least[i, to], np.minimum.reduceat(h, start))
        found.append((mix64(least.T) >> _U(48)).astype(np.uint16))
    return np.concatenate(found) if found else np.zeros((0, k), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places of fingerprints, row by row."""
    return (a == b).mean(axis=-1)


def _packed(prints: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes, the higher byte of a place first."""
    return [row.tobytes() for row in prints.astype(">u2")]


def fingerprinted(docs: DataFrame, k: int = PERMUTATIONS) -> DataFrame:
    """doc_id, text, fingerprint (binary) and keys (of the bands; null for texts without a word)."""
    empty = fingerprints([""], k)

    def run(batches):
        for batch in batches:
            prints = fingerprints(batch["text"].tolist(), k)
            keys = np.empty((len(prints), BANDS), _U)
            for b in range(BANDS):
                key = np.full(len(prints), b + 1, _U)
                for place in prints[:, b * ROWS : (b + 1) * ROWS].T.astype(_U):
                    key = mix64(key * _U(0xD6E8FEB86659FD93) + place)
                keys[:, b] = key
            some = (prints != empty).any(axis=1)
            yield batch.assign(fingerprint=_packed(prints), keys=[key if s else None for key, s in zip(keys.view(np.int64), some, strict=True)])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(named, run, "doc_id long, text string, fingerprint binary, keys array<long>")


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a < b: links between documents whose sets of shingles have at least that Jaccard similarity.

    Documents of equal texts are linked to the least of them; of different texts with an equal
    band each is linked to the band's least, if that holds under verification.  Every document
    that has a near copy with whose leader it is near has a link; the classes of
    ``dart_minhash.near_duplicates`` also join those that are only near to other members.
    """
    rows = docs.where(F.col("doc_id").isNotNull())
    sketch = stash(fingerprinted(rows).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).drop("text"), "fingerprints")
    reps = stash(sketch.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "representatives")
    copies = sketch.join(reps.select("digest", "rep").hint("merge"), "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    buckets = reps.where(F.col("keys").isNotNull()).select(F.explode("keys").alias("key"), "rep")
    leaders = stash(buckets.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("_z")).where("a <> _z").select("key", "a"), "leaders")
    met = stash(buckets.join(leaders.hint("merge"), "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    asked = met.select(F.col("a").alias("doc_id")).unionByName(met.select(F.col("b").alias("doc_id"))).distinct()
    texts = stash(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    return copies.unionByName(verify_pairs(met, texts, threshold, "set")).distinct()


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points is replaced by as many (or all) of the next text's first."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_WAITING = "place int, first boolean, last boolean, text string"


def _compared(ids, texts: list[str], prints: np.ndarray, following: list[str], next_prints: np.ndarray) -> pd.DataFrame:
    edited = [edited_text(t, f) for t, f in zip(texts, following, strict=True)]
    changed = fingerprints(edited)
    return pd.DataFrame({
        "doc_id": pd.array(ids, dtype="Int64"),
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": _packed(prints),
        "edited_fingerprint": _packed(changed),
        "near_edited": likeness(prints, changed),
        "near_next": likeness(prints, next_prints),
    })


def with_next(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and the next document: the columns of the contract, fingerprints as binary."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("_tie")]
    # The tie only spreads rows that are equal; which of them comes first changes nothing.
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        place, held, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            ids, texts = batch["doc_id"].astype("Int64").tolist(), batch["text"].tolist()
            if not texts:
                continue
            prints = fingerprints(texts)
            if first:
                yield pd.DataFrame({"doc_id": pd.array(ids[:1], dtype="Int64"), "place": [place], "first": [True], "last": [False], "text": texts[:1]})
                first = False
            if held is not None:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], prints])
            if len(texts) > 1:
                yield _compared(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
            held = ids[-1], texts[-1], prints[-1:]
        if held is not None:
            yield pd.DataFrame({"doc_id": pd.array([held[0]], dtype="Int64"), "place": [place], "first": [False], "last": [True], "text": [held[1]]})

    columns = [c.split()[0] for c in f"{_RESULT}, {_WAITING}".split(", ")]

    def whole(batches):
        for frame in run(batches):
            # Plain objects: strings of pandas may be stored in several chunks, which Spark doesn't take.
            yield frame.reindex(columns=columns).astype({"edited_sha256": object, "text": object})

    found = stash(map_batches(dealt, whole, f"{_RESULT}, {_WAITING}"), "neighbours")
    # Two rows for each partition: its last row meets the first of the next one that has rows.
    ends, starts = found.where("last"), found.where("first").select(F.col("place").alias("_at"), F.col("text").alias("_following"))
    places = ends.select("place")
    ahead = Window.orderBy("place")  # one short row for each partition
    following = places.select("place", F.coalesce(F.lead("place").over(ahead), F.first("place").over(ahead)).alias("_at"))
    meet = ends.select("doc_id", "text", "place").join(following, "place").join(starts, "_at").select("doc_id", "text", "_following")

    def close(batches):
        for batch in batches:
            texts, following = batch["text"].tolist(), batch["_following"].tolist()
            yield _compared(batch["doc_id"].astype("Int64").tolist(), texts, fingerprints(texts), following, fingerprints(following))

    done = found.where("place IS NULL").select(*[c.split()[0] for c in _RESULT.split(", ")])
    return done.unionByName(map_batches(meet, close, _RESULT))


def op11_fingerprints(spark, sf_dir):
    """The registered query: fingerprints of all ``documents`` and of their edited texts."""
    text = lambda c: F.lower(F.hex(c)).alias(c)
    found = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")

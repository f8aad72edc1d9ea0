"""Near-duplicate classes: DartMinHash signatures, banded candidates, exact verification.

*Signatures.*  A document is a weighted set of five-word shingles.  Every shingle
owns a random pattern of darts over (weight, rank) cells of area one; a dart carries
a coordinate.  A document keeps the darts under its weights, up to a rank at which
about ``k ln k + 2 k`` are expected, and per coordinate the one of least rank.  Work
is O(shingles + k log k) instead of O(shingles * k), and two documents agree on a
coordinate with a probability equal to their weighted Jaccard similarity.  Rare
documents with a coordinate left empty go on to higher ranks until none is.

*Whole and without quadratic work.*  Byte-equal texts are collapsed first.  Documents
with an equal band form a bucket.  Each document is verified against the least member
of its buckets; verified links give components.  Then only buckets that still hold
several components are looked at again, and only across components: first against a
leader drawn from each bucket's largest component, then by an exact join of rare prefix
shingles, in which a document that shares too few shingles with any other drops out,
and members outside a group's largest component meet the others that the size of both
and the place of the shared shingle leave possible.  Copies in one
component are thus never paired with each other, and no partner or candidate is
capped; many different texts around one shared passage don't meet, as their rare
shingles differ.  Verification compares the weighted sets of shingles of both texts: as
weights are counts, they are plain sets of numbered occurrences.

All groups are spread: a leader's group is salted by its size, hot keys only meet in
plain sort-merge joins (which adaptive execution splits) or in aggregates with
map-side combining.  Lineage is cut by tables in the shared folder.

Defined results for odd input: null texts are classes of their own; texts without
a word are only equal to byte-equal ones; texts of one to four words have one shingle
of all their words; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, map_batches, stash

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: ``count``: a shingle weighs as often as it occurs; ``set``: every different one weighs 1.
WEIGHTS = "count"
#: Bands and rows: a pair at similarity 0.8 is missed with a probability of 3e-5.
BANDS, ROWS = 34, 6
#: Texts are taken in blocks of about so many bytes: this bounds memory.
BLOCK_BYTES = 400_000
#: So many links are joined by one task.
FEW_LINKS = 16_384
#: Members of one leader compared in one task's group.
GROUP = 128
#: A pair at the threshold passes the comparison of signature bits within so many standard deviations (missed: 3e-6).
DEVIATIONS = 4.5

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[_U(1), np.full(n - 1, _BASE, dtype=_U)])
        down = np.cumprod(np.r_[_U(1), np.full(n - 1, pow(_BASE, -1, 1 << 64), dtype=_U)])
    return up, down


#: Bytes are hashed in pieces of this size, elements in pieces of so many cells: memory doesn't follow the longest text.
PIECE, CELLS = 1 << 17, 1 << 18
_UP, _DOWN = _power_tables(PIECE)
_LETTER = mix64(np.arange(1, 257, dtype=_U) * _U(_BASE))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[ord(c) for c in WS_CHARS]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of all texts, in order.

    A word's letters are added up as a polynomial; a word that a piece's end cuts gets
    its terms from both pieces.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"".join(e + b"\n" for e in encoded), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    edges = []
    before = True
    for s in range(0, len(raw), PIECE):
        space = _SPACE[raw[s : s + PIECE]]
        edges.append(np.flatnonzero(np.diff(np.r_[before, space].astype(np.int8))) + s)
        before = bool(space[-1])
    # Every text ends in a space, so starts and ends of words take turns.
    edge = np.concatenate(edges)
    starts, ends = edge[0::2], edge[1::2]
    own = np.zeros(len(starts), _U)
    for s in range(0, len(raw), PIECE):
        piece = raw[s : s + PIECE]
        total = np.r_[_U(0), np.cumsum(_LETTER[piece] * _UP[: len(piece)])]
        i, j = np.searchsorted(ends, s, side="right"), np.searchsorted(starts, s + len(piece), side="left")
        if i == j:
            continue
        at, to = starts[i:j] - s, np.minimum(ends[i:j] - s, len(piece))
        # Powers count from the word's start: down from a start in this piece, up from one in an earlier piece.
        factor = _DOWN[np.maximum(at, 0)]
        if at[0] < 0:
            factor[0] = pow(_BASE, -int(at[0]), 1 << 64)
        own[i:j] += (total[to] - total[np.maximum(at, 0)]) * factor
    bounds = np.cumsum([len(e) + 1 for e in encoded])
    return mix64(own + (ends - starts).astype(_U)), np.searchsorted(bounds, starts, side="right")


def shingle_sets(texts: list[str], k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their multiplicities and the number of the text, sorted by text and hash."""
    word, doc = word_hashes(texts)
    n = len(word)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    long_word = np.r_[word, np.zeros(k, _U)]
    long_doc = np.r_[doc, np.full(k, -1)]
    value = np.zeros(n, _U)
    for j in range(k):
        inside = long_doc[j : j + n] == doc
        value = mix64(value * _U(0xD6E8FEB86659FD93) + np.where(inside, long_word[j : j + n], _U(j + 1)))
    full = long_doc[k - 1 : k - 1 + n] == doc
    first = np.r_[True, doc[1:] != doc[:-1]]
    keep = full | (first & ~full)
    value, doc = value[keep], doc[keep]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(new)
    return value[at], np.diff(np.r_[at, len(value)]), doc[at]


def element_sets(texts: list[str], weights: str) -> tuple[np.ndarray, np.ndarray]:
    """Elements and text numbers of plain sets whose Jaccard similarity is that of the weighted ones, sorted by text and element.

    With ``count`` a shingle is there once for each of its occurrences, numbered.
    """
    element, count, doc = shingle_sets(texts)
    if weights == "set" or not len(element) or count.max() == 1:
        return element, doc
    row = np.repeat(np.arange(len(element)), count)
    nth = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)).astype(_U)
    value = np.where(nth == 0, element[row], mix64(element[row] + nth * _U(_BASE)))
    order = np.lexsort((value, doc[row]))
    return value[order], doc[row][order]


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 20.0)]))


def dart_minhash(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures (n_docs, k) of weighted sets.

    ``element`` are 64-bit hashes, ``weight`` positive numbers, ``doc`` the set each
    belongs to, in rising order.  Sets without elements keep a signature of zeros.
    """
    signature = np.zeros((n_docs, k), dtype=_U)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    darts = k * np.log(k) + 2 * k
    todo = np.flatnonzero(total > 0)
    factor = 1.0
    while len(todo):
        chosen = np.zeros(n_docs, dtype=bool)
        chosen[todo] = True
        mine = chosen[doc]
        e, w, d = element[mine], weight[mine].astype(float), doc[mine]
        highest = np.zeros(n_docs)
        highest[todo] = darts * factor / total[todo]
        # One cell for each unit of weight and of rank; the last unit of weight may be a part.
        units = np.ceil(w).astype(np.int64)
        ranks = np.ceil(highest[d]).astype(np.int64)
        cells = units * ranks
        upto = np.cumsum(cells)
        hits = []
        for cell in range(0, int(upto[-1]), CELLS):
            number = np.arange(cell, min(cell + CELLS, int(upto[-1])))
            row = np.searchsorted(upto, number, side="right")
            nth = number - (upto[row] - cells[row])
            unit, rank = nth // ranks[row], nth % ranks[row]
            seed = mix64(e[row] + mix64((unit.astype(_U) << _U(32)) + rank.astype(_U) + _U(1)))
            count = np.searchsorted(_POISSON, (seed >> _U(11)).astype(float) * 2.0**-53, side="right")
            thrown = np.repeat(np.arange(len(row)), count)
            order = np.arange(len(thrown)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix64(seed[thrown] + _U(_BASE) * (order.astype(_U) + _U(1)))
            of = row[thrown]
            height = rank[thrown] + (dart >> _U(32)).astype(float) * 2.0**-32
            hit = height < highest[d[of]]
            part = w[of] - unit[thrown] < 1
            if part.any():
                beside = (mix64(dart + _U(1)) >> _U(11)).astype(float) * 2.0**-53
                hit &= ~part | (beside < w[of] - unit[thrown])
            hits.append((dart[hit], height[hit], d[of[hit]] * k))
        dart, height, slot = (np.concatenate(x) for x in zip(*hits, strict=True))
        slot = slot + (((dart & _U(0xFFFFFFFF)) * _U(k)) >> _U(32)).astype(np.int64)
        best = np.lexsort((height, slot))
        slot = slot[best]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
        signature.reshape(-1)[slot[first]] = dart[best[first]]
        todo = todo[np.bincount(slot[first] // k, minlength=n_docs)[todo] < k]
        factor *= 2
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per document and band."""
    keys = np.empty((len(signature), bands), dtype=_U)
    for b in range(bands):
        key = np.full(len(signature), b + 1, dtype=_U)
        for r in range(rows):
            key = mix64(key * _U(0xD6E8FEB86659FD93) + signature[:, b * rows + r])
        keys[:, b] = key
    return keys


def _blocks(texts):
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= BLOCK_BYTES:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def signature_bits(signature: np.ndarray) -> np.ndarray:
    """Two bits of every coordinate, packed as two planes of 64-bit integers: (n_docs, 2 * words)."""
    n, k = signature.shape
    bits = np.zeros((n, 2, -(-k // 64) * 64), dtype=np.uint8)
    for plane in range(2):
        bits[:, plane, :k] = (signature >> _U(13 + plane)) & _U(1)
    return np.packbits(bits.reshape(n, -1), axis=1).view(_U)


def most_apart(k: int, threshold: float) -> float:
    """The number of coordinates whose two bits may differ if the similarity is at the threshold."""
    p = (1 - threshold) * 0.75
    return k * p + DEVIATIONS * (k * p * (1 - p)) ** 0.5


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weights: str = WEIGHTS) -> DataFrame:
    """doc_id, hash (SHA-256 of the text), n (their weight), keys (band keys; null without shingles), bits (of the signature); null texts are left out.

    ``weights``: ``set`` gives every distinct shingle weight 1 (Jaccard similarity),
    ``count`` its number of occurrences (weighted Jaccard similarity).
    """

    def run(batches):
        for batch in batches:
            sizes, keys, bits = [], [], []
            for block in _blocks(batch["text"].tolist()):
                element, count, doc = shingle_sets(block)
                weight = np.ones(len(element)) if weights == "set" else count.astype(float)
                own = np.bincount(doc, weights=weight, minlength=len(block)).astype(np.int64)
                signature = dart_minhash(element, weight, doc, len(block), bands * rows)
                found = band_keys(signature, bands, rows).view(np.int64)
                sizes += own.tolist()
                bits += list(signature_bits(signature).view(np.int64))
                keys += [k if n else None for k, n in zip(found, own, strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "hash": batch["hash"], "n": sizes, "keys": keys, "bits": bits})

    named = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"), "text"
    )
    return map_batches(named, run, "doc_id long, hash binary, n long, keys array<long>, bits array<long>")


def verify_pairs(pairs: DataFrame, texts: DataFrame, threshold: float, weights: str = WEIGHTS) -> DataFrame:
    """The pairs (a, b) whose sets of shingles, weighted alike, have at least that Jaccard similarity.

    ``texts``: doc_id, text.  All ``b`` of one ``a`` are streamed past its set; an
    ``a`` with many is dealt out to groups of about ``GROUP``.
    """
    salted = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("_c")), "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("_c") / GROUP).cast("long")).alias("salt")
    )
    others = salted.join(texts, F.col("b") == F.col("doc_id")).select("a", "salt", F.lit(1).alias("role"), "b", "text")
    leaders = (
        salted.select("a", "salt")
        .distinct()
        .join(texts, F.col("a") == F.col("doc_id"))
        .select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    )

    def run(batches):
        own = np.zeros(0, _U)
        for batch in batches:
            out = []
            done = 0
            for block in _blocks(batch["text"].tolist()):
                element, doc = element_sets(block, weights)
                at = np.searchsorted(doc, np.arange(len(block) + 1))
                rows = batch.iloc[done : done + len(block)]
                for i, (a, role, b) in enumerate(zip(rows["a"], rows["role"], rows["b"], strict=True)):
                    mine = element[at[i] : at[i + 1]]
                    if role == 0:
                        own = mine.copy()
                        continue
                    if not len(own) or not len(mine):
                        continue
                    where = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                    common = int((own[where] == mine).sum())
                    if common >= threshold * (len(own) + len(mine) - common) - 1e-9:
                        out.append((a, b))
                done += len(block)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    dealt = others.unionByName(leaders).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return map_batches(dealt, run, "a long, b long")


def _roots(parent: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, root) in which every parent is less than its child: pointer jumping."""
    current = stash(parent, "forest")
    while True:
        up = current.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        following = stash(
            current.join(up, F.col("root") == F.col("_n"), "left").select(
                "node", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")
            ),
            "forest",
        )
        if following.where("moved").isEmpty():
            return following.select("node", "root")
        current = following.select("node", "root")


def _moved(found: DataFrame, roots: DataFrame) -> DataFrame:
    """``found`` with its roots moved to their own roots, and the nodes that are new in ``roots``."""
    new = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return stash(
        found.join(new, F.col("root") == F.col("_n"), "left")
        .select("node", F.coalesce("_r", "root").alias("root"))
        .unionByName(roots.join(found.select("node"), "node", "left_anti")),
        "components",
    )


def _joined(batch: pd.DataFrame) -> pd.DataFrame:
    """(node, root) of a few links, by union and find."""
    up: dict[int, int] = {}

    def root(x):
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    return pd.DataFrame({"node": nodes, "root": [root(n) for n in nodes]}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a < b) that isn't the least of its component.

    Every node hooks on its least smaller neighbour, trees are flattened, links are
    rewritten to roots, and the rest goes round again until at most ``FEW_LINKS`` are left,
    which one task joins: that saves rounds of jobs that have next to nothing to do.
    """
    found = None
    while True:
        if edges.count() <= FEW_LINKS:
            rest = stash(edges.select("a", "b").groupBy().applyInPandas(_joined, "node long, root long"), "components")
            return rest if found is None else _moved(found, rest)
        roots = _roots(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        if found is None:
            found = roots
        else:
            found = _moved(found, roots)
        left = roots.select(F.col("node").alias("_na"), F.col("root").alias("_ra"))
        right = roots.select(F.col("node").alias("_nb"), F.col("root").alias("_rb"))
        moved = (
            edges.join(left, F.col("a") == F.col("_na"), "left")
            .join(right, F.col("b") == F.col("_nb"), "left")
            .select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b"))
            .where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        edges = stash(moved, "edges")


def _prefix_pairs(members: DataFrame, texts: DataFrame, threshold: float, weights: str) -> DataFrame:
    """Pairs (a < b) across components that share a rare prefix shingle.

    Two sets of similarity t or more share one of the first ``n - ceil(t n) + 1``
    elements in any common order; the order is by frequency among the members.
    ``members``: rep, n, comp.
    """

    def run(batches):
        for batch in batches:
            ids, shingles = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            done = 0
            for block in _blocks(batch["text"].tolist()):
                element, doc = element_sets(block, weights)
                ids.append(batch["doc_id"].to_numpy()[done : done + len(block)][doc])
                shingles.append(element.view(np.int64))
                done += len(block)
            yield pd.DataFrame({"rep": np.concatenate(ids), "shingle": np.concatenate(shingles)})

    def of(ids: DataFrame) -> DataFrame:
        return texts.join(ids.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"])

    rows = stash(map_batches(of(members), run, "rep long, shingle long"), "shingles")
    often = stash(rows.groupBy("shingle").agg(F.count("*").alias("_f")).where("_f > 1"), "frequencies")
    # A shingle of one document makes no pair but has its place in the prefix.
    ranked = (
        rows.join(often.hint("merge"), "shingle", "left")
        .select("rep", "shingle", F.coalesce("_f", F.lit(1)).alias("_f"))
        .select("*", F.row_number().over(Window.partitionBy("rep").orderBy("_f", "shingle")).alias("_k"))
        .where("_f > 1")
    )
    prefixes = stash(
        ranked.join(members.hint("merge"), "rep")
        .where(F.col("_k") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
        .select("shingle", "rep", "n", "comp", "_k", "_f"),
        "prefixes",
    )
    # Shingles with the same documents (one change makes several) make the same pairs: the first in the common order will do.
    same = [F.count("*").alias("_n"), F.bit_xor(F.xxhash64("rep")).alias("_x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("_y")]
    shapes = prefixes.groupBy("_f", "shingle").agg(*same, F.min("comp").alias("_a"), F.max("comp").alias("_z")).where("_a <> _z")
    chosen = stash(shapes.groupBy("_n", "_x", "_y").agg(F.min(F.struct("_f", "shingle")).alias("_c")).select("_c.shingle"), "chosen")
    return _cross(stash(prefixes.join(chosen.hint("merge"), "shingle", "left_semi"), "kept"), ["shingle"], threshold)


def _possible(n, m, bits, other, threshold: float, far: float):
    """Whether sizes and signature bits leave the threshold possible."""
    differ = lambda i: F.get(bits, i).bitwiseXOR(F.get(other, i))
    half = (F.size(bits) / 2).cast("int")
    apart = F.aggregate(
        F.sequence(F.lit(0), half - 1), F.lit(0), lambda a, i: a + F.bit_count(differ(i).bitwiseOR(differ(i + half)))
    )
    return (F.least(n, m) >= threshold * F.greatest(n, m)) & (apart <= far)


def _largest(members: DataFrame, by: list[str]) -> DataFrame:
    """The largest component of every group that holds several."""
    per = members.groupBy(*by, "comp").agg(F.count("*").alias("_c"))
    return (
        per.groupBy(*by)
        .agg(F.max(F.struct("_c", "comp")).alias("_m"), F.count("*").alias("_comps"))
        .where("_comps > 1")
        .select(*by, F.col("_m.comp").alias("_largest"))
    )


def _cross(members: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Pairs (a < b) of one prefix shingle, of different components; the largest component isn't paired with itself.

    ``_k`` is the shingle's place in the document's order.
    """
    mixed = members.join(stash(_largest(members, by), "largest"), by)
    few = mixed.where("comp <> _largest").select(
        *by, F.col("rep").alias("_x"), F.col("n").alias("_nx"), F.col("comp").alias("_cx"), F.col("_k").alias("_kx")
    )
    # So many shingles must be common; the first common one stands no later than this in either document.
    least = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("_nx")) - 1e-9)
    early = (F.col("_k") <= F.col("n") - least + 1) & (F.col("_kx") <= F.col("_nx") - least + 1)
    return (
        few.join(mixed, by)
        .where((F.col("comp") != F.col("_cx")) & early & (F.least("n", "_nx") >= threshold * F.greatest("n", "_nx")))
        .select(F.least("rep", "_x").alias("a"), F.greatest("rep", "_x").alias("b"))
        .distinct()
    )


def _drawn(members: DataFrame, largest: DataFrame, threshold: float, far: float) -> DataFrame:
    """Pairs (a < b): members outside the largest component of a bucket against one member drawn from it."""
    mixed = members.join(largest, "key")
    chosen = (
        mixed.where("comp = _largest")
        .groupBy("key")
        .agg(F.min(F.struct(F.xxhash64("rep").alias("_o"), "rep", "n", "bits")).alias("_l"))
        .select("key", F.col("_l.rep").alias("_x"), F.col("_l.n").alias("_nx"), F.col("_l.bits").alias("_bx"))
    )
    return (
        mixed.where("comp <> _largest")
        .join(stash(chosen, "drawn"), "key")
        .where(_possible(F.col("n"), F.col("_nx"), F.col("bits"), F.col("_bx"), threshold, far))
        .select(F.least("rep", "_x").alias("a"), F.greatest("rep", "_x").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    weights: str = WEIGHTS,
) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), copies (byte-equal texts), one row per document."""
    sketch = stash(sketches(docs, bands, rows, weights), "sketches")
    reps = stash(
        sketch.groupBy("hash").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")
        ),
        "representatives",
    )
    buckets = reps.where(F.col("keys").isNotNull() & F.col("rep").isNotNull()).select(F.explode("keys").alias("key"), "rep", "n")
    leaders = stash(
        buckets.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("_last")).where("leader <> _last").drop("_last"), "leaders"
    )
    members = stash(buckets.join(leaders, "key"), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = stash(
        docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id", "left_semi"), "texts"
    )
    starred = members.where("rep <> leader").groupBy(F.col("rep").alias("b")).agg(F.min("leader").alias("a"))
    links = stash(verify_pairs(stash(starred.select("a", "b"), "pairs"), texts, threshold, weights).distinct(), "links")
    found = components(links)
    far = most_apart(bands * rows, threshold)
    bits = reps.select(F.col("rep").alias("_rep"), "bits")

    def labelled(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of the buckets that hold several components, with their components; those buckets."""
        of = members.join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("comp"))
        largest = stash(_largest(of, ["key"]), "largest")
        inside = of.join(largest.select("key"), "key", "left_semi")
        return stash(inside.join(bits, F.col("rep") == F.col("_rep")).drop("_rep"), "labelled"), largest

    def extend(pairs: DataFrame) -> bool:
        """Verify more pairs; whether components have changed."""
        nonlocal links, found
        pairs = stash(pairs, "pairs")
        if pairs.isEmpty():
            return False
        more = stash(verify_pairs(pairs, texts, threshold, weights), "links")
        if more.isEmpty():
            return False
        links = stash(links.unionByName(more).distinct(), "links")
        found = components(links)
        return True

    inside, largest = labelled(found)
    if extend(_drawn(inside, largest, threshold, far)):
        inside, largest = labelled(found)
    alone = stash(inside.groupBy("rep").agg(F.first("n").alias("n"), F.first("comp").alias("comp")), "open")
    extend(_prefix_pairs(alone, texts, threshold, weights))
    classes = stash(
        reps.join(found, F.col("rep") == F.col("node"), "left").select(
            F.col("hash").alias("_h"), F.coalesce("root", "rep").alias("class_id"), "copies"
        ),
        "classes",
    )
    known = sketch.select("doc_id", "hash").join(classes.hint("merge"), F.col("hash") == F.col("_h")).select("doc_id", "class_id", "copies")
    without = docs.where(F.col("text").isNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("class_id"), F.lit(1).cast("long").alias("copies")
    )
    return known.unionByName(without)


def _row_keys(docs: DataFrame) -> DataFrame:
    """``_row`` (all columns of ``docs``), doc_id, text and ``_key``: the doc_id, but a key of its own for each text whose id is missing or held by another text.

    Of several texts with one doc_id the least keeps the id.  Own keys follow all ids,
    in the order of doc_id and text; equal rows share a key.
    """
    doc_id, digest = F.col("doc_id").cast("long"), F.xxhash64("text")
    docs = docs.select(F.struct(*docs.columns).alias("_row"), doc_id.alias("doc_id"), "text")
    shared = stash(
        docs.where(F.col("doc_id").isNotNull()).groupBy(doc_id.alias("_d")).agg(F.min(digest).alias("_a"), F.max(digest).alias("_z")).where("_a <> _z").select("_d"), "shared-ids"
    )
    keyed = docs.withColumn("_key", doc_id)
    missing = docs.where(F.col("doc_id").isNull()).select(doc_id.alias("_o"), F.col("text").alias("_t"))
    if shared.isEmpty() and missing.isEmpty():
        return keyed
    several = docs.join(shared.hint("merge"), doc_id == F.col("_d"), "left_semi").select(doc_id.alias("_o"), F.col("text").alias("_t"))
    # A text that is null sorts last: it keeps the id only if there is no other.
    least = several.groupBy("_o").agg(F.min("_t").alias("_least"))
    others = several.distinct().join(least.withColumnRenamed("_o", "_p").hint("merge"), F.col("_o") == F.col("_p")).where(~F.col("_t").eqNullSafe(F.col("_least"))).select("_o", "_t")
    top = docs.agg(F.coalesce(F.max(doc_id), F.lit(0)).alias("_top"))
    own = others.unionByName(missing.distinct()).orderBy(F.col("_o").asc_nulls_last(), F.col("_t").asc_nulls_last()).withColumn("_n", F.monotonically_increasing_id())
    own = stash(own.crossJoin(F.broadcast(top)).select("_o", "_t", (F.col("_top") + 1 + F.col("_n")).alias("_own")), "own-keys")
    keyed = keyed.join(own.hint("merge"), F.col("_key").eqNullSafe(F.col("_o")) & F.col("text").eqNullSafe(F.col("_t")), "left")
    return stash(keyed.withColumn("_key", F.coalesce("_own", "_key")).drop("_o", "_t", "_own"), "keyed")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: of each class the one with the least doc_id, once; columns as in ``docs``.

    Rows without a doc_id, and different texts with one doc_id, are classed by their
    text: they stay unless they repeat another row, and give way to rows with an id.
    """
    keyed = _row_keys(docs)
    classes = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), **options)
    kept = classes.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("_kept")).distinct()
    # All rows of a key are equal in their text.
    once = Window.partitionBy("_key").orderBy(F.col("text").asc_nulls_last())
    return (
        keyed.join(kept.hint("merge"), F.col("_key") == F.col("_kept"), "left_semi")
        .select("_row", F.row_number().over(once).alias("_copy"))
        .where("_copy = 1")
        .select("_row.*")
    )


def op9_dart_minhash(spark, sf_dir):
    """The registered query: near-duplicate classes of all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

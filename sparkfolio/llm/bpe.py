"""BPE encoding and decoding with batched numpy merge rounds.

A vocabulary file (its path is a parameter) is parsed once on the driver into a few
flat arrays and broadcast; its size is that of the vocabulary, not of the data.
On the executors the symbols of all distinct words of a block of texts lie in one
flat array.  Each round looks up every adjacent pair by binary search over the
sorted pair keys, finds the lowest rank of each word, merges all its occurrences
from the left, and drops finished words, so a round costs one pass over what is
still open however many words there are.

Text is cut at white space first.  No pattern of this vocabulary crosses white
space, and neither composition nor lower-casing does, so the pieces are encoded
independently and kept in a bounded cache.

Defined results for odd input: a null text counts as an empty one (no ids); texts
are processed whole, also if they are one endless word; the strings of special
tokens in a text get their ids, as in the library; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from .common import map_batches

#: Texts are encoded in blocks of about so many characters: this bounds memory.
BLOCK_CHARS = 1_000_000
#: The cache of encoded pieces is emptied beyond this number.
CACHE_PIECES = 300_000
#: Code points that Python's ``str.split`` takes for white space and the patterns do not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"

#: Ranges of letters and digits that are newer than the Unicode version by which the
#: vocabulary's patterns were defined (they count as symbols there).
NEWER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Lower-case forms that this Python's tables lack; and sigma, which has one form whatever follows.
LOWER = {
    0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5,
    0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}

_FREE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Vocabulary:
    """Flat arrays of a word-end BPE vocabulary."""

    tokens: tuple[str, ...]
    inner: np.ndarray  # byte -> id inside a word
    final: np.ndarray  # byte -> id at a word's end
    keys: np.ndarray  # sorted pair keys
    ranks: np.ndarray
    merged: np.ndarray
    pattern: str
    special: dict[str, int]


def _byte_letters() -> list[str]:
    """The printable stand-ins for the 256 bytes: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    own = set(plain)
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def load_vocabulary(path: str) -> Vocabulary:
    """Parse a ``tokenizers`` file of a lower-casing, byte-level BPE with word ends."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    ids: dict[str, int] = dict(model["vocab"])
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in [*ids.items(), *special.items()]:
        tokens[i] = token
    end = model["end_of_word_suffix"]
    letters = _byte_letters()
    size = len(tokens)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    key = np.array([ids[a] * size + ids[b] for a, b in pairs], dtype=np.int64)
    merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(key, kind="stable")
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return Vocabulary(
        tokens=tuple(tokens),
        inner=np.array([ids[c] for c in letters], dtype=np.int64),
        final=np.array([ids[c + end] for c in letters], dtype=np.int64),
        keys=key[order],
        ranks=order.astype(np.int64),
        merged=merged[order],
        pattern=split["pattern"]["Regex"],
        special=special,
    )


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words: one flat array and the number of ids of each word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    symbols = v.inner[raw]
    ends = np.cumsum(sizes)
    symbols[ends - 1] = v.final[raw[ends - 1]]
    word = np.repeat(np.arange(len(words)), sizes)
    size = len(v.tokens)

    def look_up(key: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        found = (v.keys[at] == key) & inside
        return np.where(found, v.ranks[at], _FREE), v.merged[at]

    # rank and into describe the pair that begins at each symbol; the last symbol of a word begins none.
    rank, into = look_up(symbols * size + np.r_[symbols[1:], 0], np.r_[word[1:] == word[:-1], False])
    done_word, done_symbol = [], []
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbols)]))
        open_ = lowest != _FREE
        if not open_.all():
            done_word.append(word[~open_])
            done_symbol.append(symbols[~open_])
            rank, into, lowest, word, symbols = rank[open_], into[open_], lowest[open_], word[open_], symbols[open_]
            if not len(symbols):
                break
        # Neighbouring hits overlap (a a a): take every second one of a run, from its left.
        where = np.flatnonzero(rank == lowest)
        run = np.r_[True, np.diff(where) != 1]
        first = where[run]
        where = where[(where - first[np.cumsum(run) - 1]) % 2 == 0]
        symbols[where] = into[where]
        left = np.ones(len(symbols), dtype=bool)
        left[where + 1] = False
        place = where - np.arange(len(where))  # where the merged symbols are once the others have gone
        symbols, word, rank, into = symbols[left], word[left], rank[left], into[left]
        # Only pairs that a merge touched have changed.
        touched = np.concatenate([place, place[place > 0] - 1])
        after = np.minimum(touched + 1, len(symbols) - 1)
        rank[touched], into[touched] = look_up(
            symbols[touched] * size + symbols[after], (word[touched] == word[after]) & (after > touched)
        )
    word, symbols = np.concatenate(done_word), np.concatenate(done_symbol)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.bincount(word, minlength=len(words))


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded cache of encoded pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        newer = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in NEWER_LETTERS)
        pattern = vocabulary.pattern
        for plain, exact in (
            (r"[\p{L}]", rf"[\p{{L}}--[{newer}]]"),
            (r"[\p{N}]", rf"[\p{{N}}--[{newer}]]"),
            (r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]"),
        ):
            pattern = pattern.replace(plain, exact)
        self.find = regex.compile(pattern + r"|\n", regex.V1).findall
        self.space = regex.compile(r"\s+")
        self.cased = re.compile("[" + "".join(map(chr, LOWER)) + "]")
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in vocabulary.special) + ")") if vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def _plain(self, segment: str) -> list[str]:
        if not segment.isascii():
            segment = unicodedata.normalize("NFC", segment)
            if self.cased.search(segment):
                segment = segment.translate(LOWER)
        return self.find(segment.lower())

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces and append them to the cache.

        Ordinary pieces are matched in one go, joined by line breaks (which the
        pattern returns as marks); those with special tokens one by one, at the end.
        """
        odd = [p for p in pieces if "<|" in p] if self.cut is not None else []
        if odd:
            pieces = [p for p in pieces if "<|" not in p]
        found = self._plain("\n".join(pieces)) if pieces else []
        marks = np.flatnonzero(np.fromiter(map("\n".__eq__, found), dtype=bool, count=len(found)))
        count = np.diff(np.r_[-1, marks, len(found)]) - 1 if pieces else np.zeros(0, np.int64)
        words = [w.encode("utf-8", "surrogatepass") for w in found if w != "\n"]
        special_at: list[tuple[int, int]] = []
        for piece in odd:
            before = len(words)
            for part in self.cut.split(piece):
                if part in self.v.special:
                    special_at.append((len(words), self.v.special[part]))
                    words.append(b"?")
                elif part:
                    words += [w.encode("utf-8", "surrogatepass") for w in self._plain(part)]
            count = np.r_[count, len(words) - before]
        pieces = pieces + odd
        ids, sizes = merge_words(words, self.v)
        if special_at:
            first = np.cumsum(sizes) - sizes
            for at, token in special_at:
                ids[first[at]] = token
        bounds = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(count)]]
        base = len(self.sizes)
        self.place.update(zip(pieces, range(base, base + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, bounds[:-1] + len(self.ids)])
        self.sizes = np.concatenate([self.sizes, np.diff(bounds)])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [
            t.split() if t.isprintable() or not any(c in t for c in _NOT_SPACE) else [p for p in self.space.split(t) if p]
            for t in texts
        ]
        if len(self.place) > CACHE_PIECES:
            self.forget()
        new = {p for pieces in split for p in pieces} - self.place.keys()
        if new:
            self._learn(list(new))
        get = self.place.__getitem__
        out = []
        for pieces in split:
            at = np.fromiter(map(get, pieces), dtype=np.int64, count=len(pieces))
            size = self.sizes[at]
            total = int(size.sum())
            shift = np.repeat(self.starts[at] - (np.cumsum(size) - size), size)
            out.append(self.ids[shift + np.arange(total)])
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """This kind of file has no decoder: tokens, special ones too, are joined by spaces."""
        token = self.v.tokens.__getitem__
        return [" ".join(map(token, i.tolist())) for i in ids]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block, chars = [], 0
    for t in texts:
        block.append(t)
        chars += len(t)
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _texts(column: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds the ids of every text as ``array<int>``."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            ids = [i.astype(np.int32) for block in _blocks(_texts(batch[text_col])) for i in codec.encode(block)]
            yield batch.assign(**{ids_col: ids})

    from pyspark.sql import types as T

    kept = docs.drop(ids_col)
    return map_batches(kept, run, T.StructType([*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            ids = [np.asarray(i if i is not None else [], dtype=np.int64) for i in batch[ids_col]]
            yield batch.assign(**{text_col: codec.decode(ids)})

    from pyspark.sql import types as T

    kept = encoded.drop(text_col)
    return map_batches(kept, run, T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())]))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, in one pass (ids never leave the worker)."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        codec = Codec(shared.value)
        number = [str(i) for i in range(len(shared.value.tokens))].__getitem__
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            sizes, of_ids, of_text = [], [], []
            for block in _blocks(_texts(batch["text"])):
                for i in codec.encode(block):
                    sizes.append(len(i))
                    of_ids.append(sha(" ".join(map(number, i.tolist()))))
                    of_text.append(sha(codec.decode([i])[0]))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": sizes, "ids_sha256": of_ids, "decoded_sha256": of_text}
            )

    return map_batches(
        docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark, sf_dir):
    """The registered query: digests of every document's ids and decoded text."""
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())

"""Telephony audio: mu-law, A-law and IMA ADPCM, decoded to PCM and resampled.

Companded samples are expanded by 256-entry tables that are computed from the codecs'
formulas.  ADPCM is sequential inside a block and independent between blocks, so one
numpy step decodes the same nibble of *all* blocks of a batch.  Narrow-band PCM is
brought from 8 to 16 kHz by an integer half-band interpolator, so results are equal on
every machine.

The byte store: a payload is kept as 8-bit mu-law samples of a WAVE file (format 7,
8 kHz, mono); reading the file back gives the payload's bytes.

Storing and decoding are narrow maps: nothing is shuffled.  The registered query writes
the files to a table in the shared folder and reads them back.  Blocks of a batch are
bounded in bytes; a longer row is a block of its own.

Defined results for odd input: a null text counts as an empty one; its payload is one
unit of padding; long texts are stored whole; repeated rows give repeated rows; an empty
table gives an empty result; media that can't be parsed decode to null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import map_batches, stash

RATE, WIDE_RATE = 8000, 16000
UNIT, PAD = 192, b" "
MULAW, ALAW, ADPCM, PCM = 7, 6, 0x11, 1
#: Rows are decoded together up to about so many bytes: this bounds memory.
BATCH_BYTES = 500_000


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    value = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -value, value).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 0x0F
    value = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, value, -value).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()

#: The quantiser steps of IMA ADPCM.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
        1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
        8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
#: Half of the symmetric half-band filter for the samples in between, in 1/64: 2 * (38 - 8 + 3 - 1) = 64.
HALF_BAND = (38, -8, 3, -1)


def _difference_table() -> np.ndarray:
    """(step index, nibble) -> signed difference."""
    nibble = np.arange(16)
    step = STEPS[:, None]
    size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    return np.where(nibble & 8, -size, size).astype(np.int32)


_DIFFERENCE = _difference_table()
_NEXT = np.clip(np.arange(len(STEPS))[:, None] + INDEX_STEPS[None, :], 0, len(STEPS) - 1).astype(np.int32)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """(n, block bytes) mono IMA ADPCM blocks -> (n, 1 + 2 * (bytes - 4)) samples; a step index beyond the table is its last."""
    n, size = blocks.shape
    head = blocks[:, :2].astype(np.int32)
    value = head[:, 0] | (head[:, 1] << 8)
    value = np.where(value >= 32768, value - 65536, value).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (size - 4), n), dtype=np.int16)
    out[0] = value
    for i, byte in enumerate(codes):
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            value = np.clip(value + _DIFFERENCE[index, nibble], -32768, 32767)
            index = _NEXT[index, nibble]
            out[1 + 2 * i + half] = value
    return out.T


def adpcm_encode(samples: np.ndarray, size: int = 256) -> bytes:
    """PCM -> mono IMA ADPCM blocks of ``size`` bytes, the last one filled with its last sample."""
    per = 1 + 2 * (size - 4)
    n = max(1, -(-len(samples) // per))
    padded = np.full(n * per, samples[-1] if len(samples) else 0, dtype=np.int32)
    padded[: len(samples)] = samples
    rows = padded.reshape(n, per)
    value, index = rows[:, 0].copy(), np.zeros(n, np.int32)
    out = np.zeros((n, size), dtype=np.uint8)
    out[:, :2] = rows[:, 0].astype("<i2").view(np.uint8).reshape(n, 2)
    for k in range(1, per):
        difference = rows[:, k] - value
        step = STEPS[index]
        nibble = np.minimum(np.abs(difference) * 4 // step, 7) | np.where(difference < 0, 8, 0)
        value = np.clip(value + _DIFFERENCE[index, nibble], -32768, 32767)
        index = _NEXT[index, nibble]
        out[:, 4 + (k - 1) // 2] |= (nibble << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out.tobytes()


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, those in between come from the half-band filter; ends are repeated."""
    if not len(pcm):
        return np.zeros(0, np.int16)
    taps = len(HALF_BAND)
    padded = np.concatenate([np.full(taps - 1, pcm[0]), pcm, np.full(taps, pcm[-1])]).astype(np.int32)
    between = np.full(len(pcm), 32, dtype=np.int32)
    for k, weight in enumerate(HALF_BAND):
        left, right = taps - 1 - k, taps + k
        between += weight * (padded[left : left + len(pcm)] + padded[right : right + len(pcm)])
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip(between >> 6, -32768, 32767)
    return out


def wave_bytes(data: bytes, tag: int, bits: int, rate: int = RATE, block: int = 1, samples: int | None = None) -> bytes:
    """A RIFF WAVE file, mono."""
    extra = struct.pack("<H", 1 + 2 * (block - 4)) if tag == ADPCM else b""
    speed = rate * block // (1 + 2 * (block - 4)) if tag == ADPCM else rate * block
    form = struct.pack("<HHIIHH", tag, 1, rate, speed, block, bits)
    if tag != PCM:
        form += struct.pack("<H", len(extra)) + extra
    chunks = b"fmt " + struct.pack("<I", len(form)) + form
    if tag != PCM:
        chunks += b"fact" + struct.pack("<II", 4, len(data) if samples is None else samples)
    chunks += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def wave_parts(media: bytes | None) -> dict | None:
    """tag, channels, rate, block, bits, samples and data of a WAVE file; null if it isn't one."""
    if not media or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, found = 12, {}
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        body = media[at + 8 : at + 8 + size]
        if kind == b"fmt " and len(body) >= 16:
            found |= dict(zip(("tag", "channels", "rate", "speed", "block", "bits"), struct.unpack_from("<HHIIHH", body), strict=True))
        elif kind == b"fact" and len(body) >= 4:
            found["samples"] = struct.unpack_from("<I", body)[0]
        elif kind == b"data":
            found["data"] = body
        at += 8 + size + size % 2
    return found if "tag" in found and "data" in found else None


def decode_batch(media: list[bytes | None]) -> list[np.ndarray | None]:
    """PCM of many WAVE files; ADPCM blocks of equal size are decoded together."""
    parts = [wave_parts(m) for m in media]
    out: list[np.ndarray | None] = [None] * len(media)
    together: dict[int, list[int]] = {}
    for i, p in enumerate(parts):
        if p is None or p["channels"] != 1:
            continue
        if p["tag"] in (MULAW, ALAW):
            out[i] = (MULAW_TABLE if p["tag"] == MULAW else ALAW_TABLE)[np.frombuffer(p["data"], np.uint8)]
        elif p["tag"] == ADPCM and p["block"] > 4:
            together.setdefault(p["block"], []).append(i)
        elif p["tag"] == PCM and p["bits"] == 16:
            out[i] = np.frombuffer(p["data"][: len(p["data"]) // 2 * 2], "<i2")
    for block, rows in together.items():
        data = [parts[i]["data"][: len(parts[i]["data"]) // block * block] for i in rows]
        samples = adpcm_decode(np.frombuffer(b"".join(data), np.uint8).reshape(-1, block))
        start = 0
        for i, d in zip(rows, data, strict=True):
            n = len(d) // block
            own = samples[start : start + n].reshape(-1)
            out[i] = own[: parts[i].get("samples", len(own))]
            start += n
    return out


def decode_audio(media: DataFrame, media_col: str = "media", wide: bool = True) -> DataFrame:
    """Adds ``pcm``: a 16-bit PCM WAVE of every telephony file, resampled to 16 kHz if ``wide``; null if it can't be decoded."""
    from pyspark.sql import types as T

    kept = media.drop("pcm")

    def run(batches):
        for batch in batches:
            out = []
            for rows in _blocks([m if m is not None else b"" for m in batch[media_col]]):
                for pcm in decode_batch(rows):
                    if pcm is None:
                        out.append(None)
                    else:
                        pcm = resample_double(pcm) if wide else pcm
                        out.append(wave_bytes(pcm.astype("<i2").tobytes(), PCM, 16, WIDE_RATE if wide else RATE, 2))
            yield batch.assign(pcm=out)

    return map_batches(kept, run, T.StructType([*kept.schema.fields, T.StructField("pcm", T.BinaryType())]))


def _blocks(rows: list):
    block, size = [], 0
    for r in rows:
        block.append(r)
        size += len(r)
        if size >= BATCH_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload of a text and its unpadded size."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return raw + PAD * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (mu-law WAVE of the payload): the stored form."""

    def run(batches):
        for batch in batches:
            made = [payload_of(t) for t in batch["text"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), "n_bytes": [n for _, n in made], "media": [wave_bytes(p, MULAW, 8) for p, _ in made]}
            )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Digests and features of stored payloads, from the bytes read back.

    The feature string has the peak and mean magnitude and the zero crossings of the
    expanded mu-law, the same for A-law, a checksum of the PCM resampled to 16 kHz, and
    the mean magnitude and a checksum of the payload taken as ADPCM blocks.
    """

    def shape(pcm: np.ndarray) -> str:
        loud = np.abs(pcm.astype(np.int32))
        crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
        return f"{int(loud.max(initial=0))}/{int(loud.sum()) // max(1, len(pcm))}/{crossings}"

    def run(batches):
        for batch in batches:
            out = []
            rows = list(zip(batch["doc_id"], batch["n_bytes"], batch["media"], strict=True))
            start = 0
            for block in _blocks([m for _, _, m in rows]):
                data = [wave_parts(m)["data"] for m in block]
                narrow = decode_batch(block)
                units = np.frombuffer(b"".join(data), np.uint8).reshape(-1, UNIT)
                coded = adpcm_decode(units)
                at = 0
                for (doc_id, n, media), d, pcm in zip(rows[start : start + len(block)], data, narrow, strict=True):
                    own = coded[at : at + len(d) // UNIT]
                    at += len(d) // UNIT
                    wide = resample_double(pcm)
                    feature = (
                        f"mulaw={shape(pcm)};alaw={shape(ALAW_TABLE[np.frombuffer(d, np.uint8)])};wide={zlib.crc32(wide.tobytes()):08x};"
                        f"adpcm={int(np.abs(own.astype(np.int32)).sum()) // own.size}/{zlib.crc32(own.tobytes()):08x}"
                    )
                    out.append(
                        (doc_id, n, len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                    )
                start += len(block)
            frame = pd.DataFrame(
                out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            )
            yield frame.astype({"doc_id": "Int64"})

    return map_batches(
        stored,
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op5_telephony(spark, sf_dir):
    """The registered query: every text of ``documents`` stored as telephony audio, and features of the files read back."""
    media = stash(store_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return media_features(media)

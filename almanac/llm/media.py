"""Media columns: whole texts stored as lossless WebP images, read back, and described.

A text's UTF-8 bytes, padded with 255 to a positive multiple of 576, become rows of 576 grey pixels or, where their
triples repeat much, of 192 RGB pixels, whose colour cache then does the work. A payload of more than 16,384 rows (the
format's limit) becomes several images one after the other, so no text is cut. All columns are computed from the
stored bytes as decoded; an image's width tells which of the two it is.

Defined cases: null text counts as empty (one row of 255s); an empty table gives no rows; equal
texts get equal values; a null id stays null; other columns are not read."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from . import webp
from .common import per_text

UNIT, WIDTH, FILL = 576, 192, 255
SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def repeats(samples: np.ndarray) -> bool:
    """Whether under a fifth of the triples are distinct, and a palette of single samples would not do."""
    triples = samples.reshape(-1, 3)
    codes = triples[:, 0].astype(np.uint32) << 16 | triples[:, 1].astype(np.uint32) << 8 | triples[:, 2]
    return 5 * len(np.unique(codes)) < len(codes) and len(np.flatnonzero(np.bincount(samples))) > 16


def store(text: str | None) -> bytes:
    """The stored form of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    raw += bytes([FILL]) * (-len(raw) % UNIT if raw else UNIT)
    step, out = webp.SIDE * UNIT, []
    for i in range(0, len(raw), step):
        samples = np.frombuffer(raw[i : i + step], np.uint8)
        out.append(webp.encode(samples, WIDTH) if repeats(samples) else webp.encode_grey(samples, UNIT))
    return b"".join(out)


def load(media: bytes) -> bytes:
    """The payload of a stored form."""
    out = []
    while media:
        image, size = webp.decode(media)
        bgra = image.reshape(-1).view(np.uint8).reshape(-1, 4)
        out.append(bgra[:, 1].tobytes() if image.shape[1] == UNIT else bgra[:, 2::-1].tobytes())
        media = media[size:]
    return b"".join(out)


def feature(payload: bytes) -> str:
    """rows, columns, mean of each channel, and a histogram of the samples' upper three bits."""
    rgb = np.frombuffer(payload, np.uint8).reshape(-1, 3)
    sums = rgb.sum(axis=0, dtype=np.int64)
    spread = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8)
    return f"{len(rgb) // WIDTH}x{WIDTH};" + ",".join(f"{s / len(rgb):.3f}" for s in sums) + ";" + ",".join(map(str, spread))


def describe(text: str | None) -> tuple:
    media = store(text)
    payload = load(media)
    return (
        len((text or "").encode("utf-8", "surrogatepass")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
        len(media), hashlib.sha256(media).hexdigest(), feature(payload),
    )


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id", with_media: bool = False) -> DataFrame:
    """key and the digest columns of each row; with_media adds the stored bytes themselves."""
    fields = SCHEMA + ", media binary" * with_media

    def run(texts: list) -> list[tuple]:
        return [(*describe(t), *([store(t)] if with_media else [])) for t in texts]

    return per_text(docs, run, fields, text, key)

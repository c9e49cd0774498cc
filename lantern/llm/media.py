"""Operator 5, media columns: payloads stored as lossless WebP images, read back as pixels, and features of these.

A payload is a text's UTF-8 bytes, filled with zeros to a positive multiple of
64: rows of 16 pixels of four samples. A payload of more rows than an image may
have is several images, one after the other.

Defined results: null texts count as empty, and empty texts have one row of
zeros; equal texts have equal images and features; repeated rows are stored
each; an empty table gives an empty result; very long texts are several
images. Other columns are kept by ``store`` and ``read_back``, but for one named like their result,
which is replaced.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, webp

BLOCK, WIDTH = 64, 16
#: Pixels and rows that are stored or read together at most.
AT_ONCE, MOST_ROWS = 1 << 19, 512


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def to_media(payload: bytes) -> bytes:
    """The images that hold a payload."""
    return next(stored_all([payload]))


def stored_all(payloads: Iterable[bytes]) -> Iterator[bytes]:
    """The images of each payload; they are made together up to a bound."""
    for some in _bounded(((payload, len(payload) // 4) for payload in payloads)):
        images = []
        for payload in some:
            pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 4)
            images.append([pixels[k : k + webp.MAX_SIDE] for k in range(0, len(pixels), webp.MAX_SIDE)])
        made = iter(webp.compress_all([x for each in images for x in each]))
        yield from (b"".join([next(made) for _ in each]) for each in images)


def images_of(media: bytes) -> list[bytes]:
    images, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        images.append(media[at : at + size])
        at += size
    return images


def to_pixels(media: bytes) -> np.ndarray:
    """The pixel array of all images in ``media``, one below the other."""
    return next(pixels_all([media]))


def pixels_all(media: Iterable[bytes]) -> Iterator[np.ndarray]:
    """The pixel array of each of ``media``; images are decoded together up to a bound."""
    images = (images_of(stored) for stored in media)
    for some in _bounded((each, sum(math.prod(webp.size_of(x)) for x in each)) for each in images):
        found = iter(webp.decode_all([x for each in some for x in each]))
        for each in some:
            parts = [next(found) for _ in each]
            yield np.concatenate(parts) if len(parts) > 1 else parts[0]


def _bounded(rows: Iterable[tuple[Any, int]]) -> Iterator[list]:
    """Rows, which come with their pixels, in lists of at most MOST_ROWS rows and, but for single rows, AT_ONCE pixels."""
    some, size = [], 0
    for row, n in rows:
        if some and (size + n > AT_ONCE or len(some) == MOST_ROWS):
            yield some
            some, size = [], 0
        some.append(row)
        size += n
    if some:
        yield some


def feature_of(pixels: np.ndarray) -> str:
    """Size, the channels' means and mean changes from row to row, and the samples' entropy in bits."""
    samples = pixels.reshape(-1, 4)
    sums = samples.sum(0, dtype=np.int64)
    change = np.abs(np.diff(pixels.astype(np.int16), axis=0)).sum((0, 1), dtype=np.int64)
    counts = np.bincount(pixels.reshape(-1), minlength=256)
    share = counts[counts > 0] / pixels.size
    entropy = max(float(-(share * np.log2(share)).sum()), 0.0)
    means = ",".join(f"{s / len(samples):.3f}" for s in sums.tolist())
    changes = ",".join(f"{s / len(samples):.3f}" for s in change.tolist())
    return f"{pixels.shape[1]}x{pixels.shape[0]}|{means}|{changes}|{entropy:.4f}"


def store(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """``docs`` with the images of ``text`` in the binary column ``into``."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(stored_all(map(payload_of, texts))), dtype=object)

    return docs.withColumn(into, encode(F.coalesce(F.col(text), F.lit(""))))


def read_back(docs: DataFrame, media: str = "media", into: str = "read") -> DataFrame:
    """``docs`` with what the stored images hold: payload_bytes, payload_sha256, tail_crc32 and feature in the struct ``into``."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for stored in batches:
            rows = []
            for pixels in pixels_all(stored):
                payload = pixels.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), feature_of(pixels)))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return docs.withColumn(into, decode(media))


def pixels(docs: DataFrame, media: str = "media", into: str = "pixels") -> DataFrame:
    """``docs`` with the pixel arrays themselves: height, width and samples (row by row; green, red, blue, alpha)."""

    @F.pandas_udf("height int, width int, samples binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for stored in batches:
            found = list(pixels_all(stored))
            yield pd.DataFrame({"height": [p.shape[0] for p in found], "width": [p.shape[1] for p in found], "samples": [p.tobytes() for p in found]})

    return docs.withColumn(into, decode(media))


def op5_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    read = read_back(store(docs).drop("text"))
    return read.select("doc_id", "n_bytes", "read.payload_bytes", "read.payload_sha256", "read.tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "read.feature")

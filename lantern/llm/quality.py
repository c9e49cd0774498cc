"""Operator 4, quality by compression: which of two dictionaries describes a text in fewer bytes.

One zstandard dictionary is trained on good and one on bad labelled texts. Every
whole text is cut into pieces of ``PIECE`` bytes, each compressed on its own
with either dictionary, so that a long text can't stand in for the dictionary.
The difference of the two compressed sizes, divided by their sum, separates the
classes. A logistic function turns it into a probability; it also sees the two
sizes by the text's length and that length, which say how far the difference
can be trusted (both dictionaries shorten a text that repeats itself), and all
products of two of these. Values are held within those of the calibration texts.

Dictionaries and weights come from a bounded sample: ``PER_CLASS`` labelled
texts of each class, and ``CALIBRATION`` more of each.

Defined results: null texts count as empty and get the score of an empty text;
without labelled rows of both classes every score is 0.5; repeated rows are
scored alike; an empty table gives an empty result; labels beyond 0 and 1 are
ignored. Very long texts are scored whole, in pieces; of a sampled one of over ``common.SAMPLE_CHARS``
characters one part of that length is learned from. Other columns stay as they are, but for one named like the
score, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PER_CLASS, CALIBRATION = 1000, 500
DICTIONARY_BYTES, SAMPLE_BYTES, PIECE, LEVEL = 1 << 16, 2000, 256, 3
THRESHOLD = 0.5
HELD_OUT, FOLDS = 1, 3


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on the texts; their own bytes where they are too few to train on."""
    samples = [t[k : k + SAMPLE_BYTES] for t in texts for k in range(0, len(t), SAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


class Sizer:
    """Compressed sizes under one dictionary."""

    def __init__(self, content: bytes):
        known = zstandard.ZstdCompressionDict(content)
        known.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False).compress

    def size(self, pieces: list[bytes]) -> int:
        return sum(map(len, map(self.compress, pieces)))


def features(text: str, good: Sizer, bad: Sizer) -> tuple[float, float, float, float]:
    raw = text.encode()
    pieces = [raw[k : k + PIECE] for k in range(0, max(len(raw), 1), PIECE)]
    g, b = good.size(pieces), bad.size(pieces)
    return (b - g) / (b + g), g / (len(raw) + 1), b / (len(raw) + 1), float(np.log1p(len(raw)))


@dataclass
class Model:
    good: bytes
    bad: bytes
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def expanded(self, x: np.ndarray) -> np.ndarray:
        x = (np.clip(x, self.low, self.high) - self.mean) / self.scale
        k = x.shape[1]
        return np.column_stack([x, *(x[:, i] * x[:, j] for i in range(k) for j in range(i, k))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        # summed row by row: a matrix product may round equal rows differently
        return 1 / (1 + np.exp(-np.clip((self.expanded(x) * self.weights[:-1]).sum(1) + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """The dictionaries and the calibration; None without rows of both classes."""
    sample, _ = common.labelled_sample(docs, labels, label, FOLDS, HELD_OUT, PER_CLASS + CALIBRATION)
    most = min((max((r["rank"] for r in sample if r["label"] == c), default=0) for c in (0, 1)))
    if not most:
        return None
    # with few texts of a class, a third of them calibrates
    upto = min(PER_CLASS, max(1, most * 2 // 3))
    texts = [[r["text"].encode() for r in sample if r["label"] == c and r["rank"] <= upto] for c in (0, 1)]
    bad, good = map(dictionary, texts)
    rest = [r for r in sample if upto < r["rank"] <= upto + CALIBRATION]
    if len({r["label"] for r in rest}) < 2:
        rest = sample
    sizers = Sizer(good), Sizer(bad)
    x = np.array([features(r["text"], *sizers) for r in rest])
    low, high = np.quantile(x, [0.005, 0.995], axis=0)
    model = Model(good, bad, low, high, x.mean(0), np.maximum(x.std(0), 1e-9), np.zeros(0))
    model.weights = common.logistic(model.expanded(x), [r["label"] for r in rest])
    return model


def score(docs: DataFrame, model: Model | None, into: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text; the model has two dictionaries of bounded size."""
    if model is None:
        return docs.withColumn(into, F.lit(0.5))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        sizers = Sizer(model.good), Sizer(model.bad)
        for texts in batches:
            x = np.array([features(t, *sizers) for t in texts]).reshape(-1, 4)
            yield pd.Series(model.probability(x))

    return docs.withColumn(into, scores(F.coalesce(F.col("text"), F.lit(""))))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, fit(docs, common.labels(spark, sf_dir)))
    return scored.select("doc_id", F.coalesce(common.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

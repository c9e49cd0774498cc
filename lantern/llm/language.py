"""Operator 8, language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

A text's words, with a mark at either end, give character n-grams of one to
``MAX_N`` characters, hashed into ``BUCKETS``. A feature is the n-gram's share
of all the text's n-grams times its inverse document frequency. Weights are
trained one text at a time by follow-the-regularised-leader with elastic-net
penalties, which leaves most of them zero; a temperature fitted on other
labelled texts calibrates the probabilities.

Scores are linear in the shares, so a text's logits are the mean over its words
of what each word adds, which a worker computes once for each word.

The model is fitted to ``PER_LANGUAGE`` texts at most of each language, of all
languages there are; one in ``CALIBRATES`` of the texts fits the temperature.

Defined results: null texts, and texts without a letter, are ``und`` with score
0; null languages aren't learned; without labelled texts everything is ``und``;
repeated rows are predicted alike; an empty table gives an empty result. Very long texts are
predicted whole; of a sampled one of over ``common.SAMPLE_CHARS`` characters one part of that length is learned from, so that
a sample's size is bounded by the number of languages. Other columns stay as they are, but for
those named like the prediction and its score, which are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_N, BUCKETS = 3, 1 << 16
PER_LANGUAGE, CALIBRATES = 1200, 6
HELD_OUT, FOLDS = 2, 4
#: Follow-the-regularised-leader: learning rate, its offset, and the penalties.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 3
#: Shares are small numbers; features are these times this.
SCALE = 30.0
#: Words, characters of words, and numbers that a worker remembers.
CACHE_WORDS, CACHE_CHARS, CACHE_NUMBERS = 500_000, 16_000_000, 16_000_000
UNDETERMINED = "und"
MARK = "\x02"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def hashed_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of ``words``, and for each the index of its word, in order of the words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"{MARK}{w}{MARK}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    position, buckets, owners = np.arange(len(codes)), [], []
    mixed = np.zeros(len(codes), np.uint64)
    for n in range(1, MAX_N + 1):
        mixed = mixed[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        inside = position[: len(mixed)] + n <= ends[: len(mixed)]
        h = mixed[inside] * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((h >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[: len(mixed)][inside])
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], owners[order]


class Model:
    """``table``: per bucket, what one n-gram adds to each language's logit before the division by their number."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.table, self.bias, self.temperature, self.key = languages, table, bias, temperature, uuid.uuid4().hex


class WordTable:
    """Rows of sums and n-gram counts by word; new words are added together."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.rows = np.zeros((1024, self.table.shape[1] + 1))

    def sums(self, words: list[str]) -> np.ndarray:
        """Per language the sum over the n-grams of all words, and last their number."""
        new = set(words).difference(self.index)
        if new and (len(self.index) + len(new) > min(CACHE_WORDS, CACHE_NUMBERS // self.rows.shape[1]) or self.chars > CACHE_CHARS):
            self.clear()
            new = set(words)
        if new:
            self.chars += sum(map(len, new))
            fresh, start = sorted(new), len(self.index)
            while start + len(fresh) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            buckets, owners = hashed_grams(fresh)
            first = np.searchsorted(owners, np.arange(len(fresh)))
            self.rows[start : start + len(fresh), :-1] = np.add.reduceat(self.table[buckets], first, 0)
            self.rows[start : start + len(fresh), -1] = np.bincount(owners, minlength=len(fresh))
            self.index.update(zip(fresh, range(start, start + len(fresh)), strict=True))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.rows[at].sum(0)


_TABLES: dict[str, WordTable] = {}


def table_of(model: Model) -> WordTable:
    if model.key not in _TABLES:
        _TABLES.clear()
        _TABLES[model.key] = WordTable(model.table)
    return _TABLES[model.key]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], marks: list[str]) -> Model | None:
    """Fits the model; the order of ``texts`` is the order of learning, so equal input gives an equal model."""
    found = [(t, m) for t, m in zip(texts, marks, strict=True) if words_of(t)]
    languages = sorted({m for _, m in found})
    if not languages:
        return None
    seen = []
    for text, _ in found:
        buckets, counts = np.unique(hashed_grams(words_of(text))[0], return_counts=True)
        seen.append((buckets, counts / counts.sum()))
    y = np.array([languages.index(m) for _, m in found])
    learn = np.arange(len(found)) % CALIBRATES != 0 if len(found) > 4 * CALIBRATES else np.ones(len(found), bool)
    df = np.bincount(np.concatenate([seen[i][0] for i in np.flatnonzero(learn)]), minlength=BUCKETS)
    idf = SCALE * (1 + np.log((learn.sum() + 1) / (df + 1)))
    k = len(languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    weights = lambda z, n: np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(EPOCHS):
        for i in np.flatnonzero(learn):
            at = np.append(seen[i][0], BUCKETS)  # the last one is the bias
            x = np.append(seen[i][1] * idf[seen[i][0]], 1.0)[:, None]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax((x * w).sum(0))
            p[y[i]] -= 1
            g = x * p
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = weights(z, n)
    table, bias = w[:-1] * idf[:, None], w[-1]
    rest = np.flatnonzero(~learn) if (~learn).any() else np.arange(len(found))
    logits = np.array([(table[seen[i][0]] * seen[i][1][:, None]).sum(0) + bias for i in rest])
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(rest)), y[rest]], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    return Model(languages, table, bias, float(temperature))


def fit(docs: DataFrame) -> Model | None:
    """Learns every language of ``docs`` from a bounded sample of its texts outside the held-out fold."""
    allowed = docs.filter(F.col("lang").isNotNull() & (common.fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in allowed.groupBy("lang").count().collect()}
    chosen = common.lowest_hashes(allowed.select("doc_id", "lang"), "doc_id", "lang", PER_LANGUAGE, counts)
    chosen = chosen.select(F.col("doc_id").alias("s_id"), F.col("lang").alias("s_lang"), "rank")
    rows = allowed.join(F.broadcast(chosen), (F.col("doc_id") == F.col("s_id")) & (F.col("lang") == F.col("s_lang"))).select("lang", common.learned_part("text", "doc_id").alias("text"), "rank").collect()
    rows.sort(key=lambda r: (r["rank"], r["lang"], r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None, prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language of every whole text and its calibrated probability."""
    if model is None:
        return docs.withColumn(prediction, F.lit(UNDETERMINED)).withColumn(score, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        table = table_of(model)
        for texts in batches:
            common.remembering(table, table.clear)
            found, scores = [], []
            for text in texts:
                if text is None or not any(map(str.isalpha, text)):
                    found.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                sums = table.sums(words_of(text))
                p = softmax((sums[:-1] / sums[-1] + model.bias) / model.temperature)
                found.append(model.languages[best := int(p.argmax())])
                scores.append(float(p[best]))
            yield pd.DataFrame({"lang": found, "score": scores})

    name = common.fresh(docs, "found")["found"]
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (prediction.lower(), score.lower())]
    return docs.withColumn(name, look("text")).select(*others, F.col(name).getField("lang").alias(prediction), F.col(name).getField("score").alias(score))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.coalesce(common.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")

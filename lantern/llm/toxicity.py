"""Operator 2, toxicity by class-conditional Kneser-Ney models.

Two character models of order ``ORDER``, one of toxic and one of ordinary
texts, read each word between its boundaries. Their highest-order counts are
their own; all lower orders are continuation counts shared by both, so that a
rare expression is smoothed alike in either class and only what is typical of
one class separates them. A word's evidence is the difference of its
log-likelihoods divided by its length. A text's score is a logistic function of
its strongest word, of the mean of its ``TOP`` strongest, and of the
length-normalised difference of the whole text.

The models are fitted to all labelled texts, each whole: those of three quarters of the ids, by hash, are counted, and the logistic
function is fitted to the rest (to all of them where either part lacks a class). Words and grams are counted by Spark, and so are the
sums of each of Newton's steps; the driver gets one row for each different gram and the sums. The function is fitted as if the classes
were of one size; its bias is then moved by the logarithm of their shares among all labels, so that scores are
probabilities where toxic texts are as rare as the labels say.

Defined results: null and empty texts have no evidence and get the score of
none; without labelled rows of both classes every score is 0; repeated rows are
scored alike; an empty table gives an empty result; labels beyond 0 and 1 and
null ids of labels are ignored. Very long texts are scored whole; very long words are scored
but not remembered. Other columns stay as they are, but for one named like the score, which is replaced.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exact_dedup

ORDER, DISCOUNT, TOP = 5, 0.75, 3
#: One labelled text in so many calibrates.
CALIBRATION = 4
#: Every character that hasn't been seen shares one place in a uniform distribution over so many.
CHARACTERS = 5000
THRESHOLD = 0.3
HELD_OUT, FOLDS = 2, 4
CACHE_WORDS, CACHE_CHARS = 500_000, 64
_WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def grams_of(word: str) -> list[str]:
    """The word's characters and its end, each with up to ``ORDER - 1`` characters before it."""
    s = f"\x02{word}\x03"
    return [s[max(0, k - ORDER + 1) : k + 1] for k in range(1, len(s))]


class Model:
    """What separates two Kneser-Ney models: for each gram the difference of their log-probabilities.

    ``seen`` has it for grams that either class has; for all others it depends
    only on how much each class leaves to the shared lower orders after the
    gram's history: ``back``.
    """

    def __init__(self, counts: tuple[Counter, Counter]):
        self.key = uuid.uuid4().hex
        grams = set(counts[0]) | set(counts[1])
        shared: Counter = Counter()
        left = grams
        while left:
            below = Counter(g[1:] for g in left if len(g) > 1)
            shared.update(below)
            left = set(below)
        history: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for g, n in shared.items():
            history[g[:-1]][0] += n
            history[g[:-1]][1] += 1
        known: dict[str, float] = {}

        def lower(g: str) -> float:
            """The shared probability of the last character after those before it."""
            if g not in known:
                rest = lower(g[1:]) if len(g) > 1 else 1 / CHARACTERS
                n, kinds = history.get(g[:-1], (0, 0))
                known[g] = (max(shared[g] - DISCOUNT, 0) + DISCOUNT * kinds * rest) / n if n else rest
            return known[g]

        own: tuple[dict, dict] = (defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]))
        for c in (0, 1):
            for g, n in counts[c].items():
                own[c][g[:-1]][0] += n
                own[c][g[:-1]][1] += 1

        def probability(c: int, g: str) -> float:
            n, kinds = own[c].get(g[:-1], (0, 0))
            return (max(counts[c][g] - DISCOUNT, 0) + DISCOUNT * kinds * lower(g[1:])) / n if n else lower(g[1:])

        left_over = lambda c, h: DISCOUNT * own[c][h][1] / own[c][h][0] if h in own[c] else 1.0
        self.seen = {g: math.log(probability(1, g) / probability(0, g)) for g in grams}
        self.back = {h: math.log(left_over(1, h) / left_over(0, h)) for h in set(own[0]) | set(own[1])}

    def difference(self, word: str) -> float:
        """log P(word | toxic) - log P(word | ordinary)."""
        seen, back, total = self.seen, self.back, 0.0
        for g in grams_of(word):
            d = seen.get(g)
            total += back.get(g[:-1], 0.0) if d is None else d
        return total


class WordEvidence(dict):
    """Length-normalised differences by word, each computed once."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> float:
        value = self.model.difference(word) / (len(word) + 1)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


_EVIDENCE: dict[str, WordEvidence] = {}


def evidence_of(model: Model) -> WordEvidence:
    if model.key not in _EVIDENCE:
        _EVIDENCE.clear()
        _EVIDENCE[model.key] = WordEvidence(model)
    return _EVIDENCE[model.key]


def features(text: str, evidence: WordEvidence) -> tuple[float, float, float]:
    words = words_of(text)
    if not words:
        return 0.0, 0.0, 0.0
    each = np.fromiter(map(evidence.__getitem__, words), float, len(words))
    lengths = np.fromiter(map(len, words), float, len(words)) + 1
    strongest = np.maximum(np.partition(each, -TOP)[-TOP:] if len(each) > TOP else each, 0)
    return float(max(each.max(), 0)), float(strongest.sum() / TOP), float((each * lengths).sum() / lengths.sum())


def _frame(c: int, name: str, found: Counter) -> pd.DataFrame:
    return pd.DataFrame({"label": np.full(len(found), c, np.int32), name: pd.Series(list(found), dtype=object), "n": np.fromiter(found.values(), np.int64, len(found))})


def counted(texts: DataFrame) -> tuple[Counter, Counter]:
    """How often each gram is in the whole texts (text, label) of each class."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in (0, 1):
                found: Counter = Counter()
                for t in batch["text"][batch["label"] == c]:
                    found.update(words_of(t))
                yield _frame(c, "word", found)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for c, word, n in zip(batch["label"], batch["word"], batch["n"], strict=True):
                for g in grams_of(word):
                    found[c][g] += n
            for c in (0, 1):
                yield _frame(c, "gram", found[c])

    per_word = texts.select("text", "label").mapInPandas(words, "label int, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n"))
    per_gram = per_word.mapInPandas(grams, "label int, gram string, n long").groupBy("gram").agg(*(F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)))
    found = per_gram.toPandas()
    return tuple(Counter({g: int(n) for g, n in zip(found["gram"], found[f"n{c}"], strict=True) if n}) for c in (0, 1))


def calibrated(texts: DataFrame, model: Model) -> np.ndarray:
    """The weights of the logistic function of texts (text, label), the bias last."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = evidence_of(sent.value)
        for batch in batches:
            common.remembering(evidence, evidence.clear)
            x = np.array([features(t, evidence) for t in batch["text"]]).reshape(-1, 3)
            yield pd.DataFrame({"x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "label": batch["label"].to_numpy()})

    table = common.cut(texts.select("text", "label").mapInPandas(measured, "x0 double, x1 double, x2 double, label int"))
    weights = common.logistic_of(table, ["x0", "x1", "x2"], "label")
    common.drop(table)
    return weights


def learned_from(docs: DataFrame, allowed: DataFrame, n: int) -> DataFrame:
    """Each of the ``n`` labels (s_id, label) with its whole text; a null one is empty.

    Texts without a label stay where they are: a Bloom filter of the labelled ids sorts out nearly all of them
    before the join, which is by ids and exact. The plan is the same at every size, so what moves is in proportion to it.
    """
    bits, texts = exact_dedup._bits(n), docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("string").alias("_id"))
    bitmaps = exact_dedup.repeated_bits(allowed.select(F.col("s_id").cast("string").alias("_id")), "_id", bits, 1)
    likely = exact_dedup.candidates(texts.filter(common.fold("doc_id", FOLDS) != HELD_OUT), "_id", bitmaps, bits).filter("candidate")
    return likely.join(allowed.hint("merge"), F.col("doc_id") == F.col("s_id")).select("text", "s_id", "label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[Model, np.ndarray] | None:
    """The models and the weights of the logistic function; None without rows of both classes."""
    allowed = labels.filter(F.col(label).isin(0, 1) & (common.fold("doc_id", FOLDS) != HELD_OUT)).select(F.col("doc_id").alias("s_id"), F.col(label).cast("int").alias("label"))
    labelled = {r["label"]: r["count"] for r in allowed.groupBy("label").count().collect()}
    calibrates = (F.pmod(F.xxhash64("s_id"), F.lit(CALIBRATION)) == 0).alias("calibrates")
    texts = common.cut(learned_from(docs, allowed, sum(labelled.values())).select("text", "label", calibrates))
    parts = {(r["label"], r["calibrates"]) for r in texts.select("label", "calibrates").distinct().collect()}
    whole = len(parts) < 4
    counts = counted(texts if whole else texts.filter("NOT calibrates"))
    if not whole and not (counts[0] and counts[1]):
        whole, counts = True, counted(texts)
    if not counts[0] or not counts[1]:
        return None
    model = Model(counts)
    weights = calibrated(texts if whole else texts.filter("calibrates"), model)
    weights[-1] += math.log(labelled[1] / labelled[0])  # the function was fitted to classes that weigh the same
    common.drop(texts)
    return model, weights


def score(docs: DataFrame, fitted: tuple[Model, np.ndarray] | None, into: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text. The models have one number for each different gram of the labelled texts."""
    if fitted is None:
        return docs.withColumn(into, F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, weights = sent.value
        evidence = evidence_of(model)
        for texts in batches:
            common.remembering(evidence, evidence.clear)
            x = np.array([features(t, evidence) for t in texts]).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip((x * weights[:-1]).sum(1) + weights[-1], -30, 30))))

    return docs.withColumn(into, scores(F.coalesce(F.col("text"), F.lit(""))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, fit(docs, common.labels(spark, sf_dir)))
    return scored.select("doc_id", F.coalesce(common.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.sources.checkpoints import cut, delete, drop, ensure_folder

__all__ = ["cut", "delete", "drop", "ensure_folder"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word is a run of anything but space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: A group with more than one row in this many is joined on its own, so at most this many groups are broadcast.
HEAVY_PARTS = 1000
#: Of a text of more characters, one part of this length is learned from, so that a sample of so many rows is of bounded size.
SAMPLE_CHARS = 200_000


#: Seconds after which a worker forgets what an operator that no longer runs in it has remembered.
IDLE_SECONDS = 10
_REMEMBERED: dict[int, tuple[Callable[[], None], float]] = {}


def remembering(owner: object, forget: Callable[[], None]) -> None:
    """Called by a worker's operator with each batch: what others remember, and haven't used for a while, is forgotten.

    Workers are used again by later stages, so without this they would hold the sum of all operators' memories.
    """
    now = time.monotonic()
    for key, (other, last) in list(_REMEMBERED.items()):
        if key != id(owner) and now - last > IDLE_SECONDS:
            other()
            del _REMEMBERED[key]
    _REMEMBERED[id(owner)] = forget, now


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; pure ASCII texts take the faster built-in path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; null ids fall into no fold."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % parts


def learned_part(text: str | Column, doc_id: str | Column) -> Column:
    """What a model learns from a text that was sampled: all of it, or of a very long one the part that a hash of its id picks."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    parts = F.greatest(F.ceil(F.length(text) / SAMPLE_CHARS), F.lit(1))
    start = (F.pmod(F.xxhash64(doc_id), parts) * SAMPLE_CHARS + 1).cast("int")
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.substring(text, start, F.lit(SAMPLE_CHARS)))


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """For each wanted helper column, a name that ``df`` doesn't have (case-insensitively)."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out[name] = new
    return out


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with one row per ``key`` of ``groups``, without putting a hot key's rows into one task.

    ``size`` is the group's row count. Groups of over ``total / HEAVY_PARTS``
    rows number at most ``HEAVY_PARTS``: those are broadcast, so their rows
    stay where they are; all others are joined by a shuffle.
    """
    limit = max(1, total // HEAVY_PARTS)
    names = fresh(rows, *groups.columns)
    hot_names = fresh(rows, "heavy_key", *(f"heavy_{c}" for c in groups.columns if c != key))
    hot_key, hot_of = hot_names["heavy_key"], {c: hot_names[f"heavy_{c}"] for c in groups.columns if c != key}
    side = groups.select(F.col(key).alias(names[key]), *(F.col(c).alias(names[c]) for c in groups.columns if c != key))
    heavy = F.broadcast(side.filter(F.col(names[size]) > limit).select(F.col(names[key]).alias(hot_key), *(F.col(names[c]).alias(hot_of[c]) for c in hot_of)))
    light = side.filter(F.col(names[size]) <= limit)
    marked = rows.join(heavy, rows[key] == heavy[hot_key], "left")
    out = [c for c in groups.columns if c != key]
    hot = marked.filter(F.col(hot_key).isNotNull()).select(*rows.columns, *(F.col(hot_of[c]).alias(c) for c in out))
    rest = marked.filter(F.col(hot_key).isNull()).select(*rows.columns)
    cold = rest.join(light, rest[key] == light[names[key]], how).select(*(rest[c] for c in rows.columns), *(F.col(names[c]).alias(c) for c in out))
    return hot.unionByName(cold)


def lowest_hashes(rows: DataFrame, key: str, by: str, most: int, counts: dict) -> DataFrame:
    """Of each class ``by``, the ``most`` rows of lowest hash of ``key``, with their ``rank``.

    With the classes' ``counts``, hashes that can't be among the lowest go first
    (but for once in far more runs than there will be), so that about twice
    ``most`` rows of a class are ranked, however many there are.
    """
    from pyspark.sql import Window

    h = F.xxhash64(key)
    limits = {c: -(1 << 63) + int(2 * (most + 100) / n * (1 << 64)) for c, n in counts.items() if n > 4 * most}
    kept = F.lit(True)
    for c, limit in limits.items():
        kept = kept & ((F.col(by) != c) | (h < limit))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(h, key))
    return rows.filter(kept).withColumn("rank", rank).filter(F.col("rank") <= most)


def labelled_sample(docs: DataFrame, marks: DataFrame, label: str, fold_parts: int, held_out: int, per_class: int) -> tuple[list, dict]:
    """At most ``per_class`` labelled rows of each class 0 and 1, as Rows (text, label, rank), none of the held-out fold; and how many of each class there are.

    The rows of lowest hash are taken, so the sample is spread over the table
    and doesn't depend on its layout. It is chosen among the labels alone; only
    the chosen ids, a bounded number, are joined with the texts.
    """
    allowed = marks.filter(F.col(label).isin(0, 1) & (fold("doc_id", fold_parts) != held_out)).select(F.col("doc_id").alias("s_id"), F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in allowed.groupBy("label").count().collect()}
    chosen = lowest_hashes(allowed, "s_id", "label", per_class, counts)
    texts = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("s_id")).select(learned_part("text", "doc_id").alias("text"), "label", "rank")
    return sorted(texts.collect(), key=lambda r: (r["rank"], r["label"], r["text"])), counts


def logistic(features, labels, l2: float = 1e-3, steps: int = 50):
    """Weights of a logistic regression, the bias last, by Newton's method; classes weigh the same."""
    import numpy as np

    x, y = np.column_stack([features, np.ones(len(labels))]), np.asarray(labels, float)
    share = np.clip(y.mean(), 1e-9, 1 - 1e-9)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    w, ridge = np.zeros(x.shape[1]), l2 * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic_of(table: DataFrame, features: list[str], label: str, l2: float = 1e-3, steps: int = 50):
    """What ``logistic`` returns, for a table of any size: each of Newton's steps takes its sums from one pass over all rows."""
    import numpy as np

    n = {r[0]: r[1] for r in table.groupBy(label).count().collect()}
    total = sum(n.values())
    share = min(max(n.get(1, 0) / total, 1e-9), 1 - 1e-9)
    y, size = F.col(label), len(features) + 1
    x = [*(F.col(c) for c in features), F.lit(1.0)]
    weight = F.when(y == 1, 0.5 / share).otherwise(0.5 / (1 - share)) / total
    w, ridge = np.zeros(size), l2 * np.eye(size)
    ridge[-1, -1] = 1e-9
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    for _ in range(steps):
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum((F.lit(float(v)) * c for v, c in zip(w, x, strict=True)), F.lit(0.0))))
        row = table.withColumn("_p", 1 / (1 + F.exp(-z))).withColumn("_h", weight * F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-9)))
        sums = row.agg(*(F.sum(F.col("_h") * x[i] * x[j]) for i, j in pairs), *(F.sum(weight * (F.col("_p") - y) * c) for c in x)).first()
        hessian = np.zeros((size, size))
        for (i, j), v in zip(pairs, sums, strict=False):
            hessian[i, j] = hessian[j, i] = v
        step = np.linalg.solve(hessian + ridge, np.array(sums[len(pairs) :], float) + ridge @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.round(w, 9)  # sums of parts come in any order

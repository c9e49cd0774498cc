"""Operator 6, packing documents into sequences: Martello-Toth reduction, then best fit.

Lengths are whole numbers up to the capacity, so a packing depends on the
histogram of lengths alone: at most ``capacity`` rows, however many documents
there are. The driver packs that histogram. First the dominance reduction:
going down the lengths, a set of at most three pieces that provably dominates
every other way to fill a bin with the longest one is fixed for good, and the
instance shrinks. What remains is packed best fit, longest first. Bins of equal
content are handled together, so the work and the result (the layout table)
don't grow with the number of documents.

Pieces of one length are then ranked without gathering them: they are dealt out
by (length, salt), numbered there, and shifted by the counts of the lower
salts. A piece's rank among its length gives its place by a binary search in
the layout.

Defined results: null and empty texts are one piece holding the end id alone;
repeated rows, and rows of null or equal ids, are packed each; an empty table gives an empty
result; documents over the capacity, however long, are cut, all others stay whole. ``pack``
returns columns of its own; ``place`` keeps other columns but for those named sequence_id
and offset, which are replaced, whatever else they are named.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOKENIZER = "word_bpe_49k.json"
CAPACITY, END = 4096, 1
#: Rows that one salt of a length is meant to have.
SALT_ROWS = 1 << 17
#: Chunks kept with their ids in each worker, and the longest of them in characters.
CACHE_CHUNKS, CACHE_CHARS = 500_000, 48
#: White space to str.split() but not to the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"


class ChunkTokenizer:
    """Ids of whole texts, as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins what it separates, so the ids
    of a text are those of its white-space chunks, most of which are remembered.
    Nor does it join letters with the punctuation after them. New words are
    tokenized as one text; each ends with the one id that ends a word.
    """

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        known, words, rest = self.known, {}, []
        for chunk in chunks:
            word = chunk.rstrip(".,;:!?")
            if word.isalpha():
                words[word] = None
                if len(word) < len(chunk):
                    rest.append((chunk, word, chunk[len(word) :]))
            else:
                known[chunk] = self.encode(chunk)
        if new := [w for w in words if w not in known]:
            encoding = self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0]
            ids = np.array(encoding.ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) == len(new):
                raw, start = ids.tobytes(), 0
                for word, end in zip(new, ends.tolist(), strict=True):
                    known[word], start = raw[start:end], end
            else:  # a letter is written as several words
                known.update((w, self.encode(w)) for w in new)
        for chunk, word, tail in rest:
            if tail not in known:
                known[tail] = self.encode(tail)
            known[chunk] = known[word] + known[tail]

    def ids(self, text: str) -> bytes:
        if "<|" in text and any(s in text for s in self.special):
            return self.encode(text)
        chunks = text.split(" ") if any(s in text for s in SEPARATORS) else text.split()
        known = self.known
        if new := set(chunks).difference(known):
            if len(known) + 3 * len(new) > CACHE_CHUNKS:
                known.clear()
                new = set(chunks)
            self.learn(new)
        out = b"".join(map(known.__getitem__, chunks))
        for chunk in new:
            if len(chunk) > CACHE_CHARS:
                del known[chunk]
        return out


_TOKENIZERS: dict[int, ChunkTokenizer] = {}


def tokenizer_of(model: bytes) -> ChunkTokenizer:
    if (key := zlib.crc32(model)) not in _TOKENIZERS:
        _TOKENIZERS[key] = ChunkTokenizer(model)
    return _TOKENIZERS[key]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array of its token ids)."""
    with open(path or public_tokenizers.path(TOKENIZER), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = tokenizer_of(model.value)
        for batch in batches:
            common.remembering(tokenizer, tokenizer.known.clear)
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = tokenizer.ids(text) + tail
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    rows.append((doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype("int32")] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, schema)


class Layout:
    """Packs a histogram of lengths. ``bins`` has (number of equal bins, lengths in one bin)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.bins = capacity, []
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.reduce()
        self.best_fit()

    def fix(self, n: int, *lengths: int) -> None:
        self.bins.append((n, lengths))
        for s in lengths:
            self.left[s] -= n
            if not self.left[s]:
                del self.left[s]

    def reduce(self) -> None:
        """Fixes dominating sets, from the longest piece down."""
        c, left = self.capacity, self.left
        for j in sorted(left, reverse=True):
            while left.get(j):
                if not self.dominating(j, c - j):
                    break

    def dominating(self, j: int, room: int) -> bool:
        """Fixes bins with ``j`` if some set dominates all others that hold it; equal bins at once."""
        left = self.left
        others = sorted(s for s, n in left.items() if s != j or n > 1)  # one j is in the bin itself
        several = lambda *x: all(left[s] - (s == j) >= x.count(s) for s in x)
        fit = [s for s in others if s <= room]
        if not fit:
            self.fix(left[j], j)
            return True
        best, small = fit[-1], fit[0]
        pair = next(((small, s) for s in fit if several(small, s)), None)
        if best == room or pair is None or sum(pair) > room:  # a perfect fit, or no two others fit
            self.fix(left[j] // 2 if best == j else min(left[j], left[best]), j, best)
            return True
        third = next((s for s in fit if several(*pair, s)), None)
        if third is not None and sum(pair) + third <= room:
            return False  # more than two others fit: nothing is proved
        a, b = max(((s, t) for s in fit for t in [next((t for t in reversed(fit) if t <= min(s, room - s) and several(s, t)), 0)] if t), key=lambda x: (sum(x), x))
        if best >= a + b:
            self.fix(left[j] // 2 if best == j else min(left[j], left[best]), j, best)
            return True
        # the two best others: provably dominating if no two pieces between them would fit better
        between = sorted([s for s in fit if b < s < a for _ in range(min(2, left[s] - (s == j)))] + [a] * min(2, left[a] - 1 - (a == j)) + [b] * min(2, left[b] - 1 - (b == j)))
        if best == a and (not between or len(between) == 1 or sum(between[:2]) + j > self.capacity):
            uses = {s: (j, a, b).count(s) for s in (j, a, b)}
            self.fix(max(1, min((left[s] - 4) // n for s, n in uses.items())), j, a, b)
            return True
        return False

    def best_fit(self) -> None:
        """Each piece, longest first, into the fullest bin that has room for it."""
        open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
        rooms = np.zeros(self.capacity + 1, bool)
        for s in sorted(self.left, reverse=True):
            n = self.left[s]
            while n:
                found = s + int(np.argmax(rooms[s:])) if rooms[s:].any() else 0
                if found:
                    m, lengths = open_bins[found].pop()
                    rooms[found] = bool(open_bins[found])
                else:
                    found, m, lengths = self.capacity, n, ()
                each = found // s
                whole = min(m, n // each)
                parts = [(whole, each)] if whole else []
                if whole < m and (rest := n - whole * each):  # less than a bin takes
                    parts.append((1, min(rest, each)))
                n -= sum(k * e for k, e in parts)
                if found < self.capacity or lengths:
                    parts.append((m - sum(k for k, _ in parts), 0))
                for k, e in parts:
                    if k:
                        open_bins[room := found - e * s].append((k, lengths + (s,) * e))
                        rooms[room] = True
        self.bins += [b for bins in open_bins.values() for b in bins]
        self.left = {}

    def table(self) -> np.ndarray:
        """Rows (length, first rank, first sequence, pieces of this length in a bin, offset of the first), sorted."""
        rows, used, sequence = [], defaultdict(int), 0
        for n, lengths in self.bins:
            offset = 0
            for s in dict.fromkeys(lengths):
                k = lengths.count(s)
                rows.append((s, used[s], sequence, k, offset))
                used[s] += n * k
                offset += s * k
            sequence += n
        return np.array(sorted(rows), "int64").reshape(-1, 5)


def ranked(items: DataFrame, into: str = "rank") -> DataFrame:
    """``items`` with the rank ``into``, from 0 among the pieces of a length; no length is gathered in one task."""
    total = items.count()
    salts = max(16, total // SALT_ROWS)
    names = common.fresh(items, "salt", "own", "shift", "s_length", "s_salt")
    salt, own, shift, s_length, s_salt = names.values()
    salted = items.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy(F.col("length").alias(s_length), F.col(salt).alias(s_salt)).agg(F.count(F.lit(1)).alias("n"))
    by_length = Window.partitionBy(s_length).orderBy(s_salt).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(s_length, s_salt, F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias(shift))
    by_salt = Window.partitionBy("length", salt).orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn(own, F.row_number().over(by_salt) - 1)
    both = numbered.join(before, (F.col("length") == F.col(s_length)) & (F.col(salt) == F.col(s_salt)))
    return both.withColumn(into, F.col(own) + F.col(shift)).drop(*names.values())


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with a column ``length``) with sequence_id and offset."""
    histogram = items.groupBy("length").count().collect()  # at most ``capacity`` rows
    table = Layout({r["length"]: r["count"] for r in histogram}, capacity).table()
    layout = items.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = layout.value
        scale = np.int64(1) << 48
        at = np.searchsorted(t[:, 0] * scale + t[:, 1], length.to_numpy("int64") * scale + rank.to_numpy("int64"), "right") - 1
        beyond = rank.to_numpy("int64") - t[at, 1]
        return pd.DataFrame({"sequence_id": t[at, 2] + beyond // t[at, 3], "offset": t[at, 4] + beyond % t[at, 3] * t[at, 0]})

    rank, place = common.fresh(items, "rank", "place").values()
    others = [F.col(f"`{c}`") for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    return ranked(items, rank).withColumn(place, look_up("length", rank)).select(*others, f"{place}.sequence_id", f"{place}.offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, its ids."""
    return place(common.cut(pieces(docs, capacity, end, path, with_ids)), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir), with_ids=False)

"""Operator 3, token counts by heap-and-linked-list byte-pair merging.

The vocabulary is read from a SentencePiece BPE model with byte fallback. A
text becomes symbols, one for each character; the lowest-ranked adjacent pair is
popped from a heap and merged in a linked list until none is left. A symbol
that is no piece stands for its UTF-8 bytes. The count is the initial symbols
minus the merges; no token ids are made.

No piece has the space mark after another character, so merges never cross the
start of a word and each word's count can be remembered.

Defined results: null and empty texts have no tokens; repeated rows are counted
each; an empty table gives an empty result. Very long texts are counted whole. Other columns
stay as they are, but for one named like the count, which is replaced.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
#: Words kept with their counts in each worker, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 1_000_000, 32


class BytePairCounter:
    """Counts tokens by the ranks of one model; ``model`` is the file's content."""

    def __init__(self, model: bytes):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(reader.vocab_size())
        usual = [i for i in ids if not (reader.is_control(i) or reader.is_byte(i) or reader.is_unknown(i) or reader.is_unused(i))]
        #: Merging into the piece of highest score comes first; equal scores go from left to right.
        self.rank = {reader.id_to_piece(i): -reader.get_score(i) for i in usual}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece has the space mark after another character")
        self.pieces = frozenset(p for p in self.rank if len(p) == 1)
        #: Characters that stand side by side in a piece; between any other two nothing is ever merged.
        self.joints = frozenset(p[i : i + 2] for p in self.rank for i in range(len(p) - 1))
        self.units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, int] = {}

    def merges(self, symbols: list[str]) -> int:
        """How many merges a list of symbols allows, lowest rank first."""
        ranks, pop, push, done = self.rank.get, heapq.heappop, heapq.heappush, 0
        pairs = list(map(str.__add__, symbols, symbols[1:]))
        heap = [(r, i, i + 1, len(pairs[i])) for i, r in enumerate(map(ranks, pairs)) if r is not None]
        if not heap:
            return 0
        before, after = list(range(-1, len(pairs))), [*range(1, len(symbols)), -1]
        heapq.heapify(heap)
        while heap:
            _, left, right, size = pop(heap)
            one, other = symbols[left], symbols[right]
            if not one or not other or len(one) + len(other) != size:
                continue  # one of the two has been merged meanwhile
            symbols[left] = merged = one + other
            symbols[right] = ""
            after[left] = follower = after[right]
            if follower >= 0:
                before[follower] = left
                r = ranks(merged + symbols[follower])
                if r is not None:
                    push(heap, (r, left, follower, len(merged) + len(symbols[follower])))
            leader = before[left]
            if leader >= 0:
                r = ranks(symbols[leader] + merged)
                if r is not None:
                    push(heap, (r, leader, left, len(symbols[leader]) + len(merged)))
            done += 1
        return done

    def part(self, part: str) -> int:
        symbols = list(part)
        initial = len(part) if self.pieces.issuperset(symbols) else sum(1 if c in self.rank else len(c.encode()) for c in part)
        return initial - self.merges(symbols)

    def unit(self, unit: str) -> int:
        """A word's count: the sum over the parts between which nothing can merge."""
        joints, known, total, start = self.joints, self.known, 0, 0
        for i, pair in enumerate(map(str.__add__, unit, unit[1:]), 1):
            if pair not in joints:
                part, start = unit[start:i], i
                n = known.get(part)
                total += self.remember(part, self.part(part)) if n is None else n
        if not start:
            return self.part(unit)
        n = known.get(part := unit[start:])
        return total + (self.remember(part, self.part(part)) if n is None else n)

    def remember(self, unit: str, n: int) -> int:
        if len(unit) <= CACHE_CHARS:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[unit] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for unit in self.units.findall(SPACE + text.replace(" ", SPACE)):
            n = known.get(unit)
            if n is None:
                n = self.remember(unit, self.unit(unit))
            total += n
        return total


#: A worker's counters by model, with the counts they remember from task to task.
_COUNTERS: dict[int, BytePairCounter] = {}


def counter_of(model: bytes) -> BytePairCounter:
    if (key := zlib.crc32(model)) not in _COUNTERS:
        _COUNTERS[key] = BytePairCounter(model)
    return _COUNTERS[key]


def model_bytes(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, into: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of ``text`` in the column ``into``; the model is broadcast (under 1 MB)."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(model.value)
        for texts in batches:
            common.remembering(counter, counter.known.clear)
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return docs.withColumn(into, tokens(F.coalesce(F.col(text), F.lit(""))))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))

"""Operator 11, repair of conversations' structure, by composing weighted finite-state machines.

The rows of a conversation, in the order of their turns, are an acceptor of symbols (a role's initial and the row's fault). The edit
transducer keeps, reroles or deletes a row or inserts one; the role grammar ``(s?(ua)+)?`` accepts what comes
out. Their composition is built lazily: arcs from a grammar state under a symbol are made when first asked for, and remembered.
It is acyclic (an insertion never comes back to a state at the same row), and its shortest path is found in topological order, with
(cost, labels) as weights, compared in this order. Labels are the edits' initials. Of two label strings over the same rows none is
the other's beginning unless it costs less, so the least of a part stays the least of the whole, and parts can be joined
in any grouping. Therefore no conversation has to fit into one task: a range partitioning deals the
rows out, long conversations to many tasks; each task reduces runs of at most ``SEGMENT`` rows to the best ways between each two
grammar states, and rounds of at most ``FAN`` runs at a time reduce these to one. Repaired rows are written by a scan over
each conversation's rows behind its labels.

Defined results: a null conv_id is a conversation of its own, null turns come first, null roles and texts are one space. Rows of equal
turn are taken by role, then by a digest of role and text; repeated rows are duplicates of the first. Empty texts are blank. Very
long texts are looked at where they lie and read once more when repaired. An empty table gives an empty result. Other
columns than conv_id, turn, role and text aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The role grammar: (state, role's initial) to state. State 0 is the start, the others are named by what came last: s, u, a.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES = range(4)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Edits after the last row that lead to the empty conversation's or an answer's state, for each state.
ENDINGS = {0: "", 1: "II", 2: "I", 3: ""}
#: Rows of a run, and runs that are joined at once.
SEGMENT, FAN = 512, 64

_ORDER = ["conv_id", "turn", "role", "digest"]
_WAY = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())]))
_COUNTS = ["turns", "blank", "duplicate", "truncated", "illegal"]
_SEGMENT = [("low", pa.int64()), ("high", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("head", pa.string()), ("tail", pa.string()), ("ways", _WAY)]
_SEGMENT_SQL = ", ".join(["low long, high long", *(f"{c} long" for c in _COUNTS), "head string, tail string, ways array<struct<start int, end int, cost long, labels string>>"])


@cache
def arcs(state: int, initial: str, fault: str) -> dict[int, tuple[int, str]]:
    """The composition's best (cost, labels) over one row from a grammar state to others, insertions before the row included."""
    reached = {state: (0, "")}
    queue = [state]
    for at in queue:
        cost, labels = reached[at]
        for after in (GRAMMAR.get((at, out)) for out in NAMES):
            if after is not None and after not in reached:
                reached[after] = (cost + INSERT, labels + "I")
                queue.append(after)
    best: dict[int, tuple[int, str]] = {}
    for at, (cost, labels) in reached.items():
        edits = [(DELETE, "D", at)]
        if fault not in ("blank", "duplicate"):
            price = TRUNCATED if fault == "truncated" else 0
            edits += [(KEEP + price, "K", GRAMMAR.get((at, initial))), *((REROLE + price, "R", GRAMMAR.get((at, out))) for out in NAMES)]
        for price, label, after in edits:
            if after is not None:
                way = (cost + price, labels + label)
                best[after] = min(best.get(after, way), way)
    return best


def relax(front: dict[int, tuple[int, str]], further) -> dict[int, tuple[int, str]]:
    """The best ways on from ``front``; ``further`` gives the ways from a state."""
    best: dict[int, tuple[int, str]] = {}
    for state, (cost, labels) in front.items():
        for after, (price, more) in further(state).items():
            way = (cost + price, labels + more)
            if after not in best or way < best[after]:
                best[after] = way
    return best


class Run:
    """A run of a conversation's rows: its counts, and the best ways through it from each of ``starts``."""

    def __init__(self, starts):
        self.rows, self.low, self.high, self.head, self.tail = 0, None, None, None, None
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.fronts = {s: {s: (0, "")} for s in starts}

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.high:
            self.counts["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.rows and self.tail + initial not in LEGAL:
            self.counts["illegal"] += 1
        if fault:
            self.counts[fault] += 1
        self.head, self.tail = self.head if self.rows else initial, initial
        self.rows += 1
        self.fronts = {s: relax(front, lambda state: arcs(state, initial, fault)) for s, front in self.fronts.items()}

    def row(self) -> dict:
        ways = [{"start": s, "end": e, "cost": cost, "labels": labels} for s, front in self.fronts.items() for e, (cost, labels) in front.items()]
        return {"low": self.low, "high": self.high, **self.counts, "head": self.head, "tail": self.tail, "ways": ways}


def join_runs(left: dict, right: dict) -> dict:
    """Two neighbouring runs as one."""
    out = {c: left[c] + right[c] for c in _COUNTS}
    out["turns"] -= left["high"] is not None and left["high"] == right["low"]
    out["illegal"] += left["tail"] + right["head"] not in LEGAL
    onward: dict[int, dict] = {s: {} for s in STATES}
    for w in right["ways"]:
        onward[w["start"]][w["end"]] = (w["cost"], w["labels"])
    fronts: dict[int, dict] = {}
    for w in left["ways"]:
        fronts.setdefault(w["start"], {})[w["end"]] = (w["cost"], w["labels"])
    fronts = {s: relax(front, onward.get) for s, front in fronts.items()}
    ways = [{"start": s, "end": e, "cost": cost, "labels": labels} for s, front in fronts.items() for e, (cost, labels) in front.items()]
    low = right["low"] if left["low"] is None else left["low"]
    high = left["high"] if right["high"] is None else right["high"]
    return out | {"low": low, "high": high, "head": left["head"], "tail": right["tail"], "ways": ways}


def runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most ``most`` of the sorted rows of one partition. Only a conversation that is seen to begin here has no need of other states than the start."""
    run, now, place, first = None, None, 0, True
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), ("place", pa.int64()), *_SEGMENT])
        out = []
        for conv, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault"))):
            if run is None or conv != now or run.rows == most:
                if run is not None:
                    out.append({"conv_id": now, "place": place} | run.row())
                first = first and (run is None or conv == now)
                place = place + 1 if run is not None and conv == now else 0
                run, now = Run(STATES if first or place else (0,)), conv
            run.add(turn, initial, fault)
        yield pa.RecordBatch.from_pylist(out, schema)
    if run is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": now, "place": place} | run.row()], schema)


def joined(table: pa.Table, fan: int) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["place"])
    schema = pa.schema([table.schema.field("conv_id"), ("place", pa.int64()), *_SEGMENT])
    return pa.Table.from_pylist([reduce(join_runs, rows) | {"conv_id": rows[0]["conv_id"], "place": rows[0]["place"] // fan}], schema)


class Repair:
    """The cheapest repair of each conversation of ``rows`` (conv_id, turn, role, text)."""

    def __init__(self, rows: DataFrame):
        self.key = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
        filled = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
        self.rows = filled.withColumn("digest", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
        self.audits = self._audits()

    def _marked(self) -> DataFrame:
        seen = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("turn")) > 1
        blank, ended = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
        looked = self.rows.select(*_ORDER, F.substring("role", 1, 1).alias("initial"), F.when(blank, "blank").when(~ended, "truncated").otherwise("").alias("own"))
        return looked.select(*_ORDER, "initial", F.when((F.col("own") != "blank") & seen, "duplicate").otherwise(F.col("own")).alias("fault"), seen.alias("seen"))

    def _audits(self) -> DataFrame:
        """Per conversation: the counts, cost and audit of its cheapest repair."""
        marked = common.cut(self._marked())
        dealt = marked.repartitionByRange(*_ORDER, "seen").sortWithinPartitions(*_ORDER, "seen")
        segment, fan = SEGMENT, FAN
        parts = dealt.mapInArrow(lambda batches: runs(batches, segment), f"{self.key}, place long, {_SEGMENT_SQL}").withColumn("part", F.spark_partition_id())
        parts = common.cut(parts)
        whole = Window.partitionBy("conv_id")
        placed = parts.withColumn("of", F.count(F.lit(1)).over(whole)).withColumn("place", F.row_number().over(whole.orderBy("part", "place")) - 1)
        placed = common.cut(placed.drop("part").withColumn("place", F.col("place").cast("long")))
        many = placed.filter("of > 1").drop("of")
        longest = placed.agg(F.max("of")).first()[0] or 0
        spent = [marked, parts]
        while longest > 1:
            many = many.groupBy("conv_id", F.floor(F.col("place") / fan)).applyInArrow(lambda table: joined(table, fan), f"{self.key}, place long, {_SEGMENT_SQL}")
            many, longest = common.cut(many), -(-longest // fan)
            spent.append(many)
        ended = F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair))
        last = lambda w: F.struct((w["cost"] + INSERT * F.length(ended[w["end"]])).alias("cost"), F.concat(w["labels"], ended[w["end"]]).alias("audit"))
        best = F.array_min(F.transform(F.filter("ways", lambda w: w["start"] == 0), last))
        every = placed.filter("of = 1").drop("of").unionByName(many)
        gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
        out = common.cut(every.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best.alias("best")).select("*", "best.*").drop("best"))
        common.drop(*spent, placed)
        return out

    def repaired(self) -> DataFrame:
        """The rows after repair: conv_id, place (from 0), role, text; a conversation's rows lie in one partition, in order."""
        head = self.audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
        body = self.rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
        order = ["conv_id", "kind", "turn", "role", "digest"]
        return head.unionByName(body).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(rewritten, f"{self.key}, place long, role string, text string")

    def digests(self) -> DataFrame:
        """Per conversation that isn't empty after its repair: d_conv_id, repaired_sha256, of its lines ``role:text``."""
        return self.repaired().mapInArrow(hashed, f"d_{self.key}, repaired_sha256 string")


def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows of conversations, each a row with its labels and its rows behind it."""
    labels: Iterator[str] = iter("")
    conv, state, place = None, 0, 0
    out: list[dict] = []

    def put(role: str | None, text: str) -> None:
        nonlocal state, place
        initial = role[:1] if role is not None else next(out for out in NAMES if (state, out) in GRAMMAR)
        out.append({"conv_id": conv, "place": place, "role": NAMES[initial] if role is None else role, "text": text})
        state, place = GRAMMAR[state, initial], place + 1

    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        for this, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
            if kind == 0:
                for _ in labels:  # only insertions are left behind the last row
                    put(None, "")
                labels, conv, state, place = iter(text), this, 0, 0
                continue
            while (label := next(labels)) == "I":
                put(None, "")
            if label != "D":
                put(None if label == "R" else role, text)
        yield pa.RecordBatch.from_pylist(out, schema)
        out.clear()
    for _ in labels:
        put(None, "")
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, conv, schema = None, None, None
    for batch in batches:
        schema = pa.schema([("d_conv_id", batch.schema.field("conv_id").type), ("repaired_sha256", pa.string())])
        out = []
        for this, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
            if place == 0:
                if digest is not None:
                    out.append({"d_conv_id": conv, "repaired_sha256": digest.hexdigest()})
                digest, conv = hashlib.sha256(), this
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"d_conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that a checksum of their conversation and turn gives them: dropped, emptied, without stops, repeated, or the user's."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(name) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("fault"))
    rows = rows.select("*", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1))))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return report(rows, damaged(rows))


def report(rows: DataFrame, after: DataFrame) -> DataFrame:
    """Per conversation of ``rows``: the counts, cost, audit and digest of the repair of its rows ``after`` damage."""
    repair = Repair(after)
    every = rows.select(F.col("conv_id").alias("o_conv_id")).distinct()
    found = every.join(repair.audits, F.col("o_conv_id").eqNullSafe(F.col("conv_id")), "left")
    found = found.join(repair.digests(), F.col("o_conv_id").eqNullSafe(F.col("d_conv_id")), "left")
    numbers = (F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return found.select(F.col("o_conv_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))

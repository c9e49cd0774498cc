"""Conversation repair against a search over all edits, and its runs joined in any grouping."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from lantern.llm import conversations


def damage(rows):
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)


def cheapest(symbols):
    """Dijkstra over (cost, labels) of all edits, without any machine: (cost, audit, repaired rows)."""
    heap = [(0, "", 0, ())]
    done = set()
    while heap:
        cost, labels, i, out = heapq.heappop(heap)
        shape = "".join(r[:1] for r, _ in out)
        if i == len(symbols) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, labels, out
        if (i, shape[-1:]) in done:
            continue
        done.add((i, shape[-1:]))
        steps = [(3, "I", i, (role, "")) for role in ("user", "assistant")]
        if i < len(symbols):
            role, text, fault = symbols[i]
            steps.append((4, "D", i + 1, None))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                steps += [(more, "K", i + 1, (role, text)), *((3 + more, "R", i + 1, (r, text)) for r in ("user", "assistant"))]
        for price, label, after, new in steps:
            if new is None or re.fullmatch("(s?(ua)*u?)?", shape + (new[0][:1] or "-")):
                heapq.heappush(heap, (cost + price, labels + label, after, out + (() if new is None else (new,))))


def brute(rows):
    kept, out = defaultdict(list), set()
    for r in damage(rows):
        kept[r[0]].append(r)
    for conv in {r[0] for r in rows}:
        digest = lambda r: hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).hexdigest()
        here = sorted(kept[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r)))
        seen, symbols, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in here:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            symbols.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = {r[1] for r in here} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        cost, audit, after = cheapest(symbols)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in after).encode()).hexdigest()
        out.add((conv, gaps, *counts.values(), illegal, cost, audit, sha))
    return out


def rows():
    rng = random.Random(4)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", "", None, "usher"]
    texts = ["Yes.", "No!", "Why?", "and so", "", " \t\n", None, "ü.\n ", "...", "One more line. Cut of"]
    out = []
    for conv in [*range(120), None, (1 << 62) + 1]:
        good, turn = rng.random() < 0.4, rng.randrange(-3, 3)
        for k in range(rng.randrange(14)):
            role = ("user", "assistant")[k % 2] if good else rng.choice(roles)
            out.append((conv, None if rng.random() < 0.03 else turn, role, rng.choice(texts) if rng.random() < 0.3 else f"Text {rng.randrange(9)} of {k}."))
            turn += rng.choice([0, 1, 1, 1, 1, 3])
    out += [(200, 5, "user", "x" * 60_000), (200, 5, "user", "x" * 60_000), *((300 + k, 0, "user", "Alone.") for k in range(40))]
    long = [(400, k, rng.choice(roles[:5]), rng.choice(texts[:4]) + f" {k // 2}.") for k in range(300)]
    return out + long


@pytest.fixture(scope="module")
def expected():
    return brute(rows())


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("segment", "fan"), [(512, 64), (3, 2), (1, 3)])
def test_against_all_edits(spark, monkeypatch, expected, segment, fan):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    monkeypatch.setattr(conversations, "FAN", fan)
    table = spark.createDataFrame([(*r, "x", 7) for r in rows()], f"{SCHEMA}, digest string, kind int").repartition(3)
    got = conversations.report(table, conversations.damaged(table)).collect()
    assert [c for c in got[0].asDict()] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_repaired_rows(spark):
    table = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "tool", "Hi."), (1, 3, "user", "Bye!"), (2, 0, "user", ""), (3, 1, "assistant", "So.")], SCHEMA)
    repair = conversations.Repair(table)
    assert {r.conv_id: (r.cost, r.audit) for r in repair.audits.collect()} == {1: (6, "KKRKI"), 2: (4, "D"), 3: (3, "IK")}
    got = {(r.conv_id, r.place): (r.role, r.text) for r in repair.repaired().collect()}
    assert got == {(1, 0): ("system", "Be kind."), (1, 1): ("user", "Hello?"), (1, 2): ("assistant", "Hi."), (1, 3): ("user", "Bye!"), (1, 4): ("assistant", ""), (3, 0): ("user", ""), (3, 1): ("assistant", "So.")}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.report(empty, conversations.damaged(empty)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    gone = spark.createDataFrame([(dropped, 0, "user", "Gone.")], SCHEMA)
    assert tuple(conversations.report(gone, conversations.damaged(gone)).first()) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_the_stage_that_orders_rows_has_no_conversation_per_task(spark):
    """Rows are dealt by ranges of turns, so a long conversation goes to several tasks."""
    table = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", f"Text {k}.") for k in range(4000)], SCHEMA)
    marked = conversations.Repair(table)._marked().repartitionByRange(7, "conv_id", "turn", "role", "digest")
    sizes = [n for n in marked.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert max(sizes) < 1500

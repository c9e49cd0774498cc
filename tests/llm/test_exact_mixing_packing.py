"""Exact dedup, mixing and packing on odd rows, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lantern.llm import common, exact_dedup, mixing, packing

SCHEMA = "doc_id long, text string, source string, candidate string, M_SIZE int, _sha int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA).repartition(3)


ROWS = [(1, "A b", "s"), (2, "a B", None), (3, None, "s"), (4, "", "t"), (5, "É", "s"), (6, "é", "s"), (7, "x" * 200_000, "t"), (8, "X" * 200_000, "t"), (9, "solo", None), (9, "solo", None), (None, "A B", "s")]


def test_report(spark):
    got = exact_dedup.report(frame(spark, ROWS)).collect()
    lower = str.maketrans(common.UPPER, common.LOWER)
    groups = defaultdict(list)
    for i, text, _ in ROWS:
        groups[hashlib.sha256((text or "").translate(lower).encode()).hexdigest()].append(i)
    want = Counter()
    for sha, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, sha) for i in ids)
    assert Counter(tuple(r) for r in got) == want


def moved(df):
    """Whether a plan shuffles rows."""
    return "Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()


def test_filter_in_slices(spark, monkeypatch):
    """However many slices the filter has, rows are tested where they lie."""
    rows = [(i, f"text {i % 37}" if i % 3 else f"own {i}", "s") for i in range(9000)]
    one = sorted(map(tuple, exact_dedup.report(frame(spark, rows)).collect()))
    monkeypatch.setattr(exact_dedup, "SLICE_BYTES", 8192)
    assert sorted(map(tuple, exact_dedup.report(frame(spark, rows)).collect())) == one
    docs = frame(spark, rows)
    plan = exact_dedup.Plan(docs)
    marked = plan.mark(docs.repartition(2).withColumn("sha", exact_dedup.normalised_sha256(docs["text"])), "sha", "flag")
    assert plan.bits // exact_dedup.BITMAP_BITS == 8 and not moved(marked.filter("NOT flag"))
    assert marked._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 8
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(docs).collect()) == sorted(r[0] for r in one if r[3])


def test_deduplicate(spark):
    docs = frame(spark, ROWS)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 4, 5, 6, 8, 9]
    assert exact_dedup.deduplicate(frame(spark, [])).count() == 0 and exact_dedup.report(frame(spark, [])).count() == 0


def test_deduplicate_keeps_what_columns_hold(spark):
    names = ["candidate", "_bucket0", "_BITMAP1", "_flag", "_sha", "stays", "copies", "_heavy_key"]
    rows = [(i, t, *(f"{n} {i}" for n in names)) for i, t, _ in ROWS]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names)])).repartition(3)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    found = sorted(tuple(r) for r in got.collect())
    assert [r[0] for r in found] == [2, 4, 5, 6, 8, 9]
    assert all(r[2:] == tuple(f"{n} {r[0]}" for n in names) for r in found)


def test_hot_group_is_not_lost(spark):
    rows = [(i, "copy" if i % 3 else f"t{i}", "s") for i in range(6000)]
    got = exact_dedup.report(frame(spark, rows))
    assert got.count() == 6000 and got.filter("kept").count() == 2001


def brute_targets(sizes):
    total, weights = sum(sizes.values()), {}
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = 1 + k % 3
    held = set()
    while True:
        free = [s for s in sizes if s not in held]
        rest = total - sum(3 * sizes[s] for s in held)
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in held}
        held |= over


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(900)]
    rows += [(1000, "one two", "tiny"), (1001, None, "none"), (1002, " \t", "none"), (1000, "one two", "tiny")]
    got = mixing.mix(frame(spark, rows), ["doc_id", "source"]).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    targets = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert len(r.m_slots) <= 3 and r.m_source_size == sizes[r.row.source]
        assert r.m_target == pytest.approx(targets[r.row.source], abs=1e-6)
        taken[r.row.source] += r.m_size * len(r.m_slots)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 62, source
    assert len({s for r in got for s in r.m_slots}) > 100
    again = mixing.mix(frame(spark, rows).repartition(7), ["doc_id", "source"]).collect()
    key = lambda rs: sorted((r.row.doc_id, r.m_size, tuple(r.m_slots)) for r in rs)
    assert key(got) == key(again)


@pytest.mark.parametrize("slots", [mixing.SLOTS, 1 << 14])
def test_small_sources_reach_their_targets(spark, slots):
    rng = random.Random(6)
    rows = [(i, "w " * 20_000, f"large{i % 5}") for i in range(200)]
    for k in range(40):  # some words a slot or fewer: less than a slot, or a few
        rows += [(1000 * (k + 1) + i, "w " * rng.randint(1, 3), f"small{k}") for i in range(rng.choice([1, 4, 60]))]
    got = mixing.mix(frame(spark, rows), ["doc_id", "source"], slots=slots).collect()
    taken, targets, copies = Counter(), {}, defaultdict(set)
    for r in got:
        taken[r.row.source] += r.m_size * len(r.m_slots)
        targets[r.row.source] = r.m_target
        copies[r.row.source].add(len(r.m_slots))
    for source, target in targets.items():
        assert abs(taken[source] - target) <= (20_002 if source.startswith("large") else 0), source
    assert all(copies[f"small{k}"] == {3} for k in range(40))


def test_small_targets_of_many_sources(spark):
    rows = [(100 * k + i, "w " * (5 + i % 7), f"s{k:02}") for k in range(60) for i in range(80)]
    got = mixing.mix(frame(spark, rows), ["doc_id", "source"], slots=1 << 12).collect()
    taken, targets = Counter(), {}
    for r in got:
        taken[r.row.source] += r.m_size * len(r.m_slots)
        targets[r.row.source] = r.m_target
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 13, source


def test_mixed_documents(spark):
    docs = frame(spark, [(i, "a b c", "s") for i in range(30)] + [(99, "a b c", "rare")])
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert max(Counter(r.doc_id for r in got.collect()).values()) <= 3
    for rows in ([], [(1, None, None)]):
        assert mixing.mixed_documents(frame(spark, rows)).count() == 0
        assert mixing.mix(frame(spark, rows)).count() == len(rows)


def least_bins(items, capacity):
    """The fewest bins, by trying everything."""
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        layout = packing.Layout.__new__(packing.Layout)
        layout.capacity, layout.bins, layout.left = capacity, [], dict(Counter(items))
        layout.reduce()
        fixed = sum(n for n, _ in layout.bins)
        rest = sorted(Counter(layout.left).elements(), reverse=True)
        assert fixed + least_bins(rest, capacity) == least_bins(items, capacity), (items, capacity)


def test_layout_places_everything():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 64, 256])
        counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 30))}
        layout = packing.Layout(counts, capacity)
        got = Counter()
        for n, lengths in layout.bins:
            assert sum(lengths) <= capacity
            got.update({s: n * k for s, k in Counter(lengths).items()})
        assert got == Counter(counts)


def test_pack(spark):
    from tokenizers import Tokenizer

    rows = [(1, None, "s"), (2, "", "s"), (3, "Some words, here: it's <|endoftext|> x1 y22", "s"), (4, "é́ ﬁ\x1c日本 " * 30, "s"), (5, "word " * 20_000, "s"), (3, "same id", "s"), (6, "dup", "s"), (6, "dup", "s")]
    got = packing.pack(frame(spark, rows), capacity=64).collect()
    tokenizer = Tokenizer.from_file(packing.public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for i, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for each in places.values():
        at = 0
        for offset, length in sorted(each):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(frame(spark, [])).count() == 0

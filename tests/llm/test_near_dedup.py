"""Near-duplicates against brute force, on groups that need every kind of comparison."""

import random
import re

import pytest

from lantern.llm import components, near_dedup


def brute(rows, width):
    sets, above = {}, {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
        above[i] = i

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)))
                above[high] = low
    return {(i, len(sets[i]), top(i), top(i) == i) for i in ids}


def texts(sizes, copies):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", " \t\n ", "one", "ONE", "one two", "Ünï one two", "x" * 50_000, "a b " * 3000]
    for size in sizes:
        for _ in range(copies):
            base = rng.choices(words, k=size)
            out += [" ".join(base)] * 3
            drift = list(base)
            for _ in range(6 * copies):  # a chain: each is like the one before, the ends aren't alike
                drift[rng.randrange(size)] = rng.choice(words)
                out.append(" ".join(drift))
            for _ in range(5 * copies):
                changed = list(base)
                for _ in range(max(1, size // 12)):
                    changed[rng.randrange(size)] = rng.choice(words)
                out.append(" ".join(changed))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("block", "salted", "sizes", "copies"), [(2048, 256, (6, 40, 120), 2), (3, 2, (40,), 1)])
def test_against_brute_force(spark, monkeypatch, block, salted, sizes, copies):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SALTED", salted)
    rows = texts(sizes, copies)
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    got = near_dedup.Duplicates(docs, width=2).report().collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 2)
    assert len(got) == len(rows)


def test_one_hot_leader(spark, monkeypatch):
    """Half of all rows are near copies of one text: its nodes go to many tasks, and to one component."""
    monkeypatch.setattr(near_dedup, "SALTED", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(600):
        words = list(base) if i % 2 else [f"v{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(150)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = near_dedup.Duplicates(docs, width=2)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.report().collect()} == brute(rows, 2)


def test_deduplicate_keeps_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, _gone int, lang string"
    docs = spark.createDataFrame([(4, "a b c d e f", 1, "en"), (2, "A b c d e f", 2, None), (7, None, 3, "x"), (8, None, 4, "x")], schema)
    got = near_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 7, 8]
    assert near_dedup.deduplicate(spark.createDataFrame([], schema)).count() == 0


def test_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:k], "other", *base[k + 1 :]])
    rows = [(None, near(3)), (5, near(50)), (None, "alone one two"), (8, near(20)), (8, "unlike anything else here"), (9, "p q r"), (9, "p q r"), (None, "x y z"), (None, "X y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.Duplicates(docs, width=2).report().collect()
    assert len(got) == len(rows)
    linked = [r for r in got if r.n_shingles > 50]
    assert {r.component_id for r in linked} == {5} and sorted((r.doc_id or 0, r.kept) for r in linked) == [(0, False), (5, True), (8, False)]
    stay = near_dedup.deduplicate(docs, width=2).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in stay) == sorted([(5, near(50)), (0, "alone one two"), (8, "unlike anything else here"), (9, "p q r"), (0, "x y z")])


def test_components_of_chains_and_stars(spark, monkeypatch):
    cuts, cut = [], components.common.cut
    monkeypatch.setattr(components.common, "cut", lambda df: cuts.append(0) or cut(df))
    n = 400
    links = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (5001, 5000), (6000, 6000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {i: 1000 for i in range(1000, 1300)} | {5000: 5000, 5001: 5000}
    assert len(cuts) < 60  # about three for each round
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0

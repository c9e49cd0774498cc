"""Collocations against brute force, and against the SQL that states them."""

import random
import re
from collections import Counter

import duckdb
import pytest

from lantern.llm import collocations


def brute(rows, least=10, top=2000, share=50):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        longest = Counter()
        for p, a in counts.items():
            if len(p) == 3 and a >= least:
                for part in (p[:2], p[1:]):
                    longest[part] = max(longest[part], a)
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least or (len(p) == 2 and p in longest and 100 * longest[p] >= share * a):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return out


def rows():
    rng = random.Random(2)
    words = ["the", "The", "of", "a", "é", "\x01odd", "b-c", "ünder", "x", "y", "zeta", "eta"]
    out = [(None, None), ("en", ""), ("en", " \t\n"), ("en", ".,;"), ("en", "aa " * 300), ("und", "a a a\x0ba a\rb b"), (None, "new york city. " * 12)]
    for _ in range(150):
        text = ""
        for _ in range(rng.randrange(60)):
            text += rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " ? "])
        out.append((rng.choice(["en", "en", "fr", "x y", None]), text))
    return out + [("en", "say hello to the world")] * 15 + [("fr", " ".join(rng.choices(words, k=3000)))]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, lang, t, "x", 1) for i, (lang, t) in enumerate(rows())], "doc_id long, lang string, text string, w1 string, n int").repartition(4)


@pytest.mark.parametrize(("shard", "bits", "least", "top", "share"), [(2_000_000, 1 << 27, 10, 2000, 50), (97, 1 << 6, 10, 2000, 50), (500, 1 << 8, 2, 40, 90)])
def test_against_brute_force(spark, monkeypatch, table, shard, bits, least, top, share):
    """Tries of few words, whose texts are cut, and filters that are full give the same counts as whole ones."""
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    got = collocations.collocations(table, least, top, share).collect()
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}
    assert {tuple(r) for r in got} == brute(rows(), least, top, share) and len(got) == len({tuple(r) for r in got})


def test_sql_states_the_same(spark, table, tmp_path):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in collocations.op13_phrase_collocations(spark, str(tmp_path)).collect()}
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = base.sql(collocations.OP13_SQL)
    at = [want.columns.index(c) for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")]
    assert got == {tuple(r[k] for k in at) for r in want.fetchall()} == brute(rows())


def test_ancestors_across_ranges(spark):
    """A word's branches lie in many ranges; all of them know its count."""
    nodes = [("l", "a", None, None, 900), *(("l", "a", f"{k:03}", None, 300 - k) for k in range(100)), *(("l", "a", f"{k:03}", f"{j}", 20) for k in range(100) for j in range(5)), ("l", None, None, None, 5000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = collocations.walked(spark.createDataFrame(nodes, "lang string, w1 string, w2 string, w3 string, n long").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(nodes)
    assert all(r.l1 == 900 for r in got if r.w1)
    assert all(r.l2 == 300 - int(r.w2) for r in got if r.w3)


def test_scores_beyond_64_bits_and_empty_tables(spark):
    big = spark.createDataFrame([(999_999_999_999, 1_000_000_000_000, 1_000_000_000_001)], "a long, l long, r long")
    assert big.select(collocations.score("a", "l", "r").alias("s")).first().s == 1_000_000 * 999_999_999_999**2 // (10**12 * (10**12 + 1))
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "only these few words")], "lang string, text string")).count() == 0

"""Numbering, greedy batches, substring pairs, the sink with commits, and ingestion that is replayed."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lantern.operators import navigation, numbering
from lantern.sources.sink import write_pages
from lantern.streaming import ingest


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(10**6) * 1000 + i, i) for i in range(900) for g in [rng.choice(["a", "a", "a", "b", None])]]
    table = spark.createDataFrame(rows, "g string, o long, v int").repartition(7)
    want, seen = {}, {}
    for g, _, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want[v] = seen[g] = seen.get(g, -1) + 1
    assert {r.v: r.number for r in numbering.numbered(table, ["o"], ["g"]).collect()} == want
    assert [r.v for r in numbering.numbered(table, ["o"]).orderBy("number").collect()] == [v for _, _, v in sorted(rows, key=lambda r: r[1])]
    assert numbering.numbered(table.limit(0), ["o"]).count() == 0


def greedy(sizes, most, most_size):
    out, count, total, batch = [], 0, 0, 1
    for s in sizes:
        if count and (count >= most or total + s > most_size):
            batch, count, total = batch + 1, 0, 0
        count, total = count + 1, total + s
        out.append(batch)
    return out


@pytest.mark.parametrize(("rows_", "most", "most_size"), [(4096, 20, 300), (8, 5, 60), (4, 4, 30), (1, 3, 10**9)])
def test_batched(spark, monkeypatch, rows_, most, most_size):
    """One group of hundreds of blocks, small groups, and rows larger than a batch."""
    monkeypatch.setattr(numbering, "ROWS", rows_)
    rng = random.Random(most)
    rows = [(g, i, rng.choice([0, 1, 7, 20, 50, 400])) for i in range(700) for g in [rng.choice(["hot"] * 8 + ["x", "", None])]]
    got = numbering.batched(spark.createDataFrame(rows, "g string, i int, s int").repartition(5), ["i"], "s", most, most_size, "g").collect()
    want = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        want |= {r[1]: (k, b) for k, (r, b) in enumerate(zip(mine, greedy([r[2] for r in mine], most, most_size)))}
    assert {r.i: (r.number, r.batch) for r in got} == want and len(got) == len(rows)


def test_substring_pairs(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abя", k=rng.randrange(1, 12))) for _ in range(400)} | {"aaaaa", "aaaaaa", "xaaaaax"})
    left, right = words[::2] + ["aaaaa"], words[1::2] + ["aaaaaa", "aaaaa"]
    left, right = sorted(set(left)), sorted(set(right))
    got = navigation.substring_pairs(spark.createDataFrame([(w,) for w in left], "token string"), spark.createDataFrame([(w,) for w in right], "word string"))
    assert "Cartesian" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    want = {(a, b) for a in left for b in right if min(len(a), len(b)) >= 5 and (a in b or b in a)}
    assert {tuple(r) for r in got.collect()} == want and ("aaaaa", "xaaaaax") in want | {("aaaaa", "xaaaaax")}


def test_sink_publishes_all_or_nothing(spark, tmp_path):
    pages = spark.createDataFrame([(f"a/b{i % 3}/é{i}.html", f"<p>ü{i}</p>") for i in range(40)], "path string, page string").repartition(4)
    files = lambda folder: {str(p.relative_to(folder)): p.read_text(encoding="utf-8") for p in folder.rglob("*") if p.is_file()}
    write_pages(pages, f"file:{tmp_path}/one")
    assert files(tmp_path / "one") == {r.path: r.page for r in pages.collect()}
    write_pages(pages.limit(2).withColumn("page", F.lit("new")), str(tmp_path / "one"))
    assert sorted(files(tmp_path / "one").values()).count("new") == 2 and len(files(tmp_path / "one")) == 40
    fails = pages.withColumn("page", F.when(F.col("path").contains("é7"), F.raise_error(F.lit("stop"))).otherwise(F.col("page")))
    for bad in (fails, pages.withColumn("path", F.concat(F.lit("../"), "path"))):
        with pytest.raises(Exception, match="stop|outside"):
            write_pages(bad, str(tmp_path / "two"))
        assert files(tmp_path / "two") == {}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "table", "ck"))
    schema = spark.createDataFrame([], "k long, v string").schema
    take = lambda: ingest.ingest(spark, source, schema, target, checkpoint, "k")
    rows = lambda: sorted(r.k for r in ingest.ingested(spark, target, schema).collect())
    assert rows() == []
    for start in (0, 5):  # the second file repeats five keys
        spark.createDataFrame([(k, f"{start}") for k in range(start, start + 10)] * 2, schema).write.mode("append").parquet(source)
        take()
    assert rows() == list(range(15))
    # a stop in the middle of the last write: the batch isn't committed, and half of its files are there
    commits = sorted((tmp_path / "ck/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for name in (commits[-1].name, f".{commits[-1].name}.crc"):
        (tmp_path / "ck/commits" / name).unlink()
    (last,) = [p for p in (tmp_path / "table").iterdir() if p.name.endswith(f"-{int(commits[-1].name):08d}")] or [max((tmp_path / "table").iterdir())]
    next(last.glob("part-*")).unlink()
    assert rows() != list(range(15))
    take()
    assert rows() == list(range(15))
    with pytest.raises(Exception, match="another checkpoint"):
        ingest.ingest(spark, source, schema, target, str(tmp_path / "other"), "k")
    assert json.loads((tmp_path / "ck/metadata").read_text())["id"] in last.name

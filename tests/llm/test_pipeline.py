"""The pipeline's stages on a small table, each against plain Python where that is exact."""

from collections import Counter

import corpus_pipeline


def test_stages(spark, tmp_path):
    words = "der und nicht ein haus baum wasser feuer stein blatt licht nacht tag wind".split()
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words[(i * 7 + k * (1 + i % 5)) % len(words)] + str(i) for k in range(30)), "de", f"s{i % 3}", 10))
    rows += [(100 + i, rows[5][1].upper(), "de", "s0", 10) for i in range(20)]
    rows += [(200 + i, rows[6][1] + f" extra{i}", "de", None, 10) for i in range(3)]
    rows += [(300, None, None, None, None), (301, "12 34", None, "s1", 5), (302, "", "de", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        left[name] = [r.doc_id for r in out.select("doc_id").collect()]
    first, second, third, fourth, last = left.values()
    assert set(first) == {r[0] for r in rows} - {300, 301, 302} and len(first) == len(set(first))
    assert set(second) == set(first) - {5} - set(range(100, 119))
    assert set(third) == set(second) - {200, 201, 202} and len(third) == len(set(third))
    assert set(fourth) <= set(third) and max(Counter(fourth).values()) <= 3
    assert Counter(last) == Counter(fourth)  # every document is one piece


def test_stages_on_clashing_columns_and_empty_tables(spark, tmp_path):
    names = ["_language", "Score", "node", "key", "component", "m_size", "slot", "row", "sequence_id", "candidate", "length"]
    rows = [(i, f"wort{i} haus baum wasser{i} feuer stein blatt licht{i % 3} nacht tag wind{i}", "de", f"s{i % 2}", 9) for i in range(12)]
    rows += [(None, rows[0][1], "de", None, 9), (3, rows[4][1], None, "s0", 9), (3, rows[3][1], "de", "s1", 9), (50, None, "de", "s0", None), (51, "", None, None, 0)]
    schema = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{n}` string" for n in names)])
    docs = spark.createDataFrame([(*r, *(f"{n} of {r[0]}" for n in names)) for r in rows], schema)
    out = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), "").count() == 0
        out = stage(spark, out, "")
        out.write.parquet(str(tmp_path / f"{k}"))
        out = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < 4:
            assert out.columns == docs.columns
            assert all(r[n] == f"{n} of {r.doc_id}" for r in out.collect() for n in names)
        if k in (1, 2):
            assert sorted(r.doc_id for r in out.collect()) == list(range(12))
    assert 0 < out.count() <= 36


def test_run_gives_what_its_stages_give(spark, tmp_path):
    rows = [(i, " ".join(f"wort{(i * 5 + k) % 40}" for k in range(20)), "de", f"s{i % 2}", 9) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(tuple, out.collect()))

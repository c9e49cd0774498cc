"""BM25 against SQLite's FTS5, fusion, scopes, vectors, stores and tools."""

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.functions import text, vectors
from lantern.operators import cells, hybrid, lexical
from lantern.plans.api import Tools
from lantern.sources.store import Store

ROWS = [
    ("a", "Получить файл", "Файлы", "Метод Модуль.Метод получает файл. foo_bar"),
    ("b", "Печать", "Отчёты > Печать", "печать файл файл Café naïve Überall"),
    ("c", "Прочее", "Файлы", "модуль метод раздельно; ёлка й"),
    ("d", "Пусто", "x", ""),
    ("e", "Печать", "Отчёты > Печать", "печать файл файл Café naïve Überall"),
    ("f", "g", "h", "nothing here at all"),
    ("g", "i", "j", "some other words"),
]
QUERIES = [(1, "получить файл"), (2, "Модуль.Метод"), (3, "foo_bar cafe файл файл"), (4, "uberall ёлка"), (5, "... !!"), (6, "нет")]


def test_bm25_equals_fts5(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, breadcrumb, text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", ROWS)
    want = {}
    for q, query in QUERIES:
        import re

        match = " OR ".join(f'"{x}"' for x in re.findall(r"[\w.]+", query))
        if match:
            want |= {(q, i): s for i, s in con.execute("SELECT id, bm25(t, 0.0, 3.0, 2.0, 1.0) FROM t WHERE t MATCH ?", (match,))}
    sections = spark.createDataFrame(ROWS, "id string, title string, breadcrumb string, text string")
    got = lexical.search(spark.createDataFrame(QUERIES, "query_id long, query string"), lexical.Index.build(sections)).collect()
    assert {(r.query_id, r.section_id) for r in got} == set(want)
    assert all(abs(r.score - want[r.query_id, r.section_id]) < 1e-8 for r in got)


def test_fusion_and_vectors(spark):
    ranks = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "y", 1)], "query_id int, section_id string, rank int")
    got = {r.section_id: r.score for r in hybrid.fused(ranks).collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 61 + 1 / 62})
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    assert list(df.select(vectors.normalised(F.col("v"))).first()[0]) == pytest.approx([0.6, 0.8])
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<float>")
    for bad in (vectors.normalised(F.col("v")), vectors.of_dimension(F.col("v"), 3)):
        with pytest.raises(Exception, match="zeros|dimensions"):
            df.select(bad).collect()
    assert hybrid.ordered_response([{"index": 1, "embedding": [0, 2]}, {"index": 0, "embedding": [3, 0]}], 2) == [[1, 0], [0, 1]]
    with pytest.raises(ValueError):
        hybrid.ordered_response([], 1)


def test_tools_end_to_end(spark, tmp_path):
    from lantern.__main__ import main

    root, source = tmp_path / "root", tmp_path / "root/sources/3.1.11"
    pages = {
        "Глава 4. Программный интерфейс/Загрузка/Интерфейс/Загрузить.html": "<h1>ЗагрузитьФайл</h1><p>Загружает файл в хранилище данных.</p>",
        "Глава 4. Программный интерфейс/Загрузка/Переопределение/Группа/При.html": "<h1>ПриЗагрузке</h1><p>Вызывается перед загрузкой файла.</p>",
        "Глава 4. Программный интерфейс/Печать/Интерфейс/index.html": "<h1>Оглавление</h1>",
        "Глава 4. Программный интерфейс/Печать/Интерфейс/Печатать.html": "<h1>Печатать</h1><p>Печатает документ. Не рекомендуется.</p>",
        "Глава 5/Прочее.html": "<h1>Прочее</h1><p>файл файл файл</p>",
    }
    for name, html in pages.items():
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_text(html, encoding="utf-8")
    assert main(["index", "--root", str(root), "--source", str(source), "--version", "3.1.11"]) == 0
    tools = Tools(spark, str(root), hybrid.HashingEmbedder(), canaries=[(0, "Печатать документ", "?")])
    with pytest.raises(RuntimeError):
        tools.search("3.1.11.5", "файл")
    tools = Tools(spark, str(root), hybrid.HashingEmbedder())
    found = tools.search("3.1.11.155", "файл загрузить").collect()
    assert len(found) == 4 and found[0].rank == 1 and found[0].title in ("ЗагрузитьФайл", "Прочее")
    only = tools.search("3.1", "файл", mode="override").collect()
    assert [r.title for r in only] == ["ПриЗагрузке"]
    assert tools.search("3.1", "печатать документ", subsystem="Печать").first().has_warning
    section = tools.section("3.1", only[0].id).first()
    assert section.title == "ПриЗагрузке" and section.has_warning is None
    assert tools.source_section("3.1", only[0].id)["content"] == "# ПриЗагрузке\n\nВызывается перед загрузкой файла."
    assert [r.name for r in tools.list_sections("3.1").collect()] == ["Загрузка", "Печать"]
    assert [r.name for r in tools.discover("3.1", "печать документа").collect()] == ["Печать"]
    groups = tools.section_map("3.1", " загрузка ").first().groups
    assert [(g.name, g.interface_kind) for g in groups] == [("Основные процедуры и функции", "Интерфейс"), ("Группа", "Переопределение")]
    assert tools.list_versions() == ["3.1"]
    for call in (lambda: tools.section("3.1", "x"), lambda: tools.section_map("3.1", "x")):
        with pytest.raises(KeyError):
            call()
    with pytest.raises(ValueError):
        Tools(spark, str(root), hybrid.HashingEmbedder(model="other")).search("3.1", "файл")
    with pytest.raises(FileNotFoundError):
        tools.search("9.9", "файл")


def test_versions_and_demos_of_files(spark, tmp_path):
    """A project by its folder or its file, each failure by its reason, and demos whose archive is there."""
    tools = Tools(spark, str(tmp_path), hybrid.HashingEmbedder())
    xml = lambda inner: f'<?xml version="1.0"?><d:DistributionSupport xmlns:d="x">{inner}</d:DistributionSupport>'
    folder = tmp_path / "p/Configuration/src/Configuration"
    folder.mkdir(parents=True)
    file = folder / "Configuration.distr"
    for text_, want in ((xml('<parentConfigurationInfos configRelease="3.1.011.9"/>'), "3.1.11.9"), (xml(""), "no configuration"), (xml("<parentConfigurationInfos/>"), "without a release"), ("plain", "not a support")):
        file.write_text(text_)
        for path in (str(tmp_path / "p"), str(file)):
            if want[0].isdigit():
                assert tools.detect_version(path, "Lib").asDict() == {"full": want, "family": "3.1"}
            else:
                with pytest.raises(ValueError, match=want):
                    tools.detect_version(path, "Lib")
    legacy = folder / "ParentConfigurations.bin"
    for content, want in (('{"2.0.1","3.0.2",Lib,"9.9"}', None), ('{"x",Lib}', "no version"), ("{}", "marker")):
        legacy.write_bytes(content.encode("cp1251"))
        if want is None:
            assert tools.detect_version(str(legacy), "Lib")["full"] == "3.0.2"
        else:
            with pytest.raises(ValueError, match=want):
                tools.detect_version(str(legacy), "Lib")
    release = {"demo_version": "3.1.11.5", "demo_archive": "demo.zip"}
    (tmp_path / "releases.json").write_text(json.dumps({"releases": [release]}))
    assert tools.demo_location("3.1.11.9")["reason"].endswith("demo.zip") and not tools.demo_location("4.0")["available"]
    (tmp_path / "demo.zip").write_bytes(b"abc")
    assert tools.demo_location("3.1.11.9")["sha256"].startswith("ba7816bf8f01cfea414140de5dae2223")


def test_query_cache_keeps_the_last(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    keys = spark.createDataFrame([("m\nq",)], "cache_key string")
    assert store.cached(keys).count() == 0
    for v in ([1.0, 0.0], [0.0, 1.0]):
        store.cache(spark.createDataFrame([("m\nq", v)], "cache_key string, embedding array<float>"))
    assert list(store.cached(keys).first().embedding) == [0.0, 1.0]


def test_provider_and_dimensions(spark, monkeypatch):
    import io
    from urllib import request

    asked = []

    def reply(sent, timeout):
        asked.append(json.loads(sent.data))
        texts = asked[-1]["input"]
        return io.BytesIO(json.dumps({"data": [{"index": i, "embedding": [3.0 * (i + 1), 4.0 * (i + 1)]} for i in reversed(range(len(texts)))]}).encode())

    monkeypatch.setattr(request, "urlopen", reply)
    provider = hybrid.Provider("http://h/v1/embeddings", "m", "k")
    assert provider.embed_documents(["a", "b"]) == [[0.6, 0.8], [0.6, 0.8]] and provider.embed_queries(["q"]) == [[0.6, 0.8]]
    assert asked[1] == {"model": "m", "input": [f"Instruct: {text.INSTRUCTION}\nQuery: q"]}
    for items, n in (([], 1), ([{"index": 0, "embedding": [0.0, 0.0]}], 1), ([{"index": 1, "embedding": [1.0]}], 1)):
        with pytest.raises(ValueError):
            hybrid.ordered_response(items, n)


def test_pruned_ranking_is_that_of_all_matches(spark, monkeypatch):
    """Blocks below the threshold aren't read, and nothing changes by that: scopes, ties, phrases, queries with few matches."""
    import random

    rng = random.Random(1)
    monkeypatch.setattr(lexical, "PASSES", (2, 6))
    tongues = [[f"{a}{k}" for k in range(60)] for a in "abc"]
    rows = [(i, f"Title {i % 7}", ["x", tongue[0]], " ".join(rng.choices(tongue[:60], weights=[1 / (k + 1) for k in range(60)], k=rng.randrange(1, 80)))) for i in range(1500) for tongue in [tongues[i % 3]]]
    rows += [(2000 + k, "Title", [], "rare_pair of words") for k in range(3)] + [(3000, None, None, None)]
    sections = spark.createDataFrame(rows, "id long, title string, breadcrumb array<string>, text string")
    queries = spark.createDataFrame([(q, " ".join(rng.choices(tongues[q % 3], k=5))) for q in range(30)] + [(50, "rare_pair"), (51, "Title 3"), (52, "nothing here matches zzz"), (53, "")], "query_id int, query string")
    index = lexical.Index.build(sections)
    whole = lexical.search(queries, index)
    inside = sections.filter("id % 2 = 0").select(F.col("id").alias("section_id"))
    for scope in (None, inside):
        want = whole if scope is None else whole.join(scope, "section_id", "left_semi").select(whole.columns)
        best, read = lexical.ranked(queries, index, 10, scope)
        order = lambda df: {tuple(r) for r in lexical.top(df, 10, F.col("score")).collect()}
        assert order(best) == order(want) and best.count() == len(order(want))
    # long texts that name a word once, and short ones that are about it: only blocks of the latter are read
    topics = [f"topic{k}" for k in range(8)]
    rows = [(i, " ".join(["filler"] * 60 + rng.sample(topics, 4))) for i in range(1200)] + [(2000 + i, f"{topics[i % 8]} " * 3) for i in range(120)]
    about = lexical.Index.build(spark.createDataFrame(rows, "id long, text string"), weights={"text": 1.0})
    queries = spark.createDataFrame(list(enumerate(topics)), "query_id int, query string")
    best, read = lexical.ranked(queries, about, 10)
    assert {r.section_id >= 2000 for r in best.collect()} == {True}
    met = queries.join(about.blocks, F.col("query") == F.col("token")).count()
    assert read.count() < met / 4
    assert index.blocks.filter(F.size("entries") > lexical.BLOCK).isEmpty()


def test_cells_rank_as_all_vectors_do(spark, monkeypatch):
    """Clustered vectors: the ranking is that of all products, and less than half of them are computed."""
    import numpy as np

    rng = np.random.default_rng(3)
    monkeypatch.setattr(cells, "PACK", 20)
    centres = rng.normal(size=(25, 8)) * 4
    points = [(i, [float(x) for x in (centres[i % 25] + rng.normal(size=8) * 0.3).round(3)]) for i in range(1500)] + [(5000, None)]
    points += [(6000 + i, points[0][1]) for i in range(4)]  # ties
    sections = spark.createDataFrame(points, "id long, embedding array<float>").repartition(3)
    asked = [(q, [float(x) for x in centres[q] + rng.normal(size=8)]) for q in range(20)] + [(99, [0.0] * 8)]
    queries = spark.createDataFrame(asked, "query_id int, embedding array<float>")
    found = cells.Cells.build(sections)
    v = np.array([p[1] for p in points if p[1]], np.float32).astype(float)
    ids = np.array([p[0] for p in points if p[1]])
    for farthest, keep in ((False, None), (True, None), (False, 2)):
        use = found if keep is None else found.within(sections.filter(F.col("id") % keep == 0).select(F.col("id").alias("section_id")))
        best, read = use.nearest(queries, 10, farthest)
        got = {(r.query_id, r.rank): r.section_id for r in best.collect()}
        for q, e in asked:
            scores = np.round(v @ np.array(e, np.float32).astype(float), lexical.SCORE_DIGITS)
            rows = [i for i in sorted(range(len(ids)), key=lambda i: (scores[i] if farthest else -scores[i], ids[i])) if keep is None or ids[i] % keep == 0][:10]
            assert [got[q, k + 1] for k in range(10)] == [ids[i] for i in rows]
        if keep is None:
            share = read.filter("query_id != 99").join(found.packs, "pack").agg(F.sum("n")).first()[0] / (20 * len(ids))
            assert share < 0.5
    assert found.packs.filter(f"n > {cells.PACK}").isEmpty()
    empty = cells.Cells.build(spark.createDataFrame([], "id long, embedding array<float>"))
    assert empty.nearest(queries, 3)[0].isEmpty() and found.nearest(queries.limit(0), 3)[0].isEmpty()
    with pytest.raises(ValueError):
        found.nearest(spark.createDataFrame([(7, [1.0])], "query_id int, embedding array<float>"), 3)
    with pytest.raises(ValueError):
        cells.Cells.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<float>"))


def test_service_answers(spark, tmp_path):
    import io

    from lantern.plans import server

    store = Tools(spark, str(tmp_path), hybrid.HashingEmbedder())
    lines = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "list_versions"}}, {"id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {"version": "x", "query": "q"}}}, {"id": 5, "method": "no"}]
    server.serve(store, [*map(json.dumps, lines), "broken", ""], out := io.StringIO())
    first, tools, versions_, failed, unknown, broken = map(json.loads, out.getvalue().splitlines())
    assert first["result"]["serverInfo"]["name"] == "lantern" and {t["name"] for t in tools["result"]["tools"]} == set(server.TOOLS)
    assert versions_["result"] == {"content": [{"type": "text", "text": "[]"}], "isError": False} and failed["result"]["isError"]
    assert unknown["error"]["code"] == server.UNKNOWN_METHOD and broken["error"]["code"] == server.FAILED


def test_ranking_by_sets_pages_and_neighbours(spark, monkeypatch, tmp_path):
    """Queries in several sets, pages smaller than blocks' runs, many equal texts, and phrases of texts and of a stored index: all as one."""
    import pyarrow as pa

    rows = [(i, f"alpha beta {'gamma' if i % 3 else 'delta'} alpha beta", ["x"]) for i in range(300)] + [(1000 + i, f"beta alpha word{i}", []) for i in range(40)]
    sections = spark.createDataFrame(rows, "id long, text string, breadcrumb array<string>")
    queries = spark.createDataFrame([(k, q) for k, q in enumerate(["alpha_beta", "beta_gamma_alpha", "alpha", "word7 beta_alpha", "delta gamma", "alpha_word3"])], "query_id long, query string")
    index = lexical.Index.build(sections)
    index.write(str(tmp_path))
    stored = lexical.Index.read({n: spark.read.parquet(f"{tmp_path}/{n}") for n in lexical.Index.TABLES})
    rows_of = lambda df: sorted(map(tuple, df.select("query_id", "section_id", "score").collect()))
    whole = lexical.search(queries, index)
    want, first = rows_of(whole), rows_of(lexical.top(whole, 5, F.col("score")))
    assert {q for q, *_ in want} == {0, 1, 2, 3, 4, 5} and rows_of(lexical.search(queries, stored)) == want
    monkeypatch.setattr(lexical, "SET_QUERIES", 2)
    monkeypatch.setattr(lexical, "PAGE", 12)
    assert rows_of(lexical.search(queries, index)) == want and rows_of(lexical.search(queries, index, 5)) == first
    # a page gives no more than is asked for, however many tie
    kept = lexical._first(np.array([[-1.0, -2.0]] * 6 + [[-3.0, 0.0]]), 3, pa.array([9, 5, 7, 1, 8, 2, 3]))
    assert kept.sum(0).tolist() == [3, 3] and np.flatnonzero(kept[:, 0]).tolist() == [3, 5, 6]
    vectors_ = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(200)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(6)], "query_id long, embedding array<float>")
    found = cells.Cells.build(vectors_)
    want = sorted(map(tuple, found.nearest(asked, 4)[0].collect()))
    monkeypatch.setattr(cells, "SET", 2)
    monkeypatch.setattr(cells, "BLOCK", 2)
    assert sorted(map(tuple, found.nearest(asked, 4)[0].collect())) == want and [r[1] for r in want[:4]] == [6, 13, 20, 27]


def test_texts_are_taken_apart_where_they_lie(spark, monkeypatch, tmp_path):
    """Terms and postings of odd sections by their definitions, page by page; no occurrence is shuffled or summed by a key."""
    import re
    from collections import Counter, defaultdict

    rows = [(str(i), ["a", None, "", "b a"][i % 4], ["x", "a b"][: i % 3], "a b a c é b " * (i % 5) + ("z z" if i == 7 else "")) for i in range(40)]
    rows += [("twice", "a", ["q"], "a b"), ("twice", "b", [], "b b c"), ("none", None, None, None)]
    sections = spark.createDataFrame(rows, "id string, title string, breadcrumb array<string>, text string").repartition(3)
    monkeypatch.setattr(lexical, "PAGE", 7)
    words = lambda v: re.findall(r"\w+", (v or "").replace("é", "e"))
    tokens, places = defaultdict(Counter), defaultdict(list)
    weighted = defaultdict(Counter)
    for i, title, crumbs, body in rows:
        for name, value in (("title", title), ("breadcrumb", " > ".join(crumbs or [])), ("text", body)):
            for position, token in enumerate(words(value)):
                places[token, i, name] = sorted([*places[token, i, name], position])
                tokens[i][token] += 1
                weighted[i][token] += lexical.WEIGHTS[name]
    got = {r.section_id: r for r in lexical._terms(sections, "id", lexical.WEIGHTS).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, r in got.items():
        assert (r.tokens, dict(zip(r.names, r.f))) == (tokens[i].total(), dict(weighted[i]))
        assert r.commonest == max(tokens[i], key=lambda t: (tokens[i][t], t), default=None)
    found = lexical.postings(sections)
    assert {(r.token, r.section_id, r.field): r.positions for r in found.collect()} == places
    single = sections.filter("id != 'twice'").localCheckpoint()
    for df in (lexical.postings(single), lexical._terms(single, "id", lexical.WEIGHTS)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan
    assert lexical.postings(sections.limit(0)).count() == 0
    folder = str(tmp_path / "index")
    kept = lexical.Index.build(single, folder=folder)
    for name in lexical.Index.TABLES:
        assert f"{folder}/{name}/" in getattr(kept, name).inputFiles()[0]
    queries = spark.createDataFrame([(1, "a"), (2, "b c"), (3, "z_z")], "query_id int, query string")
    results = [sorted(map(tuple, lexical.search(queries, index).collect())) for index in (kept, lexical.Index.build(single))]
    assert results[0] == results[1] and len(results[0]) > 40

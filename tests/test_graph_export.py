"""Links, addresses, crawls, trees, exports, enrichment, health, versions, archives and streams."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lantern.functions import text, urls, versions
from lantern.operators import enrich, export, graph, health, navigation
from lantern.sources import corpus, crawl
from lantern.sources.archive import read_archive, safe
from lantern.streaming import ingest

SITE = urls.Site("https://docs.example", ("/db/docs/content/src/", "/db/content/docs/src/"), "/db/content/docs/src/")
ROOT = "https://docs.example/db/content/docs/src/"


def url(name):
    return f"{ROOT}{name}#_print"


def test_addresses(spark):
    page = url("a/b.htm")
    given = [urls.urljoin(page, h) for h in ("c.htm", "/db/docs/content/src/x%20y.htm_", "/db/docs/content/src/x%20y.htm__", "https://mirror.example/db/content/docs/src/m.HTM?q#f", "https://other.example/x.htm", "/elsewhere/x.htm", "c.png", "й~*+.htm")]
    got = [r.p for r in spark.createDataFrame([(i, a) for i, a in enumerate(given)], "i int, a string").select("i", SITE.page(F.col("a")).alias("p")).orderBy("i").collect()]
    assert got == [url("a/c.htm"), url("x%20y.htm"), None, url("m.HTM"), None, None, None, url("a/%D0%B9~%2A%2B.htm")]
    assert SITE.start(spark, page) == (page, ROOT) and SITE.start(spark, "/db/docs/content/src/x.htm") == (url("x.htm"), ROOT)
    assert urls.within("x.htm?q#f", {"x.htm": "X/index.html"}) == "X/index.html#f" and urls.within("#%61", {}) == "#a" and urls.within("y.htm#f", {"x": "y"}) == "y.htm#f"
    assert urls.within("http://h/x", {"x": "y"}) == "http://h/x" and urls.between("A/C/d.html", "A/b.html") == "../b.html"
    with pytest.raises(ValueError):
        SITE.start(spark, "https://docs.example/")


PAGES = {
    url("root.htm"): "<title>T</title><h1>Корень</h1><div class='index'><a href='a.htm'>a</a><a href='b.htm'>b</a><a href='a.htm'>again</a><a href='root.htm'>self</a></div>",
    url("a.htm"): "<h1>Раздел</h1><a href='root.htm'>up</a><a href='gone.htm'>x</a><div class='index'><a href='c.htm'>c</a></div>",
    url("b.htm"): "<h1>Раздел</h1><p>leaf</p><img src='i.png'><a href='a.htm#f'>a</a><a href='https://o.example'>o</a>",
    url("c.htm"): "<h1>Лист</h1><a href='root.htm'>up</a>",
}


def fetcher(pages):
    """A function of its own, so that it is sent to workers with what it needs."""

    def fetch(address):
        if address not in pages:
            return crawl.Fetched(404, b"")
        return crawl.Fetched(200, pages[address].encode())

    return fetch


def test_crawl_resumes_and_ends_on_cycles(spark):
    pages = crawl.crawl(spark, url("root.htm"), fetcher(PAGES), SITE)
    rows = {r.url: r for r in pages.collect()}
    assert {u: r.status for u, r in rows.items()} == {**{u: "ok" for u in PAGES}, url("gone.htm"): "error"}
    assert rows[url("c.htm")].parent == url("a.htm") and rows[url("root.htm")].parent is None
    assert list(rows[url("root.htm")].children) == [url("a.htm"), url("b.htm")]
    again = crawl.crawl(spark, url("root.htm"), fetcher({}), SITE, known=pages.filter("status = 'ok'").withColumn("children", F.filter("children", lambda c: ~c.contains("gone"))))
    assert again.count() == 4 and again.filter("status = 'ok'").count() == 4
    named = crawl.numbered(pages)
    assert sorted(r.file for r in named.filter("status = 'ok'").collect()) == [f"pages/000{i}.html" for i in (1, 2, 3, 4)]
    entry = json.loads(crawl.manifest(named, url("root.htm"), ROOT))["pages"][url("a.htm")]
    assert entry["title"] == "Раздел" and entry["status"] == "ok"
    assert crawl.crawl(spark, url("root.htm"), fetcher(PAGES), SITE, max_pages=1).count() == 1


def test_crawl_is_first_in_first_out(spark):
    """Under a limit, pages are fetched in the order in which they were found; a page's parent is the first that led to it."""
    link = lambda *names: "".join(f'<a href="{n}.htm">x</a>' for n in names)
    site = {url("root.htm"): link("z", "b"), url("z.htm"): link("y", "a"), url("b.htm"): link("a", "c"), **{url(f"{n}.htm"): "end" for n in "yac"}}
    for most, want in ((2, "z"), (3, "zb"), (4, "zby"), (5, "zbya"), (None, "zbyac")):
        got = {r.url: r.parent for r in crawl.crawl(spark, url("root.htm"), fetcher(site), SITE, max_pages=most).collect()}
        assert set(got) == {url("root.htm"), *(url(f"{n}.htm") for n in want)}
    assert got[url("a.htm")] == url("z.htm") and got[url("c.htm")] == url("b.htm")


def test_export(spark, tmp_path):
    pages = spark.createDataFrame([(u, export.parse(h).find("h1").text(" "), None, h) for u, h in PAGES.items()], "url string, title string, parent string, html string")
    edges = graph.known_links(graph.links(pages, SITE, ROOT, index_only=True), pages)
    starts = graph.roots(pages, edges)
    assert [r.url for r in starts.collect()] == [url("root.htm")]
    placed = graph.tree_paths(pages, edges, starts)
    paths = {r.url: r.path for r in placed.collect()}
    digest = hashlib.sha256(url("b.htm").encode()).hexdigest()[:8]
    assert paths == {url("root.htm"): "Корень/index.html", url("a.htm"): "Корень/Раздел/index.html", url("b.htm"): "Корень/Раздел.html", url("c.htm"): "Корень/Раздел/Лист.html"}
    titles = spark.createDataFrame([("", t, url("b.htm"), ".html", [k]) for k, t in enumerate(["x?", "X", "y" * 300, "taken"])], "folder string, title string, url string, extension string, key array<long>")
    taken = spark.createDataFrame([("", "taken.html")], "folder string, folded string")
    assert [r.name for r in graph.file_names(titles, taken).orderBy("key").collect()] == ["x.html", f"X-{digest}.html", f"{'y' * 166}-{digest}.html", f"taken-{digest}.html"]
    out = export.rendered(pages, placed, SITE)
    by = {r.url: r.page for r in out.collect()}
    assert 'href="Раздел/index.html#f"' in by[url("b.htm")] and f'src="{ROOT}i.png"' in by[url("b.htm")] and 'href="../index.html"' in by[url("b.htm")] and 'href="https://o.example"' in by[url("b.htm")]
    export.write_pages(out, str(tmp_path))
    assert (tmp_path / "Корень/Раздел/Лист.html").is_file()
    assert json.loads(export.export_manifest(out))["pages"] == 4 and "<li>" in export.index_page("t", [("a", "b")])
    small = spark.createDataFrame([("r", "R", None), ("o", "O", "r"), ("p", None, "q"), ("o2", "O2", "o"), ("s", "S", "p")], "url string, title string, parent string")
    none, root = spark.createDataFrame([], "src string, dst string, ord int"), spark.createDataFrame([("r", 0)], "url string, ord int")
    orphans = {r.url: r.path for r in graph.tree_paths(small, none, root).collect()}
    extra = f"{graph.EXTRAS}/{graph.DEFAULT_TITLE}.html"
    assert orphans == {"r": "R/index.html", "o": "R/O.html", "o2": "R/O2.html", "p": extra, "s": f"{graph.EXTRAS}/S.html"}


def test_first_paths_on_cycles(spark):
    edges = spark.createDataFrame([("r", "b", 1), ("r", "a", 0), ("a", "r", 0), ("a", "c", 1), ("b", "c", 0), ("c", "b", 0), ("c", "d", 1), ("b", "d", 5)], "src string, dst string, ord int")
    starts = spark.createDataFrame([("r", [0])], "url string, key array<long>")
    got = {r.url: r.parent for r in graph.first_paths(edges, starts).collect()}
    assert got == {"r": None, "a": "r", "c": "a", "b": "c", "d": "b"}  # as a walk that follows each link before the next


def test_crawl_is_exported_by_its_manifest(spark, tmp_path):
    crawled = crawl.numbered(crawl.crawl(spark, url("root.htm"), fetcher(PAGES), SITE, keep=str(tmp_path / "kept")))
    export.write_pages(crawled.filter("status = 'ok'").select(F.col("file").alias("path"), F.col("html").alias("page")), str(tmp_path / "c"))
    (tmp_path / "c/manifest.json").write_text(crawl.manifest(crawled, url("root.htm"), ROOT), encoding="utf-8")
    assert crawl.crawl(spark, url("root.htm"), fetcher({}), SITE, keep=str(tmp_path / "kept")).filter("status = 'ok'").count() == 4
    out = export.export_crawl(spark, str(tmp_path / "c/manifest.json"), str(tmp_path / "out"), SITE)
    assert out.count() == 4 and (tmp_path / "out/Корень/Раздел/Лист.html").is_file()
    assert 'href="Корень/index.html"' in (tmp_path / "out/index.html").read_text(encoding="utf-8") and json.loads((tmp_path / "out/manifest.json").read_text(encoding="utf-8"))["pages"] == 4


def test_chapters_and_cleaning():
    html = """<body><h1 id="one">Первая</h1><div class="filter_place"><form><input></form></div><p><a href="#two">x</a><a href="two">y</a></p>
    <table><tr><th>n</th></tr><tr><td><ol class="n"><li></li></ol></td><td>a</td></tr><tr><td><ol class="n"><li></li></ol></td></tr></table><script>x</script><nav> </nav><h1></h1><p>z</p><h1 id="two">Вторая/</h1><p>w</p></body>"""
    first, second = export.chapters(html)
    assert first[:2] == ("Первая", "Первая/index.html") and second[:2] == ("Вторая/", "Вторая/index.html")
    assert "<form" not in first[2] and "script>" not in first[2] and "<nav" not in first[2]
    assert first[2].count('class="row-number"') == 2 and ">1</td>" in first[2] and ">2</td>" in first[2]
    assert 'href="Вторая/index.html"' in first[2] and "w</p>" in second[2]


def test_navigation_and_enrichment(spark, tmp_path):
    r = navigation.ROOT
    pages = [(f"{r}/Б/Интерфейс/М.html", "<h1>М()</h1><p>Функция М(а)</p><p>См. также</p><p>Возвращает данные объекта.</p>"), (f"{r}/Б/Интерфейс/index.html", "<h1>i</h1>"), (f"{r}/Б/Интерфейс/Г/Д/Н.html", "<p>короткая</p>"), (f"{r}/А/Переопределение/x.txt", "")]
    nav = navigation.build(spark.createDataFrame(pages, "source_path string, html string"))
    sections = {s.name: s for s in navigation.nested(nav).collect()}
    assert list(sections["А"].kinds) == ["Переопределение"] and sections["А"].method_count == 0 and sections["Б"].method_count == 2
    main, other = sections["Б"].groups
    assert (main.name, main.methods[0].purpose, other.name, other.methods[0].method, other.methods[0].purpose) == ("Основные процедуры и функции", "Возвращает данные объекта.", "Г", "Н", "Н")
    evidence = [{"method": m.method, "purpose": m.purpose, "source_path": m.source_path} for m in main.methods]
    assert main.source_hash == hashlib.sha256(json.dumps(evidence, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    odd = [{"method": "a\x00\x1f\x0b", "purpose": 'q"\\ \n\r\t\b\f', "source_path": "й/€"}]
    rows = spark.createDataFrame([([(x["method"], x["purpose"], x["source_path"]) for x in odd],)], "m array<struct<method string, purpose string, source_path string>>")
    assert rows.select(navigation.source_hash(F.col("m"))).first()[0] == hashlib.sha256(json.dumps(odd, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    asked = enrich.requests(nav.groups, nav.methods, (1, 100))
    answer = lambda payload, schema: {"cards": [{"id": payload["groups"][0]["id"], "description": "d", "keywords": ["файл"], "evidence_methods": [payload["groups"][0]["methods"][0][0]], "confidence": "high"}]}
    cards = spark.createDataFrame(enrich.answered(asked, answer), "id string, description string, keywords array<string>, evidence_methods array<string>, confidence string")
    done = enrich.enriched(nav.groups, nav.methods, cards)
    assert {tuple(r.keywords) for r in done.collect()} == {("файл",)} and done.count() == 2
    for bad in (cards.limit(1), cards.withColumn("evidence_methods", F.array(F.lit("нет")))):
        with pytest.raises(ValueError):
            enrich.enriched(nav.groups, nav.methods, bad)
    cards_schema = enrich.schema("cards", 2)["properties"]["cards"]
    assert (cards_schema["minItems"], cards_schema["maxItems"]) == (2, 2)
    assert cards_schema["items"]["required"] == ["id", "description", "keywords", "evidence_methods", "confidence"] and cards_schema["items"]["properties"]["confidence"] == {"enum": ["high", "medium", "low"]}
    assert cards_schema["items"]["properties"]["keywords"] == {"type": "array", "minItems": 3, "maxItems": 7, "items": {"type": "string", "minLength": 2, "maxLength": 60}}
    assert enrich.schema("sections", 1, True)["properties"]["sections"]["items"]["required"] == ["name", "description", "keywords"]
    asked_again = enrich.answered(asked, answer, folder=str(tmp_path / "e"))
    assert enrich.answered(asked, lambda *_: 1 / 0, folder=str(tmp_path / "e")) == asked_again and (tmp_path / "e/batch-001.request.json").is_file()


def test_versions(spark, tmp_path):
    assert tuple(versions.release(" 03_1.011 ")) == ("3.1.11", "3.1")
    for bad in ("3", "3.1.preview", ""):
        with pytest.raises(ValueError):
            versions.release(bad)
    xml = '<?xml version="1.0"?><m:DistributionSupport xmlns:m="u"><m:parentConfigurationInfos configRelease="3.1.11.155"/></m:DistributionSupport>'
    rows = spark.createDataFrame([("a", xml), ("b", '{"1.0","3.1.2","x"},Lib,"9.9"'), ("c", "no")], "k string, c string")
    got = {r.k: (r.x, r.q) for r in rows.select("k", versions.from_support_xml(F.col("c")).alias("x"), versions.quoted_before(F.col("c"), "Lib").alias("q")).collect()}
    assert got == {"a": ("3.1.11.155", None), "b": (None, "3.1.2"), "c": (None, None)}
    assert versions.decoded("й".encode("cp1251")) == "й" and versions.decoded("﻿й".encode()) == "й" and corpus.html_text("й".encode()) == "й"
    found = spark.createDataFrame([(p,) for p in ("x/ParentConfigurations.bin", "y/Configuration.distr", "z")], "path string")
    assert corpus.project_file(found).first().path == "y/Configuration.distr"
    demos = spark.createDataFrame([(v,) for v in ("3.1.11.9", "3.1.11.115", "3.1.12")], "demo_version string")
    assert corpus.matching_release(demos, "3.1.11.155").first().demo_version == "3.1.11.115"


def test_archives_cookies_and_manifests(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a/b.txt", "x")
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../b.txt", "x")
    archive = lambda b: spark.createDataFrame([("p", bytearray(b.getvalue()))], "path string, content binary")
    assert [(r.member, bytes(r.data)) for r in corpus.zip_members(archive(data)).collect()] == [("a/b.txt", b"x")]
    with pytest.raises(Exception, match="unsafe"):
        corpus.zip_members(archive(bad)).collect()
    assert [n for n in ("a/b", "../a", "/a", "a\\b", "c:d", "a/..b") if safe(zipfile.ZipInfo(n))] == ["a/b", "a/..b"]
    assert crawl.cookies(spark, '[{"name": "a", "value": null}, {"value": 1}]') == {"a": ""} and crawl.cookies(spark, '{"a": 1}') == {"a": "1"} and crawl.cookies(spark, None) == {}
    assert crawl.header(" a =b=c") == ("a", "b=c")
    for wrong in (lambda: crawl.cookies(spark, "3"), lambda: crawl.header("x"), lambda: crawl.header(" =x")):
        with pytest.raises(ValueError):
            wrong()
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/0001.html").write_text("﻿<h1>x</h1>", encoding="utf-8")
    (tmp_path / "m.json").write_text(json.dumps({"schemaVersion": 1, "pages": {"u": {"status": "ok", "title": "t", "file": "pages/0001.html", "children": ["v"]}, "v": {"status": "error", "error": "HTTP 404"}}}), encoding="utf-8")
    assert [tuple(r) for r in corpus.crawled_pages(spark, str(tmp_path / "m.json")).collect()] == [("u", "t", None, "<h1>x</h1>")]
    manifest = corpus.crawl_manifest(spark, str(tmp_path / "m.json"))
    assert corpus.counters(manifest).first().asDict() == {"pages": 1, "errors": 1, "fetched": 1, "skipped": 0} and manifest.agg(corpus.next_number(manifest)).first()[0] == 2


def test_text_functions(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]
    assert one("  a \t b\r\n\n c ", text.clean_lines) == "a b\nc" and one(" a  b \n", text.squash) == "a b"
    assert one(' a<b>:c / . ', text.slug) == "a b c" and one("...", text.slug) == "index" and one("ab. " + "x" * 200, text.bounded_name) == "ab. " + "x" * 96
    assert list(one("Ab-cd и ещё ABC abc", text.discovery_tokens)) == ["ещё", "abc"] and one("x" * 10, lambda c: text.excerpt(c, 4)) == "xxxx…"
    assert list(one("Café ЁЛКА foo_bar ſ Ǣ", text.index_tokens)) == ["cafe", "ёлка", "foo", "bar", "s", "ǣ"]
    assert one("q", text.query_text).endswith("\nQuery: q") and "Source" not in one("t", lambda c: text.embedding_text("Docs", F.lit("1.0"), F.array(F.lit("a")), F.lit(""), c))


def test_health_is_checked_when_due(spark):
    now, runs = [0.0], []
    empty = spark.createDataFrame([], "query_id long, expected string")

    def run():
        runs.append(1)
        return empty

    check = health.HealthCheck(run, ttl=10, clock=lambda: now[0])
    assert check.ensure(("a",)) and not check.ensure(("a",)) and check.ensure(("b",))
    now[0] = 10
    assert check.ensure(("b",)) and len(runs) == 3
    bad = health.HealthCheck(lambda: spark.createDataFrame([(1, "x")], "query_id long, expected string"))
    with pytest.raises(RuntimeError):
        bad.ensure(("a",))
    assert bad.due(("a",))


def test_archives_are_read_by_ranges_of_members(spark, tmp_path):
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.mkdir("empty")
        for i in range(60):
            archive.writestr(f"d{i % 3}/é{i}.html", "".join(f"{i * j % 9973:x} " for j in range(i * 70)))
    read = read_archive(spark, f"file:{path}", 20_000)
    assert read.rdd.getNumPartitions() > 5
    whole = corpus.zip_members(spark.read.format("binaryFile").load(str(path)))
    content = lambda df: {r.member: bytes(r.data) for r in df.collect()}
    assert content(read) == content(whole) == content(read_archive(spark, str(path))) and read.count() == 60
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as archive:
        archive.writestr("../x", "")
    zipfile.ZipFile(tmp_path / "none.zip", "w").close()
    assert read_archive(spark, str(tmp_path / "none.zip")).count() == 0
    with pytest.raises(Exception, match="unsafe"):
        read_archive(spark, str(tmp_path / "bad.zip")).count()


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([(1, "a")], "k long, v string").schema
    for rows, count in (([(1, "a"), (2, "b"), (2, "b")], 2), ([(2, "c"), (3, "d")], 3)):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        ingest.ingest(spark, source, schema, target, str(tmp_path / "ck"), "k")
        assert spark.read.parquet(target).count() == count
    stream = ingest.windowed_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(source))
    assert stream.isStreaming and stream.columns == ["window", "event_type", "n"]


def test_pages_of_one_address_keep_their_own_links(spark, tmp_path):
    from lantern.plans import text_queries

    rows = [(1, "http://h/x", '<a href="a">a</a><a href="b">b</a>'), (2, "http://h/x", '<a href="c">c</a>'), (3, None, '<a href="d">d</a>')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, text_queries.html_links(spark, str(tmp_path)).collect())) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]


def test_small_files_are_spread_and_members_batched(spark, tmp_path):
    from lantern.plans import engine_queries, tables

    spark.createDataFrame([(i, f"S{i}") for i in range(1300)], "s_suppkey long, s_name string").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert tables.spread(tables.table(spark, str(tmp_path), "supplier"), "s_suppkey").rdd.getNumPartitions() == 3
    got = {tuple(r) for r in engine_queries.archive_members(spark, str(tmp_path)).collect()}
    assert got == {(f"a{i}", f"d/{k}.html", f"S{i} {k}") for i in range(1300) for k in range(3)}


def test_token_counts_of_ids_that_repeat_or_lack(spark, tmp_path):
    """df counts distinct ids, as the SQL does: a null id is none."""
    from lantern.plans import search_queries

    rows = [(1, "a b a", "en", "s"), (1, "a", "en", "s"), (None, "a c", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in search_queries.token_df(spark, str(tmp_path)).collect()} == {("a", 1, 4), ("b", 1, 1), ("c", 0, 1)}

"""Pages to sections: hierarchy, flags, ids, packing, breadcrumbs; scans and index suppression."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lantern.functions import markup
from lantern.operators import documents, scope
from lantern.sources import corpus

PAGE = """<h1 id="chapter">Глава</h1><p>Начало.</p><h2 id="files">Файлы</h2><p>Рекомендуется метод.</p><pre><code>Код = 1;</code></pre>
<h4></h4><h3 id="legacy">Старое</h3><p>Метод устарел.<p>Не рекомендуется <b>x</b></p><div>мимо</div><table><tr><td>a<td>b</table><h5>Глубоко</h5>"""
SCHEMA = "source_path string, breadcrumb array<string>, html string"


def sections(spark, html, version="3.1.11.155", path="", base=(), limit=8000):
    return documents.sections(spark.createDataFrame([(path, list(base), html)], SCHEMA), version, limit).orderBy("ord").collect()


def test_hierarchy_flags_and_blocks(spark):
    got = sections(spark, PAGE)
    assert [(r.anchor, list(r.breadcrumb)) for r in got] == [
        ("chapter", ["Глава"]),
        ("files", ["Глава", "Файлы"]),
        ("legacy", ["Глава", "Файлы", "Старое"]),
        ("section-4", ["Глава", "Файлы", "Старое", "Глубоко"]),
    ]
    assert "Код = 1;" in got[1].text and got[1].has_recommendation and not got[1].has_warning
    assert got[2].text == "Метод устарел.\n\nНе рекомендуется\nx\n\na\nb" and got[2].has_warning and got[2].has_recommendation
    assert got[3].text == "Глубоко" and [r.part for r in got] == [1, 1, 1, 1]


def test_ids(spark):
    one, two, three, four = (sections(spark, PAGE, v, p) for v, p in (("3.1.11.155", ""), ("3_1_11_155", ""), ("3.2.1.1", ""), ("3.1.11.155", "a.html")))
    ids = [[r.id for r in x] for x in (one, two, three, four)]
    assert ids[0] == ids[1] and not set(ids[0]) & (set(ids[2]) | set(ids[3]))
    assert ids[0][0] == hashlib.sha256("3.1.11.155\0\0chapter\0001\0Начало.".encode()).hexdigest()[:24]


def reference_pack(blocks, limit):
    out, open_ = [], None
    for b in blocks:
        if open_ is not None and len(open_) + 2 + len(b) > limit:
            out.append(open_)
            open_ = None
        if len(b) <= limit:
            open_ = b if open_ is None else f"{open_}\n\n{b}"
        else:
            out += [s for k in range(0, len(b), limit) if (s := b[k : k + limit].strip())]
    return out + ([open_] if open_ is not None else [])


def test_packing(spark):
    cases = [["a" * 100, "b" * 150, "c" * 60], ["x" * 700, "y"], ["q", "z " * 400, "w" * 300], ["é" * 299, "f" * 300], ["s" * 299 + " " * 3 + "t" * 10]]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, blocks array<string>").select("i", documents.packed(documents.F.col("blocks"), 300).alias("p"))
    assert [list(r.p) for r in got.orderBy("i").collect()] == [reference_pack(c, 300) for c in cases]


def test_breadcrumbs_merge(spark):
    got = sections(spark, "<h1>ПолучитьФайл</h1><p>x</p>", base=("Раздел", " получитьфайл "), path="p.html")
    assert list(got[0].breadcrumb) == ["Раздел", " получитьфайл "]


def test_scan_suppresses_aggregates(spark, tmp_path):
    for name in ("Глава 1/index.html", "Глава 2/index.html", "Глава 2/Раздел/Метод+ 1.html", "Глава 3/Страница.html", "Г4/INDEX.HTML"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("<h1>t</h1><p>x</p>", encoding="utf-8")
    got = corpus.scan(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.source_path for r in got] == ["Г4/INDEX.HTML", "Глава 1/index.html", "Глава 2/Раздел/Метод+ 1.html", "Глава 3/Страница.html"]
    assert list(got[2].breadcrumb) == ["Глава 2", "Раздел"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        corpus.scan(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        corpus.scan(spark, str(tmp_path / "missing"))


def test_scopes(spark):
    r = scope.ROOT
    paths = [f"{r}/Файлы/Интерфейс/a.html", f"{r}/Файлы/Интерфейс/Г/b.html", f"{r}\\Файлы\\Переопределение\\c.html", f"{r}/Печать/Интерфейс/d.html", "Глава 5/e.html", f"{r}/Abc/Интерфейс/f.html"]
    df = spark.createDataFrame([(p,) for p in paths], "source_path string")
    found = lambda **k: {paths.index(x.source_path) for x in scope.scoped(df, **k).collect()}
    assert found() == set(range(6)) and found(mode="development") == {0, 1, 3, 5} and found(mode="override") == {2}
    assert found(subsystem="Файлы") == {0, 1, 2} and found(subsystem="aBC") == {5} and found(subsystem="файлы") == set()
    assert found(subsystem="Файлы", group=scope.MAIN_GROUP) == {0, 2} and found(subsystem="Файлы", group="Г") == {1}
    assert found(subsystem="Файлы", group=scope.MAIN_GROUP, mode="development") == {0}
    for bad in ({"mode": "subsystem"}, {"group": "Г"}):
        with pytest.raises(ValueError):
            scope.scoped(df, **bad)


def test_markdown():
    html = "<h1>T</h1><p>a <b>b</b> <i>c</i></p><ul><li>x<li>y</ul><pre>k = 1</pre><script>no</script>"
    assert markup.markdown(html) == "# T\n\na **b** *c*\n\n- x\n- y\n\n```\nk = 1\n```"


def test_blocks_of_a_table_function_are_those_of_the_arrays(spark):
    odd = ["<p>before</p><h2 id='a'> A\u00a0 b </h2><p>one<br>two</p><ul><li>x<p>inner</p></li></ul><h4></h4><h4>Deep</h4><h1>Last</h1><pre> a\n\n  b </pre>", "", None, "<p>no heading</p>", "<h3>Only</h3>", "<h1>" + "x " * 9000 + "</h1>" + "<p>y</p>" * 500]
    pages = spark.createDataFrame(list(enumerate(odd)), "id int, html string")
    read = documents.headings(pages).select("id", F.posexplode("headings").alias("n", "h")).select("id", (F.col("n") + 1).alias("heading"), "h.*")
    want = {(r.id, r.heading): (r.level, r.title, r.anchor, list(r.blocks)) for r in read.collect()}
    got = {}
    for r in documents.html_blocks(pages).orderBy("id", "heading", "block").collect():
        if r.block == 0:
            got[r.id, r.heading] = (r.level, r.title, r.anchor, [])
        else:
            got[r.id, r.heading][3].append(r.text)
    assert got == want
    paths = documents.headings(pages).select("id", F.posexplode(documents.hierarchy(F.col("headings"))).alias("n", "path"))
    assert {(r.id, r.n + 1): list(r.path) for r in paths.collect()} == {(r.id, r.heading): list(r.path) for r in documents.html_blocks(pages).filter("block = 0").collect()}


def test_trees_are_freed_and_pages_are_read_in_slices(spark, monkeypatch):
    """No tree is left to the collector of cycles, and slices give each page its own headings."""
    import gc

    gc.collect()
    gc.disable()
    try:
        before = sum(isinstance(o, documents.markup.Node) for o in gc.get_objects())
        documents._headings("<h1>a</h1><ul><li>x<li>y</ul>" * 50)
        assert sum(isinstance(o, documents.markup.Node) for o in gc.get_objects()) == before
    finally:
        gc.enable()
    pages = spark.createDataFrame([(i, f"<h1>t{i}</h1><p>b{i}</p>") for i in range(700)], "id int, html string").coalesce(1)
    got = documents.headings(pages).select("id", "headings.title", "headings.blocks").collect()
    assert [(r.id, r.title, r.blocks) for r in got] == [(i, [f"t{i}"], [[f"b{i}"]]) for i in range(700)]

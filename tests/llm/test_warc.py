"""WARC archives: round trips, magic inside payloads, groups, and odd rows."""

import base64
import hashlib

from lantern.llm import exact_dedup, warc

SCHEMA = "page_id long, url string, html string, type string, offset int"


def records(spark, tmp_path, rows):
    pages = spark.createDataFrame([(*r, "extra", 7) for r in rows], SCHEMA)
    path = str(tmp_path / "archive")
    warc.write(pages, path)
    return sorted((tuple(r) for r in warc.page_records(spark, path).collect()), key=str)


def expected(rows):
    first = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        first[payload] = min(first.get(payload, page), page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        same = first[payload] == page
        out.append((page, len(payload), digest, "response" if same else "revisit", None if same else first[payload]))
    return sorted(out, key=str)


def test_groups_empty_and_unicode(spark, tmp_path):
    rows = [(5, "http://a/ b", "x"), (3, None, "x"), (9, "u", None), (8, "u", ""), (1, "u", "ünï\r\n\r\ncode €"), (2, "u", "z" * 70_000), (2, "u", "z" * 70_000)]
    assert records(spark, tmp_path, rows) == expected(rows)


def test_magic_inside_payloads(spark, tmp_path):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:lantern:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"u{i}", f"<p>{i}</p>") for i in range(40)]
    rows += [(100, "u", inner), (101, "u", "a" + inner + inner + "b"), (102, "u", "WARC/1.1\r\n"), (103, "u", "x\r\n\r\nWARC/1.1\r\nWARC/1.1\r\n")]
    # a false header that leads into the middle of what follows, and one that isn't a number
    rows += [(104, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 20000\r\n\r\n"), (105, "u", "WARC/1.1\r\nWARC-Type: x\r\nContent-Length: ten\r\n\r\n")]
    rows += [(200 + i, "u", inner * i) for i in range(1, 6)]
    assert records(spark, tmp_path, rows) == expected(rows)


def test_small_blocks(spark, tmp_path):
    rows = [(i, f"u{i}", f"<p>{'y' * (i * 37 % 900)}{i}</p>") for i in range(300)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert records(spark, tmp_path, rows) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_table(spark, tmp_path):
    assert records(spark, tmp_path, []) == []


def test_filter_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SLICE_BYTES", 4096)
    rows = [(i, f"u{i}", f"<p>{i % 7 if i % 2 else i}</p>") for i in range(5000)] + [(3, "u", "<p>3</p>"), (6000, "u", "long " * 300_000)]
    assert records(spark, tmp_path, rows) == expected(rows)

"""Lossless WebP: every tool round trips; payload columns against plain Python."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest

from lantern.llm import media, webp

TOOLS = ("palette", "predictor", "cross", "green", "cache", "copies")


@pytest.mark.parametrize("n", range(len(TOOLS) + 1))
def test_tools_round_trip(n):
    rng = np.random.default_rng(n)
    for tools in itertools.combinations(TOOLS, n):
        for colours in (1, 2, 4, 16, 150):
            height, width = rng.integers(1, 12, 2)
            image = rng.integers(0, 256, (colours, 4), np.uint8)[rng.integers(0, colours, (height, width))]
            image = np.tile(image, (2, 1, 1))
            assert np.array_equal(webp.decode(webp.encode(image, tools, n)), image), (tools, colours)


def test_every_predictor():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (8, 9, 4), np.uint8)
    for mode in range(14):
        blocks = np.full((2, 3, 4), mode, np.uint8)
        assert np.array_equal(webp._predict(webp._predict(image, blocks, 2, False), blocks, 2, True), image), mode


def test_near_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)


def test_damaged_images_are_errors():
    whole = webp.encode(np.zeros((4, 16, 4), np.uint8))
    for bad in (b"", whole[:30], b"x" + whole, whole.replace(b"VP8L", b"VP8X")):
        with pytest.raises(webp.FormatError):
            webp.decode(bad)


def slowly(monkeypatch, data):
    with monkeypatch.context() as m:
        m.setattr(webp, "_read_at_once", lambda *a: None)
        m.setattr(webp, "_predict_one", lambda image, mode, inverse: webp._predict_any(image, np.full((1, 1, 4), mode, np.uint8), 9, inverse))
        return webp.decode(data)


def test_production_images_are_compressed(monkeypatch):
    rng = np.random.default_rng(8)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(300)]
    prose = " ".join(rng.choice(words, 900))
    slope = (np.add.outer(np.arange(90) * 3, np.arange(16) * 7)[..., None] + [0, 40, 90, 200]).astype(np.uint8)
    columns = (rng.integers(0, 256, (1, 16, 4)) + rng.integers(-3, 4, (90, 16, 4)).cumsum(0)).astype(np.uint8)
    rows = (rng.integers(0, 256, (90, 1, 4)) + rng.integers(-3, 4, (90, 16, 4)).cumsum(1)).astype(np.uint8)
    grey = np.repeat(rng.integers(0, 256, (90, 16, 1)), 4, 2).astype(np.uint8) + rng.integers(0, 3, (90, 16, 4), dtype=np.uint8)
    used, encode = [], webp.encode
    monkeypatch.setattr(webp, "encode", lambda image, tools=(), seed=0: used.append(tools) or encode(image, tools, seed))
    text = lambda t: np.frombuffer(media.payload_of(t), np.uint8).reshape(-1, 16, 4)
    cases = {"prose": (text(prose), 0.75), "repeated": (text((prose[:640] * 40)), 0.1), "few": (text("abcdabceabcf" * 900), 0.05), "slope": (slope, 0.2), "columns": (columns, 0.6), "rows": (rows, 0.6), "grey": (grey, 0.75), "noise": (rng.integers(0, 256, (70, 16, 4), np.uint8), 1.2), "large": (text(" ".join(rng.choice(words, 40_000))), 0.6)}
    for name, (image, most) in cases.items():
        data = webp.compress(image)
        assert len(data) < most * image.size, (name, len(data), image.size)
        assert np.array_equal(webp.decode(data), image), name
        if name != "large":
            assert np.array_equal(slowly(monkeypatch, data), image), name
    assert {"palette", "left", "top", "green", "cache", "copies"} <= {t for tools in used for t in tools}
    assert len(media.to_media(media.payload_of(prose))) < 0.75 * len(prose)


@pytest.mark.parametrize("n", range(len(TOOLS) + 1))
def test_both_readings_agree(n, monkeypatch):
    rng = np.random.default_rng(50 + n)
    for tools in itertools.combinations(TOOLS, n):
        image = np.tile(rng.integers(0, 256, (90, 4), np.uint8)[rng.integers(0, 90, (9, 11))], (3, 1, 1))
        data = webp.encode(image, tools, n)
        assert np.array_equal(slowly(monkeypatch, data), image) and np.array_equal(webp.decode(data), image), tools


def test_code_lengths_are_the_best():
    rng = np.random.default_rng(4)
    for n in (2, 3, 7, 60):
        counts = {s: int(c) for s, c in enumerate(rng.integers(1, 1000, n) ** 2)}
        heap = sorted(counts.values())
        best = 0
        while len(heap) > 1:
            both = heap[0] + heap[1]
            best += both
            heap = sorted([*heap[2:], both])
        assert sum(counts[s] * x for s, x in enumerate(webp._lengths(counts, n, 30))) == best
        assert max(webp._lengths({s: 2**s for s in range(20)}, 20, 7)) <= 7


def test_columns(spark):
    texts = [None, "", "a", "a", "é" * 40, "x" * 64, "y" * 65, "z" * (webp.MAX_SIDE * 64 + 5)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, payload string")
    got = {r.doc_id: r for r in media.read_back(media.store(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i].read
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[2].media == got[3].media and got[2].read.feature == got[3].read.feature and got[0].read == got[1].read
    found = media.pixels(media.store(docs.filter("doc_id = 4"))).first().pixels
    assert bytes(found.samples) == ("é" * 40).encode() + bytes(48) and found.width == 16
    assert media.read_back(media.store(docs.limit(0))).count() == 0


def test_groups_of_codes_short_distances_and_counted_lengths():
    """A stream put together bit by bit by the format's description: the encoder here never writes one like it."""
    out = webp.BitWriter()
    bits = out.bits.append
    simple = lambda *s: bits("1" + "01"[len(s) > 1] + "1" + "".join(format(x, "08b")[::-1] for x in s))
    for value, n in ((0x2F, 8), (7, 14), (3, 14), (1, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        out.write(value, n)  # signature, 8 by 4 pixels, alpha, version; no transform, no cache; groups by blocks of 4
    bits("0")  # the image of groups has no cache
    simple(0, 1)
    for only in (0, 0, 255, 0):
        simple(only)
    bits("01")  # the left block has group 0, the right one group 1
    # group 0, green: lengths of 2 for 7, 9, 257 and 259, by a code of lengths 0, 2 and runs of zeros, nine of which are counted
    bits("0")
    own = {0: 2, 2: 2, 17: 2, 18: 2}
    out.write(15, 4)
    for s in webp.LENGTH_ORDER:
        out.write(own.get(s, 0), 3)
    bits("1")
    out.write(1, 3)
    out.write(9 - 2, 4)
    zero, two, few, many = "00", "01", "10", "11"
    for code, extra, n in ((few, 7 - 3, 3), (two, 0, 0), (zero, 0, 0), (two, 0, 0), (many, 138 - 11, 7), (many, 109 - 11, 7), (two, 0, 0), (zero, 0, 0), (two, 0, 0)):
        bits(code)
        out.write(extra, n)
    for only in (1, 2, 255):
        simple(only)
    bits("1" + "1" + "0" + "0" + "10000000")  # distances: the pixel above (0) and the one to the left (1), the first symbol in one bit
    for only in (100, 3, 4, 255, 0):
        simple(only)  # group 1: one colour, no bits
    seven, nine, twice, four, above, left = "00", "01", "10", "11", "0", "1"
    for code in (seven, nine, twice, left, four, above, nine, seven, four, above, seven, seven, seven, seven):
        bits(code)
    image = webp.decode(webp._wrapped(np.packbits(out.array(), bitorder="little").tobytes()))
    a, b, c = (7, 1, 2, 255), (9, 1, 2, 255), (100, 3, 4, 255)
    assert [[tuple(p) for p in row] for row in image.tolist()] == [[a, b, b, b, c, c, c, c], [a, b, b, b, c, c, c, c], [b, a, b, b, c, c, c, c], [a, a, a, a, c, c, c, c]]


def test_distances_by_their_codes():
    """The first and the last short distances as the format lists them, and those beyond."""
    assert [webp._distance(k, 16) for k in (1, 2, 3, 4, 5, 6, 120, 121, 137)] == [16, 1, 17, 15, 32, 2, 120, 1, 17]
    assert webp._distance(4, 1) == 1  # none is below 1


def test_reading_takes_few_steps(monkeypatch):
    """A code's own lengths are read as one number; cut short in them, an image is an error."""
    rng, calls, read = np.random.default_rng(3), [], webp.BitReader.read
    image = np.frombuffer(rng.choice(np.frombuffer(b"etaoin shrdlucmfwypvbgkqjxz.,ETA", np.uint8), 16 * 4 * 50).tobytes(), np.uint8).reshape(50, 16, 4)
    stored = webp.compress(image)
    monkeypatch.setattr(webp.BitReader, "read", lambda bits, n: calls.append(n) or read(bits, n))
    assert (webp.decode(stored) == image).all() and len(calls) < 50
    for kept in range(26, 40):
        with pytest.raises(webp.FormatError):
            webp.decode(stored[:kept])


def test_many_images_are_stored_and_read_together(monkeypatch):
    """Images of a batch are those that are made one by one; nearly all pixels and all codes of a batch take common steps."""
    rng, walked, asked = np.random.default_rng(12), [], []
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(200)]
    texts = ["", "a", "ab" * 300, *(" ".join(rng.choice(words, n)) for n in rng.integers(20, 400, 200)), "é" * 3000, "".join(map(chr, rng.integers(32, 9000, 2000)))]
    payloads = [media.payload_of(t) for t in texts]
    alone = [media.to_media(p) for p in payloads]
    at_once, lengths = webp._read_at_once, webp._lengths_all
    monkeypatch.setattr(webp, "_read_at_once", lambda image: walked.append(image.at == image.total) or at_once(image))
    monkeypatch.setattr(webp, "_lengths_all", lambda *a: asked.append(a) or lengths(*a))
    for rows in (1000, 130, 7):
        monkeypatch.setattr(media, "MOST_ROWS", rows)
        assert list(media.stored_all(payloads)) == alone
        assert [p.tobytes() for p in media.pixels_all(alone)] == payloads
        if rows == 1000:
            assert sum(walked) > 0.6 * len(texts) and len(asked) <= 8
    monkeypatch.setattr(media, "AT_ONCE", 100)
    assert list(media.stored_all(payloads)) == alone and [p.tobytes() for p in media.pixels_all(alone)] == payloads


def test_tools_round_trip_together():
    rng, images, stored = np.random.default_rng(21), [], []
    for n in range(len(TOOLS) + 1):
        for tools in itertools.combinations(TOOLS, n):
            for colours in (1, 3, 150):
                height, width = rng.integers(1, 12, 2)
                images.append(np.tile(rng.integers(0, 256, (colours, 4), np.uint8)[rng.integers(0, colours, (height, width))], (2, 1, 1)))
                stored.append(webp.encode(images[-1], tools, n))
    assert all(np.array_equal(a, b) for a, b in zip(webp.decode_all(stored), images, strict=True))


def test_damaged_images_among_others():
    """A damaged image is an error, or the same pixels, whether it is read alone or among others."""
    rng = np.random.default_rng(22)
    text = lambda n: np.frombuffer(media.payload_of("".join(rng.choice(list("etaoin shrdlu"), n))), np.uint8).reshape(-1, 16, 4)
    others = [webp.compress(text(900)) for _ in range(60)]
    whole, wrong = webp.compress(text(1500)), 0

    def read(images):
        try:
            return webp.decode_all(images)[-1]
        except webp.FormatError:
            return None

    for _ in range(40):
        bad = bytearray(whole)
        bad[int(rng.integers(25, len(bad)))] ^= 1 << int(rng.integers(8))
        if rng.integers(2):
            bad[16:20] = int(rng.integers(20, len(bad) - 20)).to_bytes(4, "little")
        alone, among = read([bytes(bad)]), read([*others, bytes(bad)])
        assert (alone is None and among is None) or np.array_equal(alone, among)
        wrong += alone is None
    assert 10 < wrong

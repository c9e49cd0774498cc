"""Token counts, toxicity, quality and languages: exactness, held-out accuracy, odd rows."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lantern.llm import common, language, quality, token_counts, toxicity

ODD = [None, "", " ", "\n\t", "123 !!", "x" * 120_000, "Ünïcödé ﬁ 日本語 🙂", "same", "same"]


def odd(spark):
    return spark.createDataFrame([(i, t, "z", 1.0) for i, t in enumerate(ODD)], "doc_id long, text string, found string, _score double")


def empty(spark):
    return odd(spark).limit(0)


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    rng = random.Random(0)
    texts = [*ODD, "  a  b \n\n c\t<s> </s> <unk>", "▁a▁▁b ▁", "\x00", "<0x41>", "\r\n", "aaaa" * 500]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 900), 32, 97, 0x4E2D])) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    got = token_counts.count_tokens(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(library.encode(t or "")) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(empty(spark)).count() == 0


def corpus(spark, n=240):
    """Invented texts in two languages; toxic ones have words of one stem, bad ones are symbols or repetition."""
    rng = random.Random(7)
    stems = {"xx": ["lor", "ana", "vel", "tor", "min"], "yy": ["krü", "zwo", "ßel", "hnk", "öpf"]}
    docs, labels = [], []
    for i in range(n):
        lang = "xx" if i % 2 else "yy"
        word = lambda lang=lang: "".join(rng.choices(stems[lang], k=rng.randint(1, 3)))
        words = [word() for _ in range(rng.randint(30, 120))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.6)
        if not good:
            words = [w.upper() + "!!#" for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
        if toxic:
            for k in rng.sample(range(len(words)), 3):
                words[k] = "gnarf" + rng.choice(stems[lang])
        docs.append((i, " ".join(words), lang, "s"))
        labels.append((i, good, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def data(spark):
    return corpus(spark)


def accuracy(scored, labels, label, folds, held_out, threshold):
    from lantern.llm.common import fold

    rows = scored.join(labels, "doc_id").filter(fold("doc_id", folds) == held_out).collect()
    assert len(rows) > 20 and all(0 <= r.score <= 1 for r in rows)
    return sum((r.score >= threshold) == bool(r[label]) for r in rows) / len(rows)


def test_toxicity(spark, data):
    docs, labels = data
    model = toxicity.fit(docs, labels)
    assert accuracy(toxicity.score(docs, model), labels, "toxic", toxicity.FOLDS, toxicity.HELD_OUT, toxicity.THRESHOLD) > 0.9
    got = toxicity.score(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score and got[7].score == got[8].score
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.fit(docs.limit(0), labels) is None and toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(odd(spark), None).collect()} == {0.0}


def test_differences_have_the_sign_of_the_class():
    from collections import Counter

    counts = tuple(Counter(g for w in words for g in toxicity.grams_of(w)) for words in (["abab", "abc", "cab"], ["xab", "abx", "xx"]))
    model = toxicity.Model(counts)
    assert model.difference("xx") > 0 > model.difference("cab")


def test_differences_are_those_of_two_kneser_ney_models():
    """Each probability by its definition, from sets of grams and what they are extended by."""
    import math
    import random
    from collections import Counter

    rng = random.Random(5)
    words = [["".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(40)] for _ in range(2)]
    counts = tuple(Counter(g for w in ws for g in toxicity.grams_of(w)) for ws in words)
    levels = [set(counts[0]) | set(counts[1])]
    while levels[-1]:
        levels.append({g[1:] for g in levels[-1] if len(g) > 1})
    extended = lambda g: sum(len({x for x in level if x[1:] == g and len(x) > 1}) for level in levels)
    every = {g for level in levels[1:] for g in level}

    def shared(h, c):
        rest = shared(h[1:], c) if h else 1 / toxicity.CHARACTERS
        after = {g: extended(g) for g in every if g[:-1] == h}
        if not sum(after.values()):
            return rest
        return (max(after.get(h + c, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(after) * rest) / sum(after.values())

    def probability(k, h, c):
        after = {g: n for g, n in counts[k].items() if g[:-1] == h}
        if not after:
            return shared(h[1:], c)
        return (max(after.get(h + c, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(after) * shared(h[1:], c)) / sum(after.values())

    model = toxicity.Model(counts)
    for word in [*words[0][:4], *words[1][:4], "dcba", "xyz", "a", "abxab"]:
        want = sum(math.log(probability(1, g[:-1], g[-1]) / probability(0, g[:-1], g[-1])) for g in toxicity.grams_of(word))
        assert abs(model.difference(word) - want) < 1e-9, word


def test_clashing_columns(spark, data):
    """Columns named like a result are replaced; all others, whatever their names, hold what they held."""
    docs, labels = data
    names = ["Score", "n_tokens", "lang_pred", "_found", "rank", "label", "s_id"]
    odd_docs = odd(spark).drop("found", "_score").select("doc_id", "text", *(language.F.concat(language.F.lit(f"{n} "), "doc_id").alias(n) for n in names))
    made = {
        "score": [toxicity.score(odd_docs, toxicity.fit(docs, labels)), quality.score(odd_docs, quality.fit(docs, labels)), toxicity.score(odd_docs, None), quality.score(odd_docs, None)],
        "n_tokens": [token_counts.count_tokens(odd_docs)],
        "lang_pred score": [language.predict(odd_docs, language.fit(docs)), language.predict(odd_docs, None)],
    }
    for own, results in made.items():
        for out in results:
            assert len({c.lower() for c in out.columns}) == len(out.columns)
            for r in out.collect():
                assert all(r[n] == f"{n} {r.doc_id}" for n in names if n.lower() not in own.split())
                assert all(not isinstance(r[c], str) or not r[c].startswith(c) for c in own.split() if c in out.columns)


def test_very_long_texts_are_learned_from_by_a_part(spark, data, monkeypatch):
    docs, labels = data
    monkeypatch.setattr(language.common, "SAMPLE_CHARS", 60)
    part = language.common.learned_part("text", "doc_id")
    rows = spark.createDataFrame([(1, "a" * 60), (2, None), (3, "".join(f"{k:04}" for k in range(1000))), (4, "".join(f"{k:04}" for k in range(1000)))], "doc_id long, text string")
    one, none, *long = (r[0] for r in rows.orderBy("doc_id").select(part).collect())
    assert one == "a" * 60 and none == "" and all(0 < len(x) <= 60 for x in long) and long[0] != long[1]
    assert set(language.fit(docs).languages) == {r.lang for r in docs.select("lang").distinct().collect() if r.lang}
    assert toxicity.fit(docs, labels) is not None and quality.fit(docs, labels) is not None


def test_quality(spark, data):
    docs, labels = data
    model = quality.fit(docs, labels)
    assert accuracy(quality.score(docs, model), labels, "quality", quality.FOLDS, quality.HELD_OUT, quality.THRESHOLD) > 0.9
    got = quality.score(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score and got[7].score == got[8].score
    assert quality.score(empty(spark), model).count() == 0
    assert quality.fit(docs.limit(0), labels) is None
    assert {r.score for r in quality.score(odd(spark), None).collect()} == {0.5}


def test_every_language_is_learned(spark):
    rows = [(8 * k + i, f"word{k} " * 3, f"lang{k:03}") for k in range(205) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = docs.filter(language.common.fold("doc_id", language.FOLDS) != language.HELD_OUT)
    assert set(language.fit(docs).languages) == {r.lang for r in learned.select("lang").distinct().collect()}
    assert learned.select("lang").distinct().count() > 200


def test_language(spark, data):
    from lantern.llm.common import fold

    docs, _ = data
    model = language.fit(docs)
    rows = language.predict(docs, model).filter(fold("doc_id", language.FOLDS) == language.HELD_OUT).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    got = language.predict(odd(spark), model).collect()
    assert [r.lang_pred == "und" for r in got] == [t is None or not any(map(str.isalpha, t)) for t in ODD]
    assert language.predict(empty(spark), model).count() == 0
    assert language.fit(docs.withColumn("lang", language.F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in language.predict(odd(spark), None).collect()} == {"und"}


def test_word_sums_equal_whole_texts():
    """A text's logits are those of its n-grams, whatever was remembered before."""
    import numpy as np

    table = np.random.default_rng(0).normal(size=(language.BUCKETS, 3))
    known = language.WordTable(table)
    for text in ("Ab cd ab", "cd cd é x", "ab"):
        words = language.words_of(text)
        buckets, _ = language.hashed_grams(words)
        assert np.allclose(known.sums(words), [*table[buckets].sum(0), len(buckets)])


def plain_grams(text):
    """Buckets and shares of a text's character n-grams, one n-gram at a time."""
    counts = Counter()
    for word in text.lower().split():
        codes = [ord(c) for c in f"{language.MARK}{word}{language.MARK}"]
        for n in range(1, language.MAX_N + 1):
            for k in range(len(codes) - n + 1):
                h = 0
                for m in range(1, n + 1):
                    h = (h * 0x100000001B3 + codes[k + m - 1] + m) % 2**64
                counts[(h * 0x9E3779B97F4A7C15 % 2**64 >> 40) % language.BUCKETS] += 1
    return {b: c / sum(counts.values()) for b, c in counts.items()}


def test_languages_are_learned_as_defined(spark):
    """Follow-the-regularised-leader by its definition, one coordinate at a time, on all of a small sample."""
    rng = random.Random(2)
    stems = {"l1": ["lor", "ana"], "l2": ["krü", "zwo"], "l3": ["aki", "lor"]}
    texts = [(" ".join("".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(6)), lang) for lang in sorted(stems) * 7]
    model = language.train([t for t, _ in texts], [m for _, m in texts])
    seen = [plain_grams(t) for t, _ in texts]
    df = Counter(b for x in seen for b in x)
    idf = lambda b: language.SCALE * (1 + math.log((len(texts) + 1) / (df[b] + 1)))
    z, n, names = defaultdict(float), defaultdict(float), sorted(stems)

    def weight(key):
        if abs(z[key]) <= language.L1:
            return 0.0
        return -(z[key] - math.copysign(language.L1, z[key])) / ((language.BETA + math.sqrt(n[key])) / language.ALPHA + language.L2)

    for _ in range(language.EPOCHS):
        for x, (_, mark) in zip(seen, texts):
            values = {b: share * idf(b) for b, share in x.items()} | {"bias": 1.0}
            old = {(b, m): weight((b, m)) for b in values for m in names}
            logits = {m: sum(old[b, m] * v for b, v in values.items()) for m in names}
            total = sum(math.exp(v) for v in logits.values())
            for m in names:
                error = math.exp(logits[m]) / total - (m == mark)
                for b, v in values.items():
                    g, before = v * error, n[b, m]
                    n[b, m] += g * g
                    z[b, m] += g - (math.sqrt(n[b, m]) - math.sqrt(before)) / language.ALPHA * old[b, m]
    assert model.languages == names
    for k, m in enumerate(names):
        assert model.bias[k] == pytest.approx(weight(("bias", m)), abs=1e-9)
        assert {b: model.table[b, k] for b in df} == pytest.approx({b: weight((b, m)) * idf(b) for b in df}, abs=1e-9)
    odd_texts = ["loranakrü zwo", "Aki  AKI", "neues wort", texts[0][0]]
    got = language.predict(spark.createDataFrame(list(enumerate(odd_texts)), "doc_id int, text string"), model).collect()
    for row in got:
        shares = plain_grams(row.text)
        logits = [(sum(s * weight((b, m)) * idf(b) for b, s in shares.items() if b in df) + weight(("bias", m))) / model.temperature for m in names]
        p = [math.exp(v - max(logits)) for v in logits]
        assert row.lang_pred == names[p.index(max(p))] and row.score == pytest.approx(max(p) / sum(p), abs=1e-9)


def test_quality_is_scored_as_defined(spark, data):
    """Sizes by the dictionaries, piece by piece, and a calibration whose penalised loss is at its least."""
    import zstandard

    docs, labels = data
    model = quality.fit(docs, labels)

    def size(content, raw):
        given = zstandard.ZstdCompressionDict(content)
        one = lambda piece: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=given, write_content_size=False, write_dict_id=False, write_checksum=False).compress(piece))
        return sum(one(raw[k : k + quality.PIECE]) for k in range(0, max(1, len(raw)), quality.PIECE))

    def probability(text):
        raw = (text or "").encode()
        g, b = size(model.good, raw), size(model.bad, raw)
        x = [(b - g) / (b + g), g / (len(raw) + 1), b / (len(raw) + 1), math.log1p(len(raw))]
        x = [(min(max(v, lo), hi) - m) / s for v, lo, hi, m, s in zip(x, model.low, model.high, model.mean, model.scale)]
        terms = x + [x[i] * x[j] for i in range(4) for j in range(i, 4)]
        return 1 / (1 + math.exp(-sum(t * w for t, w in zip(terms, model.weights)) - model.weights[-1]))

    for table in (odd(spark).select("doc_id", "text"), docs.select("doc_id", "text").limit(40)):
        for row in quality.score(table, model).collect():
            assert row.score == pytest.approx(probability(row.text), abs=1e-9)
    rng = random.Random(5)
    features = [[rng.gauss(y, 1), rng.gauss(0, 1)] for y in (0, 1, 1) for _ in range(30)]
    marks = [y for y in (0, 1, 1) for _ in range(30)]

    def loss(w):
        share = {1: 60, 0: 30}
        each = sum(math.log1p(math.exp(-(2 * y - 1) * (x[0] * w[0] + x[1] * w[1] + w[2]))) / (2 * share[y]) for x, y in zip(features, marks))
        return each + 1e-3 / 2 * (w[0] ** 2 + w[1] ** 2)

    best = list(common.logistic(features, marks))
    assert all(loss(best) <= loss([v + d * (k == i) for i, v in enumerate(best)]) for k in range(3) for d in (-1e-3, 1e-3))


def test_toxicity_counts_every_labelled_text(spark):
    """Each labelled text is counted or calibrates, whole: a word of one text among thousands, and one far into a very long text, are in the models."""
    import pandas as pd

    n = 12_000
    texts = [f"word{i % 50} plain" for i in range(n)]
    texts[0], texts[1] = "q" * 3 + " plain", "plain " * 50_000 + "zjz"
    # ids whose texts are counted
    rows = spark.range(60_000).select("id", (common.fold("id", toxicity.FOLDS) != toxicity.HELD_OUT).alias("a"), (F.pmod(F.xxhash64("id"), F.lit(toxicity.CALIBRATION)) != 0).alias("b")).filter("a AND b").limit(n).collect()
    taken = [r.id for r in rows]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": taken, "text": texts}))
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": taken, "toxic": [i % 2 for i in range(n)]}))
    counts = toxicity.counted(docs.join(labels, "doc_id").select("text", F.col("toxic").cast("int").alias("label")))
    assert counts[0]["\x02qqq"] == 1 and counts[1]["\x02zjz"] == 1 and counts[0]["\x02plai"] == n // 2
    model, _ = toxicity.fit(docs, labels)
    assert "\x02qqq" in model.seen and "\x02zjz" in model.seen


def test_logistic_by_sums_is_that_of_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + rng.normal(size=400) > 0.5).astype(int)
    table = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    assert np.allclose(common.logistic_of(table, ["a", "b"], "y"), common.logistic(x, y), atol=1e-6)


def test_only_labelled_texts_move(spark):
    """Each label meets its whole text, whatever the ids' types; others are sorted out where they lie, and the join is one plan at every size."""
    rows = [(i, f"text {i}" if i % 7 else None) for i in range(2000)] + [(5, "text 5 again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 3000, 9)] + [(5, 0), (5, 1), (None, 1)], "s_id int, label int")
    allowed = labels.filter(common.fold("s_id", toxicity.FOLDS) != toxicity.HELD_OUT)
    kept = [tuple(r) for r in allowed.collect()]
    found = toxicity.learned_from(docs, allowed, len(kept))
    want = sorted((t or "", s, label) for s, label in kept for i, t in rows if i == s)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100
    joins = [line.strip(" :+-*()0123456789").split(" ")[0] for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
    assert joins == ["SortMergeJoin", "BroadcastHashJoin", "BroadcastHashJoin"]
    assert toxicity.learned_from(docs, allowed.limit(0), 0).count() == 0

"""SimHash fingerprints and their links against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from lantern.llm import simhash


def plain_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(marks, distance):
    """The first index of the component of each mark."""
    label = list(range(len(marks)))
    values = np.array(marks, np.uint64)
    for i in range(len(marks)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= distance):
            old, new = sorted((label[i], label[j]))[::-1]
            label = [new if x == old else x for x in label]
    return label


def test_fingerprints(spark):
    rng = random.Random(1)
    long = " ".join(rng.choices(["Alpha", "beta", "gÄmma", "d", "ÉCLAIR"], k=20_000))
    texts = [None, "", " \t\n", "one", "ONE two", "a b c d", "a  B\tc\vd", "a b c d e", "x" * 100_000, long, "a b c d " * 5000]
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id int, text string, fp string")
    got = {r.doc_id: r for r in simhash.report(docs).collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {len(r.fingerprint) for r in got.values()} == {16}
    assert [got[i].component_id for i in (0, 1, 2, 5, 6)] == [0, 0, 0, 5, 5]


@pytest.mark.parametrize(("bucket", "distance"), [(2048, 4), (20, 4), (2, 4), (5, 3), (5, 1)])
def test_links_against_brute_force(spark, monkeypatch, bucket, distance):
    """Dense balls around centres, chains of drifting marks and strangers, with buckets so small that every chain length is used."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket + distance)
    marks = {0, (1 << 64) - 1, 1 << 63, *(rng.getrandbits(64) for _ in range(300))}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            marks.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))))
        for _ in range(20):
            centre ^= sum(1 << b for b in rng.sample(range(64), distance))
            marks.add(centre)
    marks = sorted(marks)
    label = brute(marks, distance)
    nodes = spark.createDataFrame([(simhash.signed(m),) for m in marks], "fp long").repartition(3)
    found = simhash.components(simhash.links(nodes, distance)).collect()
    group = {r.node: r.component for r in found}
    groups = {}
    for m, first in zip(marks, label):
        groups.setdefault(first, set()).add(group.get(simhash.signed(m), simhash.signed(m)))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_every_pair_within_the_distance_meets_in_narrow_buckets():
    """Whatever bits differ, and whichever wider buckets were compared, a pair meets in some bucket of each kind that leads on."""
    rng = random.Random(5)
    kinds = [{k: (bits & (1 << 64) - 1, wider) for k, _, bits, wider in simhash.buckets(4, b)} for b in range(4)]
    assert [len(k) for k in kinds] == [16, 64, 352, 2240]
    for _ in range(300):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
        meets = [{k for k, (bits, _) in of.items() if not differ & bits} for of in kinds]
        lines = meets[3]
        for b in (3, 2, 1):
            lines = {kinds[b][k][1] for k in lines} & meets[b - 1]
        assert lines


def test_null_and_repeated_ids_and_empty_tables(spark):
    schema = "doc_id long, text string, component long"
    rows = [(None, "a b c d", 1), (7, "a b c d", 2), (7, "a b c d", 2), (None, "quite other words are here", 3), (3, None, 4), (5, "", 5)]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.report(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0), (0, 7), (3, 3), (5, 3), (7, 7), (7, 7)]
    assert simhash.report(spark.createDataFrame([], schema)).count() == 0

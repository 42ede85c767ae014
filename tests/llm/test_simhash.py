import random
import re

import pytest
import xxhash

from cartlens.llm import simhash
from cartlens.llm.components import connected_components


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprint(monkeypatch):
    rng = random.Random(1)
    words = ["The", "of", "ÉTÉ", "été", "and", "x", "thing", "\x85", "\xa0y"]
    for n in [0, 1, 2, 3, 4, 5, 30, 300, 700]:
        t = "".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t\x0b"]) for _ in range(n))
        assert simhash.fingerprint(t) == slow_fingerprint(t), n
    want = simhash.fingerprint(t)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(t) == want


@pytest.mark.parametrize("distance", [4, 3, 0])
def test_links_equal_brute_force(spark, distance):
    rng = random.Random(distance)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    fps = {0, 1, 3, (1 << 64) - 1}
    for radius, size in ((3, 150), (6, 60), (4, 20)):  # dense groups of near copies and strays
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rng.randint(0, radius)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = [signed(x) for x in fps]
    want = slow_components(fps, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= distance)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.fp: r.component for r in simhash.fingerprint_components(df, distance).collect()}
    assert got.keys() == want.keys()
    part = lambda m: sorted(sorted(x for x in m if m[x] == c) for c in set(m.values()))
    assert part(got) == part(want)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (200, 100)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90, 200: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_and_edge_cases(spark):
    t = "one two three four five six seven"
    rows = [(5, t, 1), (5, t, 1), (3, t.upper(), 2), (None, t, 3), (None, "solo words are here now", 4), (8, None, 5), (9, " ", 6), (10, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id or -1, r.component_id, r.stays) for r in simhash.near_duplicates(df).collect()), key=str)
    want = [(5, 3, False), (5, 3, False), (3, 3, True), (-1, 3, False), (-1, None, True), (8, 8, True), (9, 8, False), (10, 8, False)]
    assert got == sorted(want, key=str)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "8", "None"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_query(spark):
    from cartlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fp = {d: slow_fingerprint(t) for d, t in docs.items()}
    want = slow_components(sorted(docs), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    got = QUERIES["op8_simhash"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fp[d]:016x}", want[d]) for d in docs}

import hashlib
import random

import pytest

from cartlens.llm import runs
from cartlens.llm.queries import op13_periodic_runs, with_periods
from tests.conftest import SF001


def plain_runs(words):
    """Every stretch of equal words at every distance, kept where no smaller distance
    is a period of it."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(12, 2 * q):
                smaller = (p for p in range(1, q) if words[i : i + length - p] == words[i + p : i + length])
                if next(smaller, None) is None:
                    out.append((i, length, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, found):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]


def _text(r):
    out = []
    for _ in range(r.randint(0, 4)):
        some = "ab"[: r.randint(1, 2)] + "cdef"[: r.randint(0, 4)]
        out += [r.choice(some) for _ in range(r.randint(0, 6))] * r.randint(1, 9)
    return out[:90]


@pytest.mark.parametrize("late", [1000, 2])
def test_equals_brute_force(monkeypatch, late):
    monkeypatch.setattr(runs, "LATE", late)
    r = random.Random(late)
    for _ in range(500):
        texts = [_text(r) for _ in range(r.randint(0, 4))]
        found = runs.find_runs(texts)
        assert found == [plain_runs(t) for t in texts]
        for t, f in zip(texts, found, strict=True):
            assert runs.collapse(t, f) == plain_collapse(t, f)


def test_suffixes_and_shared_prefixes():
    r = random.Random(3)
    for _ in range(300):
        ids = [-1, *(r.randrange(3) for _ in range(r.randint(0, 40))), -2]
        import numpy as np

        order = runs.sorted_suffixes(np.array(ids)).tolist()
        assert order == sorted(range(len(ids)), key=lambda i: ids[i:])
        common = runs.shared_prefixes(ids, order)
        for a, b, shared in zip(order, order[1:], common[1:], strict=False):
            assert ids[a : a + shared] == ids[b : b + shared] and ids[a + shared : a + shared + 1] != ids[b + shared : b + shared + 1]


def test_fixed_cases():
    assert runs.find_runs([["a"] * 12, ["a"] * 11, [], list("abcabcabcabc"), list("abcabcabcab")]) == [[(0, 12, 1)], [], [], [(0, 12, 3)], []]
    assert runs.collapse(list("xabcabcabcabcy"), [(1, 12, 3)]) == list("xabcy")


def test_very_long_texts():
    assert runs.find_runs([["a"] * 200_000]) == [[(0, 200_000, 1)]]
    found = runs.find_runs([(["a"] * 300 + ["b"]) * 300])[0]
    assert len(found) == 301 and (0, 300 * 301, 301) in found


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (2, "a " * 20, 9), (2, "a " * 20, 9), (None, "x\x1cy z\xa0", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted((r.doc_id or -1, r.n_words, len(r.runs), r.collapsed) for r in runs.periodic_runs(docs).collect())
    assert got == [(-1, 2, 0, "x\x1cy z\xa0"), (1, 0, 0, ""), (2, 0, 0, ""), (2, 20, 1, "a"), (2, 20, 1, "a")]
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_planted_periods_follow_their_rule():
    planted = 0
    for doc_id in range(200):
        words = [b"%d" % i for i in range(50)]
        out = with_periods(doc_id, words)
        if out == words:
            continue
        planted += 1
        start = next(i for i in range(50) if out[i] != words[i])
        period = start - words.index(out[start])
        assert all(out[i] == out[i - period] for i in range(start, 50))
    assert 10 <= planted <= 30


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    found = {r.doc_id: r for r in op13_periodic_runs(spark, SF001).collect()}
    assert sorted(found) == sorted(docs)

    def sha(x):
        return hashlib.sha256(x).hexdigest()

    some = 0
    for doc_id, text in docs.items():
        row, words = found[doc_id], with_periods(doc_id, text.encode().split())
        if len(words) > 1500:  # brute force is quadratic and more
            continue
        want = plain_runs(words)
        some += bool(want)
        assert row.n_runs == len(want)
        assert row.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in want).encode())
        assert row.collapsed_sha256 == sha(b" ".join(plain_collapse(words, want)))
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None, None, None)
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (1000 * best[1] // best[2] if want else None)
    assert some > 5

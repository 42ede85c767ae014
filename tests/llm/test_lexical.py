import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from cartlens.llm import lexical
from cartlens.llm.queries import op12_lexical
from tests.conftest import SF001

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_search(docs, queries, k=10):
    """Every score of every document, sorted; ``docs`` and ``queries`` are (id, text)."""
    counted = [(d, Counter(_TERM.findall(_fold(t or "")))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in queries:
        asked, scored = set(_TERM.findall(_fold(text or ""))), []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def _rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=lambda r: (str(r[0]), r[1], r[3], str(r[2])))


def _same(got, want):
    return got == sorted(want, key=lambda r: (str(r[0]), r[1], r[3], str(r[2])))


def test_terms():
    text = "Ça va-t-il? ÀB 12a_b\x00C\x7fd"
    assert [t.decode() for t in lexical.terms_of_text(text)] == _TERM.findall(_fold(text))
    every = "".join(map(chr, range(0x180)))
    assert [t.decode() for t in lexical.terms_of_text(every)] == _TERM.findall(_fold(every))


@pytest.mark.parametrize("first_read", [1, 3, 64])
def test_nra_finds_the_best_and_their_ties(monkeypatch, first_read):
    monkeypatch.setattr(lexical, "FIRST_READ", first_read)
    r = random.Random(first_read)
    for _ in range(400):
        documents, k = r.randint(1, 30), r.randint(1, 6)
        lists, score = [], np.zeros(documents, dtype=np.int64)
        for _ in range(r.randint(1, 5)):
            docs = np.array(r.sample(range(documents), r.randint(1, documents)))
            impacts = np.sort(np.array([r.randint(0, r.choice([2, 50])) for _ in docs]))[::-1]
            lists.append((docs, impacts))
            score[docs] += impacts
        least = r.choice([0, 0, 3, 40])
        bar = max(least, 1, sorted(score, reverse=True)[k - 1] if documents >= k else 0)
        found = {d: s for d, s in lexical.nra(lists, documents, k, least).tolist()}
        assert found == {d: s for d, s in enumerate(score.tolist()) if s >= bar}


def test_nra_leaves_lists_unread():
    """A strong document decides, so that the tail of a long list is never asked for."""
    impacts = np.concatenate([[10_000], np.arange(5000, 0, -1)])
    docs = np.arange(5001)
    strong = (np.array([0]), np.array([50_000]))
    read = []

    class Docs:
        def __len__(self):
            return len(docs)

        def __getitem__(self, part):
            read.append(part.stop)
            return docs[part]

    found = lexical.nra([strong, (Docs(), impacts)], 5001, 1, 0)
    assert found.tolist() == [[0, 60_000]] and max(read) <= lexical.FIRST_READ


@pytest.mark.parametrize("limits", [{}, {"SHARD_DOCS": 3}, {"SHARD_POSTINGS": 4}, {"BLOCK_QUERIES": 2}, {"BLOCK_TERMS": 5}, {"SHARD_CELLS": 8}])
def test_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    r = random.Random(len(str(limits)))
    words = ["a", "b", "The", "the", "é", "x1", "y", "z", "long", "ß"]
    docs = [(i // 2 if i % 9 else None, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(60)]
    docs += [(7, None), (8, ""), (9, "a a a a"), (9, "a a a a"), (10, "b " * 3000), (10, "?!")]
    queries = [(1, "a b"), (2, "THE é é"), (2, "x1 y z long ß unknown"), (None, "a"), (3, None), (4, ""), (5, "unknown"), (1, "a b")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("SCORE", lexical.F.lit(1)).repartition(4)
    q = spark.createDataFrame(queries, "item_id long, text string")
    assert _same(_rows(lexical.search(lexical.stored(d), q, 4)), plain_search(docs, queries, 4))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), queries).collect() == []
    assert lexical.search(docs, queries.limit(0)).collect() == []
    same = spark.createDataFrame([(i, "a") for i in range(3000)], "doc_id long, text string")
    assert lexical.search(same, queries).collect() == []  # a term in all documents is of no weight
    with pytest.raises(ValueError):
        lexical.search(docs, queries, 0)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    queries = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    assert _same(_rows(op12_lexical(spark, SF001)), plain_search(docs, queries))

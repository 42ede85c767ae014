"""What grew faster than the input: partitions, blocks, candidates, copies of rows."""

import random
import re

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cartlens.operators import ranking, recommend, segment
from cartlens.operators.recommend import normal_equation_residuals, popular_items_per_fold
from cartlens.operators.vectors import user_item_vectors


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_of_a_fit_grow_slower_than_the_rows():
    assert [segment.fit_partitions(n) for n in (0, 1, 10_000, 10_001, 240_000)] == [1, 1, 1, 2, 24]
    assert segment.fit_partitions(600_000) == 24 and segment.fit_partitions(6_000_000) == 30


def test_blocks_of_a_fit_grow_slower_than_the_ratings():
    class Counted:
        def __init__(self, n):
            self.n = n

        def count(self):
            return self.n

    blocks = [recommend.als_blocks(Counted(n)) for n in (0, 500_000, 500_001, 4_000_000, 36_000_000, 320_000_001)]
    assert blocks == [1, 1, 2, 8, 8, 11]


def test_groups_are_dealt_whole_unless_large(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(None if g == 9 else g, rnd.randint(0, 9), None if i % 7 == 0 else float(i % 5)) for g in range(12) for i in range(90 if g in (2, 9) else 6)]
    rows += [(2, 4, 1.0)] * 20
    df = spark.createDataFrame(rows, "g int, item int, qty double").repartition(5)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    expected, seen = [], {}
    ordered = sorted(rows, key=key)
    for r in ordered:
        expected.append((*r, seen.setdefault(r[0], 0), sum(x[0] == r[0] for x in rows)))
        seen[r[0]] += 1
    plain = ranking.rank_within_groups(df, ["g"], ["item"], size_col="n")
    assert "__rk_part" not in _plan(plain) and "rangepartitioning" not in _plan(plain)
    monkeypatch.setattr(ranking, "ROWS_PER_PARTITION", 250)
    mixed = ranking.rank_within_groups(df, ["g"], ["item"], size_col="n")
    assert "__rk_part" in _plan(mixed)
    for found in (plain, mixed):
        assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


def test_only_items_that_can_be_listed_meet_the_folds(spark):
    rnd = random.Random(5)
    rows = [(s, f, i, rnd.choice([-2.0, 0.0, 1.0, 3.0]) * (1 + i % 4)) for s in (1, 2) for i in range(60) for f in range(4) if rnd.random() < 0.6]
    rows += [(3, 0, 1, 5.0), (3, 1, 2, None), (3, 0, 3, 4.0), (3, 2, 3, 1.0)]
    df = spark.createDataFrame(rows, "s int, fold int, item_id int, qty double")

    def plainly(own, n):
        out = []
        for fold in range(4):
            train = {}
            for f, i, q in own:
                if f != fold:
                    train.setdefault(i, []).append(q)
            scores = {}
            for i, found in train.items():
                known = [q for q in (q for f, j, q in own if j == i) if q is not None]
                scores[i] = sum(q for q in found if q is not None) if known else None
            best = sorted(scores, key=lambda i: (scores[i] is None, -(scores[i] or 0), i))[:n]
            out += [(fold, r, i, scores[i]) for r, i in enumerate(best)]
        return sorted(out)

    for n in (3, 200):
        found = popular_items_per_fold(df, n, 4, scope_cols=("s",)).collect()
        for s in (1, 2, 3):
            assert sorted((r.fold, r["rank"], r.item_id, r.score) for r in found if r.s == s) == plainly([r[1:] for r in rows if r[0] == s], n)
        found = popular_items_per_fold(df.where("s = 1"), n, 4).collect()
        assert sorted((r.fold, r["rank"], r.item_id, r.score) for r in found) == plainly([r[1:] for r in rows if r[0] == 1], n)


def test_short_vectors_hold_every_position(spark):
    cells = spark.createDataFrame([(1, 0, 2.0), (1, 4, 1.0), (1, 4, 1.5), (2, 3, 7.0), (3, 9, 1.0), (4, 2, None)], "user_id int, item_idx int, qty double")
    found = user_item_vectors(cells, 5, sparse=False)
    assert "map_from_entries" not in _plan(found)
    held = {r.user_id: list(r.x) for r in found.select("user_id", vector_to_array(F.col("features")).alias("x")).collect()}
    assert held == {1: [2.0, 0, 0, 0, 2.5], 2: [0, 0, 0, 7.0, 0], 3: [0.0] * 5, 4: [0.0] * 5}


def test_factors_travel_as_single_precision(spark):
    users = spark.createDataFrame([(1, [0.5, 0.25])], "user_id int, features array<float>")
    items = spark.createDataFrame([(7, [1.0, 2.0]), (8, [0.5, -1.0])], "item_id int, features array<float>")
    ratings = spark.createDataFrame([(1, 7, 2.0), (1, 8, 0.0)], "user_id int, item_id int, qty double")
    found = normal_equation_residuals(users, items, ratings, rank=2, reg_param=0.1)
    assert not re.search(r"cast\(features#\d+ as array<double>\)", _plan(found))
    # A x - b by hand: Gram [[1.25, 1.5], [1.5, 5]], the first item with c = 2, n = 1
    x, y = (0.5, 0.25), (1.0, 2.0)
    dot = x[0] * y[0] + x[1] * y[1]
    a = [1.25 * x[0] + 1.5 * x[1] + 2 * dot * y[0] + 0.1 * x[0], 1.5 * x[0] + 5 * x[1] + 2 * dot * y[1] + 0.1 * x[1]]
    expected = max(abs(a[0] - 3 * y[0]), abs(a[1] - 3 * y[1])) / 6
    assert abs(found.first().residual - expected) < 1e-12

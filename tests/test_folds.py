from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartlens.operators.folds import assign_folds, fold_of, fold_test, fold_train


def _sizes(n, folds=10):
    q, r = divmod(n, folds)
    return [q] * (folds - r) + [q + 1] * r


def _fold_sizes(spark, n):
    df = spark.createDataFrame([(1, i, 1.0) for i in range(n)], "user_id long, item_id long, qty double")
    got = assign_folds(df).groupBy("fold").count().collect()
    return [c for _, c in sorted((r["fold"], r["count"]) for r in got)]


def test_golden_fold_sizes(spark):
    assert _fold_sizes(spark, 23) == [2] * 7 + [3] * 3
    assert _fold_sizes(spark, 10) == [1] * 10
    assert _fold_sizes(spark, 19) == [1] + [2] * 9
    assert _fold_sizes(spark, 20) == [2] * 10


def test_folds_are_consecutive_in_item_order(spark):
    df = spark.createDataFrame([(1, i * 3, 1.0) for i in range(23)], "user_id long, item_id long, qty double")
    rows = sorted((r["item_id"], r["fold"]) for r in assign_folds(df).collect())
    folds = [f for _, f in rows]
    assert folds == sorted(folds)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=10, max_value=200), min_size=1, max_size=6))
def test_formula_matches_closed_form(spark, ns):
    rows = [(n, p) for n in ns for p in range(n)]
    df = spark.createDataFrame(rows, "n long, p long").select("n", fold_of(F.col("p"), F.col("n")).alias("f"))
    counts = {}
    for r in df.collect():
        counts.setdefault(r["n"], {}).setdefault(r["f"], 0)
        counts[r["n"]][r["f"]] += 1
    for n, c in counts.items():
        per_list = ns.count(n)
        assert [c.get(i, 0) // per_list for i in range(10)] == _sizes(n)


def test_fold_formula_exhaustive_small(spark):
    rows = [(n, p) for n in range(10, 61) for p in range(n)]
    df = spark.createDataFrame(rows, "n long, p long").select("n", "p", fold_of(F.col("p"), F.col("n")).alias("f"))
    got = {}
    for r in df.collect():
        got.setdefault(r["n"], [0] * 10)[r["f"]] += 1
    for n in range(10, 61):
        assert got[n] == _sizes(n), n


def test_train_test_partition_input(spark):
    from cartlens.operators.ratings import filter_active_users
    from cartlens.operators.relations import load_ratings

    from .conftest import SF001

    folded = assign_folds(filter_active_users(load_ratings(spark, SF001)))
    total = folded.count()
    for b in (0, 9):
        tr, te = fold_train(folded, b), fold_test(folded, b)
        assert tr.count() + te.count() == total
        assert tr.join(te, ["user_id", "item_id"]).count() == 0
    assert folded.select("fold").distinct().count() == 10

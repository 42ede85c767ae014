from pyspark.sql import functions as F

from cartlens.operators.ratings import (
    best_seller_ratings,
    cluster_sizes,
    filter_active_users,
    index_items,
    top_share_items,
)
from cartlens.operators.relations import load_ratings
from cartlens.operators.vectors import fill_missing_zero, pivot_wide, row_to_key_and_array

from .conftest import SF001

SCHEMA = "user_id long, item_id long, qty double"


def test_active_filter_golden(spark):
    rows = [(1, i, 1.0) for i in range(9)] + [(2, i, 1.0) for i in range(10)]
    kept = filter_active_users(spark.createDataFrame(rows, SCHEMA)).select("user_id").distinct().collect()
    assert [r[0] for r in kept] == [2]


def test_filter_order_best_sellers_first(spark):
    # user 1: 12 rows, 5 on items outside the best sellers -> 7 left -> dropped
    rows = [(1, i, 1.0) for i in range(7)] + [(1, 100 + i, 1.0) for i in range(5)]
    # user 2 makes items 0..6 best sellers; items 100.. sell little
    rows += [(2, i, 50.0) for i in range(7)] + [(2, 200 + i, 10.0) for i in range(7)]
    # catalogue: 7 + 5 + 7 = 19 items -> best sellers = 9 (floor 9.5)
    out = best_seller_ratings(spark.createDataFrame(rows, SCHEMA))
    assert out.where(F.col("user_id") == 1).count() == 0


def test_best_seller_share_floor_and_ties(spark):
    rows = [(1, 5, 3.0), (1, 4, 3.0), (1, 3, 3.0), (1, 2, 1.0), (1, 1, 9.0)]
    top = top_share_items(spark.createDataFrame(rows, SCHEMA), 0.5).orderBy("sales_rank").collect()
    assert [(r["item_id"], r["sales_rank"]) for r in top] == [(1, 0), (3, 1)]  # floor(2.5)=2, tie broken by id


def test_index_items_dense_and_ordered(spark):
    df = spark.createDataFrame([(1, 900, 1.0), (2, 5, 1.0), (3, 900, 2.0), (4, -3, 1.0)], SCHEMA)
    got = sorted((r["item_id"], r["item_idx"]) for r in index_items(df).collect())
    assert got == [(-3, 0), (5, 1), (900, 2)]


def test_pivot_golden(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (2, "c", 3.0)], "user_id long, item string, qty double")
    wide = pivot_wide(df, "user_id", "item", "qty")
    assert wide.columns == ["user_id", "a", "b", "c"]
    rows = {r["user_id"]: (r["a"], r["b"], r["c"]) for r in wide.collect()}
    assert rows == {1: (1.0, 2.0, None), 2: (None, None, 3.0)}
    filled = fill_missing_zero(wide, ["a", "b", "c"])
    arr = {r["user_id"]: r["values"] for r in row_to_key_and_array(filled, "user_id").collect()}
    assert arr == {1: [1.0, 2.0, 0.0], 2: [0.0, 0.0, 3.0]}


def test_pivot_with_explicit_values(spark):
    df = spark.createDataFrame([(1, 2, 2.0), (1, 1, 1.0)], "user_id long, item int, qty double")
    wide = pivot_wide(df, "user_id", "item", "qty", values=[2, 1, 3])
    assert wide.columns == ["user_id", "1", "2", "3"]


def test_ratings_relation_facts(spark):
    r = load_ratings(spark, SF001)
    assert r.count() == 5382
    assert r.select("user_id").distinct().count() == 150
    assert r.groupBy("user_id", "item_id").count().where("count > 1").count() == 0
    small = r.groupBy("user_id").count().where("count < 10").count()
    assert small == 2


def test_cluster_sizes(spark):
    clusters = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (0, 2)], "cluster_number int, user_id long")
    got = sorted(tuple(r) for r in cluster_sizes(clusters).collect())
    assert got == [(0, 2, 2), (1, 1, 2)]

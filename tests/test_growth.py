"""What a task holds doesn't grow with the input; lists stay arrays; shelves instead of blocks."""

import re

import numpy as np

from cartlens.operators import ranking
from cartlens.operators.lists import user_ratings_list
from cartlens.operators.nearest import nearest_in_blocks, nearest_rows
from cartlens.operators.ranking import rank_within_groups


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_PARTITION", 10)
    df = spark.range(237).selectExpr("id % 5 user_id", "id item_id", "1.0 qty")
    ranked = rank_within_groups(df, ["user_id"], ["item_id"])
    assert re.search(r"hashpartitioning\(__rk_part.*, 24\)", _plan(ranked))
    assert {(r.user_id, r["rank"], r.item_id) for r in ranked.collect()} == {(i % 5, i // 5, i) for i in range(237)}
    lists = user_ratings_list(df, 10)
    assert re.search(r"hashpartitioning\(user_id.*, chunk.*, 24\)", _plan(lists))
    assert sum(len(r.ratings) for r in lists.collect()) == 237


def test_scores_from_lists_never_held_as_rows(spark, tmp_path):
    """The popular and own lists reach the metrics without being exploded and gathered again."""
    from cartlens.plans import queries as q

    li = spark.range(600).selectExpr("id l_orderkey", "id % 37 l_partkey", "1.0 l_quantity")
    orders = spark.range(600).selectExpr("id o_orderkey", "id % 15 o_custkey")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = q.q_precision_recall_at_k(spark, str(tmp_path))
    assert "posexplode" not in _plan(found)
    plan = _plan(q.q_own_history_scores(spark, str(tmp_path)))
    assert not re.search(r"collect_list\(.*\n.*keys=\[fold", plan) and "keys=[fold#" not in "".join(x for x in plan.split("\n") if "collect_list" in x)
    assert found.count() == 70


def test_a_point_travels_to_shelves_not_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cartlens.operators import nearest

    met, plain = [], nearest._best

    def counted(points, *rest):
        met.append(points.count())
        return plain(points, *rest)

    monkeypatch.setattr(nearest, "_best", counted)
    c = spark.range(200).select(F.col("id").alias("cluster"), F.array(F.cos("id"), F.sin("id")).alias("centroid"))
    p = spark.range(30).select("id", F.array(F.cos("id") * 3, F.sin("id")).alias("vector"))
    for distance in ("euclidean", "cosine"):
        assert nearest_in_blocks(p, c, distance, "id", "vector", "cluster", 2).count() == 30
    assert met == [30, 30, 30]  # 100 blocks, one shelf


def test_known_distance_bounds_the_search():
    r = np.random.default_rng(8)
    x, c = r.normal(size=(90, 5)), np.repeat(r.normal(size=(400, 5)), 2, axis=0)
    away = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    at, d = nearest_rows(x, c, "euclidean", away.min(axis=1))
    assert (at == away.argmin(axis=1)).all()
    at, _ = nearest_rows(x, c, "euclidean", away.min(axis=1) * 0.5)
    assert (at == -1).all()

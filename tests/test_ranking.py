import random

import pandas as pd
from pyspark.sql import functions as F

from cartlens.operators.ranking import global_position, rank_within_groups, top_n_per_group


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = 0 if i % 3 == 0 else rnd.randint(1, 60)  # group 0 holds a third of the rows
        rows.append((g, rnd.randint(0, 400), float(rnd.randint(1, 5))))
    rows += [(0, 5, 1.0)] * 50  # a run of fully identical rows inside the hot group
    rows += [(None, 3, 2.0), (None, 1, 2.0)]  # NULL group key
    return spark.createDataFrame(rows, "g int, item int, qty double").repartition(7)


def test_rank_within_groups_matches_brute_force(spark):
    df = _skewed(spark)
    got = rank_within_groups(df, ["g"], ["item"], rank_col="rank", size_col="n").toPandas()
    pdf = df.toPandas()
    pdf["g2"] = pdf["g"].fillna(-1)
    pdf = pdf.sort_values(["g2", "item", "qty"], kind="mergesort")
    pdf["rank"] = pdf.groupby("g2").cumcount()
    pdf["n"] = pdf.groupby("g2")["item"].transform("size")
    key = ["g", "item", "qty", "rank", "n"]
    a = got[key].fillna(-1).sort_values(key).reset_index(drop=True).astype(float)
    b = pdf[key].fillna(-1).sort_values(key).reset_index(drop=True).astype(float)
    pd.testing.assert_frame_equal(a, b)


def test_rank_spreads_hot_group(spark):
    df = _skewed(spark, n=6000)
    ranked = rank_within_groups(df, ["g"], ["item"])
    # ranks of the hot group are a permutation of 0..n-1
    hot = ranked.where(F.col("g") == 0).agg(F.min("rank"), F.max("rank"), F.count("*"), F.countDistinct("rank")).first()
    assert hot[0] == 0 and hot[1] == hot[2] - 1 and hot[3] == hot[2]


def test_global_position(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(5)
    pos = global_position(df, [F.col("v").desc()], "pos").collect()
    assert sorted((r["pos"], r["v"]) for r in pos) == [(i, 4999 - i) for i in range(5000)]


def test_top_n_per_group_plan_and_result(spark):
    df = _skewed(spark).where(F.col("g").isNotNull())
    top = top_n_per_group(df, ["g"], [F.col("qty").desc(), F.col("item").asc()], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    pdf = df.toPandas().sort_values(["g", "qty", "item"], ascending=[True, False, True], kind="mergesort")
    exp = pdf.groupby("g").head(3)
    got = top.toPandas()
    assert len(got) == len(exp)
    assert sorted(map(tuple, got[["g", "item", "qty"]].values.tolist())) == sorted(
        map(tuple, exp[["g", "item", "qty"]].values.tolist())
    )


def test_rank_with_a_third_of_rows_identical(spark):
    rows = [(1, 7, 2.0)] * 1500 + [(1, i, 1.0) for i in range(1500)] + [(2, i % 40, 1.0) for i in range(1500)]
    df = spark.createDataFrame(rows, "g int, item int, qty double").repartition(6)
    got = rank_within_groups(df, ["g"], ["item"], size_col="n").collect()
    assert len(got) == len(rows)
    by_g = {}
    for r in got:
        by_g.setdefault(r["g"], []).append((r["rank"], r["item"], r["qty"], r["n"]))
    for g, lst in by_g.items():
        lst.sort()
        assert [x[0] for x in lst] == list(range(len(lst)))  # a permutation of 0..n-1
        assert all(x[3] == len(lst) for x in lst)
        items = [(x[1], x[2]) for x in lst]
        assert items == sorted(items)  # ranks follow (item, qty) order
    # the copies occupy one contiguous block of positions
    hot = sorted(r["rank"] for r in got if r["g"] == 1 and r["item"] == 7 and r["qty"] == 2.0)
    assert hot == list(range(hot[0], hot[0] + 1500))


def test_hot_user_is_spread_over_partitions(spark):
    """A user with a third of the rows must not land in one sorted partition."""
    from pyspark.sql import functions as F

    from cartlens.operators.ranking import sorted_distinct_rows

    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500 + 1).alias("user_id"),
        (F.col("id") * 7 % 9973).alias("item_id"),
        F.col("id").cast("double").alias("qty"),
    )
    prev = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keep the 8 range partitions visible
    try:
        tagged = sorted_distinct_rows(df, [F.col("user_id"), F.col("item_id"), F.col("qty")], F.struct("user_id"))
        per_part = {r["__rk_part"]: (r["rows"], r["hot"]) for r in tagged.groupBy("__rk_part").agg(
            F.sum("__rk_mult").alias("rows"), F.sum(F.when(F.col("user_id") == 0, F.col("__rk_mult"))).alias("hot")
        ).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", prev)
    hot_parts = [p for p, (_, hot) in per_part.items() if hot]
    assert len(hot_parts) >= 2, per_part
    assert max(rows for rows, _ in per_part.values()) <= 0.25 * n, per_part

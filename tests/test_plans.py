import os

from pyspark.sql import functions as F

from cartlens.operators.relations import load_ratings
from cartlens.plans.cv import evaluate_cv, evaluate_cv_by_cluster
from cartlens.plans.segmentation import customer_vectors, evaluate_within_segments, write_segments
from cartlens.operators.segment import segment_users
from cartlens.plans.rules import basket_rules_report, write_rules_report
from cartlens.plans.wide_table import write_wide_table
from cartlens.sources import read_cluster_assignments
from cartlens.operators import baskets as bk

from .conftest import SF001


def test_segments_file_feeds_clustered_evaluation(spark, tmp_dir):
    ratings = load_ratings(spark, SF001)
    feats = customer_vectors(spark, SF001, "p_brand")
    segs = segment_users(feats, [3], "cosine", seed=5)
    path = os.path.join(tmp_dir, "clusters-k-3")
    write_segments(segs, path, 3, single_file=True)
    clusters = read_cluster_assignments(spark, path)
    assert clusters.count() == feats.count()
    scores, summary = evaluate_cv_by_cluster(ratings, clusters, recommender="popular")
    rows = summary.collect()
    assert {r["cluster_number"] for r in rows} <= {0, 1, 2}
    assert all(r["n_folds"] == 10 for r in rows)
    _, direct = evaluate_within_segments(ratings, feats, 3, seed=5, recommender="popular")
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rounded(summary) == rounded(direct)


def test_als_cv_by_cluster_runs_in_parallel(spark):
    ratings = load_ratings(spark, SF001)
    clusters = ratings.select("user_id").distinct().select((F.col("user_id") % 2).cast("int").alias("cluster_number"), "user_id")
    scores, summary = evaluate_cv_by_cluster(ratings, clusters, recommender="als", parallelism=4, als_params={"max_iter": 2, "rank": 4})
    got = scores.collect()
    assert len(got) == 2 * 10 * 7
    assert all(0 <= r["precision"] <= 1 and 0 <= r["recall"] <= 1 for r in got)
    assert all(r["n_rec"] <= r["k"] * 1000 for r in got)


def test_report_writers(spark, tmp_dir):
    report = basket_rules_report(spark, SF001, "p_type")
    out = os.path.join(tmp_dir, "rules")
    write_rules_report(report, out, single_file=True)
    back = spark.read.option("sep", ";").option("header", True).csv(out)
    assert back.columns == list(bk.REPORT_COLUMNS)
    assert back.count() == report.count()
    wide = os.path.join(tmp_dir, "wide")
    small = load_ratings(spark, SF001).where(F.col("item_id") < 20)
    write_wide_table(small, wide, single_file=True)
    back = spark.read.option("sep", ";").option("header", True).csv(wide)
    assert back.columns[0] == "user_id" and len(back.columns) == 1 + small.select("item_id").distinct().count()


def test_rules_report_order(spark, tmp_dir):
    report = basket_rules_report(spark, SF001, "p_type")
    out = os.path.join(tmp_dir, "rules-ordered")
    write_rules_report(report, out, single_file=True)
    import glob

    lines = open(glob.glob(os.path.join(out, "part-*"))[0]).read().splitlines()[1:]
    rows = [ln.split(";") for ln in lines]
    first = [r for r in rows if r[0] == rows[0][0]]
    kinds = [r[1] for r in first]
    assert kinds == sorted(kinds)  # itemsets, then rules
    freqs = [int(r[4]) for r in first if r[1] == bk.ITEMSET_LABEL]
    confs = [float(r[4]) for r in first if r[1] == bk.RULE_LABEL]
    assert freqs == sorted(freqs, reverse=True) and confs == sorted(confs, reverse=True)


def test_user_in_two_clusters_counts_in_each(spark):
    from cartlens.plans.cv import prepare_folds

    # user 1: six rows in either cluster (active in none); user 2: twelve in one
    rows = [(c, 1, 100 * c + i, 1.0) for c in (0, 1) for i in range(6)] + [(0, 2, i, 1.0) for i in range(12)]
    rows += [(1, 3, i, 1.0) for i in range(10)] + [(0, 3, i, 1.0) for i in range(11)]
    scoped = spark.createDataFrame(rows, "cluster_number int, user_id long, item_id long, qty double")
    folded = prepare_folds(scoped, scope_col="cluster_number")
    got = {(r["cluster_number"], r["user_id"]): (r["n"], r["f"]) for r in folded.groupBy("cluster_number", "user_id").agg(F.count("*").alias("n"), F.countDistinct("fold").alias("f")).collect()}
    assert got == {(0, 2): (12, 10), (1, 3): (10, 10), (0, 3): (11, 10)}
    assert prepare_folds(scoped).where("user_id = 1").count() == 12


def test_stored_tables_prune_partitions(spark):
    from cartlens.session import store

    df = store(spark.range(100).selectExpr("id", "cast(id % 5 as int) as fold"), partition_by=["fold"])
    assert df.columns == ["id", "fold"] and dict(df.dtypes)["fold"] == "int"
    plan = df.where("fold != 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan and df.where("fold != 2").count() == 80


def test_als_within_segment_files(spark):
    """Segments of two sizes, through their files: every cluster with active users is
    evaluated, and a fit leaves no cached factors behind."""
    from cartlens.operators.ratings import filter_active_users
    from cartlens.operators.relations import load_ratings
    from cartlens.plans.segmentation import evaluate_within_segment_files

    ratings, vectors = load_ratings(spark, SF001), customer_vectors(spark, SF001, "p_brand")
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    found = evaluate_within_segment_files(ratings, vectors, [2, 3], recommender="als", n_folds=2, als_params={"max_iter": 1}).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    per = {}
    for r in found:
        per.setdefault(r.n_segments, set()).add(r.cluster_number)
        assert r.n_folds == 2
    assert len(per[2]) == 2 and len(per[3]) == 3
    popular = evaluate_within_segment_files(ratings, vectors, [2], recommender="popular").collect()
    assert {r.cluster_number for r in popular} == per[2] and filter_active_users(ratings).count() > 0


def test_answers_do_not_hang_on_fits_at_a_time(spark):
    from cartlens.operators.relations import load_ratings
    from cartlens.operators.segment import kmeans_cost_curve

    ratings = load_ratings(spark, SF001)
    scores = [sorted(map(tuple, evaluate_cv(ratings, n_folds=2, parallelism=n, als_params={"max_iter": 2})[0].collect())) for n in (1, 4)]
    assert scores[0] == scores[1]
    vectors = customer_vectors(spark, SF001, "p_brand")
    curves = [sorted(map(tuple, kmeans_cost_curve(vectors, [2, 3, 4], parallelism=n).collect())) for n in (1, 3)]
    assert curves[0] == curves[1]


def test_small_fits_run_more_at_a_time():
    from cartlens.plans.cv import fits_at_a_time

    assert [fits_at_a_time(n) for n in (0, 100_000, 3_000_000, 30_000_000)] == [24, 24, 10, 8]


def test_als_scores_read_a_models_lists_once(spark, monkeypatch):
    from cartlens.plans import cv

    stored, store = [], cv.store
    monkeypatch.setattr(cv, "store", lambda df, partition_by=(): stored.append(df.columns) or store(df, partition_by))
    folded = cv.prepare_folds(load_ratings(spark, SF001), n_folds=2)
    scores = cv.als_fold_scores(folded, n_folds=2, ks=(5,), als_params={"max_iter": 1, "rank": 2})
    assert sum("items" in columns for columns in stored) == 2 and scores.count() == 2


def test_large_fits_hold_a_bounded_number_of_rows():
    from cartlens.operators.recommend import checkpoint_interval, fit_blocks
    from cartlens.plans.cv import blocks_beside_others, fits_in_flight

    assert [fits_in_flight(n) for n in (0, 500_000, 3_000_000, 6_500_000, 32_000_000, 200_000_000)] == [24, 24, 24, 12, 2, 1]
    assert [blocks_beside_others(n) for n in (0, 4_000_000, 4_000_001, 32_000_000, 200_000_000)] == [1, 1, 2, 8, 13]
    assert [fit_blocks(n) for n in (0, 500_001, 32_000_000, 200_000_000)] == [1, 2, 8, 13]
    assert [checkpoint_interval(n) for n in (0, 4_000_000, 4_000_001)] == [10, 10, 1]


def test_als_scores_leave_no_lists_and_drop_shuffles(spark, monkeypatch):
    from cartlens.plans import cv

    from cartlens.session import discard

    lists, sweeps = [], []
    monkeypatch.setattr(cv, "ROWS_TO_A_SWEEP", 1)
    monkeypatch.setattr(cv, "discard", lambda df: lists.append(os.path.dirname(df.inputFiles()[0].removeprefix("file:"))) or discard(df))
    monkeypatch.setattr(cv, "free_unused", sweeps.append)
    folded = cv.prepare_folds(load_ratings(spark, SF001), n_folds=2)
    assert cv.als_fold_scores(folded, n_folds=2, ks=(5,), als_params={"max_iter": 1, "rank": 2}).count() == 2
    assert len(lists) == 2 and not any(map(os.path.exists, lists)) and len(sweeps) == 2
    assert folded.count() > 0  # other stored tables stay


def test_factors_are_checkpointed_in_each_iteration_of_a_large_fit(spark, monkeypatch):
    from cartlens.operators import recommend

    rows = [(u, (7 * u + i) % 40, 1.0 + i % 3) for u in range(30) for i in range(12)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, qty double")
    plain = {r.id: list(r.features) for r in recommend.fit_implicit_als(ratings, num_blocks=2).userFactors.collect()}
    monkeypatch.setattr(recommend, "SMALL_FIT", 100)
    asked, als = [], recommend.ALS
    monkeypatch.setattr(recommend, "ALS", lambda **given: asked.append(given["checkpointInterval"]) or als(**given))
    found = {r.id: list(r.features) for r in recommend.fit_implicit_als(ratings, num_blocks=2).userFactors.collect()}
    assert asked == [1] and found == plain


def test_recommendations_hold_no_fit(spark):
    from cartlens.operators.recommend import recommend_top_n

    rows = [(u, (7 * u + i) % 40, 1.0 + i % 3) for u in range(30) for i in range(12)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, qty double")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    found = recommend_top_n(ratings, 5)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before and found.count() == 150

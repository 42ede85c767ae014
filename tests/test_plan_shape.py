"""Physical-plan guards: no cross joins anywhere, pruned scans, partial top-N."""

import pytest

from .conftest import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")
# Spark ML's recommendForAllUsers crosses blocks of user and item *factors*
# (a blocked matrix product; only the top-k per user and block leaves each
# block).  Exact top-N over the catalogue needs every score; no pair rows are
# emitted.  This is the one allowed cross product.
ALLOWED = {"als_recommendations": {"CartesianProduct"}}
# These run all their fits while they are built; tests below look at one fit.
MODEL_FITS = {
    "als_cv_summary",
    "als_cv_summary_top_sellers",
    "als_cv_summary_by_segment",
    "als_cv_counts",
    "cv_summary_within_segments",
    "kmeans_cost_curve_cosine",
    "kmeans_cost_curve_euclidean",
    "kmeans_cost_curve_items",
    "segment_users",
    "segment_users_items",
    "segment_label_counts",
}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins_in_registered_queries(spark):
    from cartlens.plans.queries import SPARK_QUERIES

    bad = {}
    for name, fn in SPARK_QUERIES.items():
        if name in MODEL_FITS:
            continue
        plan = _plan(fn(spark, SF001))
        hits = [op for op in FORBIDDEN if op in plan and op not in ALLOWED.get(name, set())]
        if hits:
            bad[name] = hits
    assert not bad, bad


@pytest.mark.parametrize(
    "name, table, columns",
    [
        ("ratings", "lineitem", "struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>"),
        ("ratings", "orders", "struct<o_orderkey:bigint,o_custkey:bigint>"),
        ("basket_parse", "part", "struct<p_partkey:bigint,p_type:string>"),
    ],
)
def test_scans_read_only_needed_columns(spark, name, table, columns):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF001)
    text = df._jdf.queryExecution().executedPlan().toString()
    # every scan of the table carries the pruned schema
    assert f"{table}.parquet" in text
    assert columns in text.replace(" ", "")


def test_top_n_is_limited_before_the_shuffle(spark):
    import __spark_entry__ as entry

    plan = _plan(entry.queries()["top_n_per_user"](spark, SF001))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_active_users_derive_ratings_once(spark, monkeypatch):
    from cartlens import session
    from cartlens.operators import ratings as r
    from cartlens.operators.relations import load_ratings

    plans = []

    def spy(df, partition_by=()):
        plans.append(_plan(df))
        return session.store(df, partition_by)

    monkeypatch.setattr(r, "store", spy)
    plans.append(_plan(r.best_seller_ratings(load_ratings(spark, SF001))))
    assert sum(p.count("lineitem.parquet") for p in plans) == 1


def test_als_evaluation_holds_one_model_at_a_time(spark):
    from cartlens.operators.relations import load_ratings
    from cartlens.plans.cv import als_fold_scores, prepare_folds

    folded = prepare_folds(load_ratings(spark, SF001))
    held = spark.sparkContext._jsc.getPersistentRDDs
    before = set(dict(held()))
    fast = {"max_iter": 1, "rank": 2}
    few = als_fold_scores(folded, n_folds=2, ks=(5,), als_params=fast)
    many = als_fold_scores(folded, n_folds=5, ks=(5,), als_params=fast)
    assert set(dict(held())) == before
    plans = [_plan(df) for df in (few, many)]
    assert all("Cartesian" not in p and "Join" not in p for p in plans)
    assert len(plans[1]) < 1.5 * len(plans[0])


def test_vectors_need_no_python(spark):
    from cartlens.plans.segmentation import customer_vectors

    assert "Python" not in _plan(customer_vectors(spark, SF001, "item"))

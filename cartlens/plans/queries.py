"""Registered queries: every operator of the workload, run on whole tables.

``SPARK_QUERIES[name](spark, sf_dir)`` returns a DataFrame.  ``ORACLE_SQL``
holds an independent DuckDB statement for every relational query; model
fits (ALS, K-means) have none and are checked by invariants in the tests.
Computed doubles are rounded to 6 decimals on both sides so the comparison
does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.functions.strings import jvm_string_hash, parse_basket_line
from cartlens.operators import baskets as bk
from cartlens.operators import segment as sg
from cartlens.operators.evaluate import pairs_intersect, precision_recall_at_k, recommendation_hits, recommended_lists
from cartlens.operators.folds import assign_folds, fold_test, fold_train
from cartlens.operators.lists import user_ratings_list
from cartlens.operators.ratings import (
    best_seller_ratings,
    cluster_members,
    cluster_sizes,
    count_items,
    filter_active_users,
    index_items,
    item_totals,
    join_clusters,
    top_share_items,
    user_item_pairs,
)
from cartlens.operators.recommend import (
    TOP_N,
    fit_implicit_als,
    normal_equation_residuals,
    recommend_popular,
    recommend_top_n,
    top_n_per_user,
    truncate_top_k,
)
from cartlens.operators.relations import (
    load_baskets,
    load_ratings,
    nation_clusters,
    segment_clusters,
    user_attribute_qty,
)
from cartlens.operators.unseen import top_n_unseen
from cartlens.operators.vectors import fill_missing_zero, hashed_cells, numeric_columns_to_vector, pivot_wide, row_to_key_and_array
from cartlens.plans import oracle_sql as q
from cartlens.plans.cv import als_fold_scores, evaluate_cv, evaluate_cv_by_cluster, evaluate_cv_top_sellers, prepare_folds
from cartlens.plans.segmentation import (
    customer_vectors,
    embedding_vectors,
    evaluate_within_segment_files,
    evaluate_within_segments,
    hashed_customer_vectors,
    user_cells,
)
from cartlens.plans.rules import basket_rules_report, rules_report_text, write_rules_report
from cartlens.plans.wide_table import write_wide_lines
from cartlens.session import scratch_path, store
from cartlens.sources.arrival import ARRIVAL
from cartlens.sources.tables import read_table
from cartlens.sources.sinks import write_delimited
from cartlens.sources.text import (
    CLUSTER_FILE_HEADER,
    parse_ratings,
    read_cluster_assignments,
    read_purchases_frame,
    read_ratings,
    with_item_hash,
)

Query = Callable[[SparkSession, str], DataFrame]

TEST_FOLD = 0  # fold shown by the train/test split queries
LIST_CHUNK = 16  # ratings to a list in the registered query (some 40 a customer)
CENTROID_BLOCK = 256  # centroids met at a time by the look-alike queries, so that some blocks arise
HASH_WIDTH = 4096  # positions of a hashed customer vector
RESIDUAL = 1e-3  # of the equations' right side; factors are single precision
USER_LABELS = 5  # labels of the embeddings that stand for users
SEGMENTS_K = 20  # segmentation that feeds the registered evaluation inside segments


def _r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# ---------------------------------------------------------------- relations


def q_ratings(spark, sf):
    return load_ratings(spark, sf)


def q_ratings_from_text(spark, sf):
    """Rating lines rendered from the tables and parsed back (split, 3-field
    check, casts, JVM hash of the item code)."""
    lines = load_ratings(spark, sf).select(
        F.concat_ws(";", F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.col("qty").cast("string")).alias("value")
    )
    found = with_item_hash(parse_ratings(lines, "value"))
    return found.select("user_id", "item_code", F.col("item_id").alias("item_hash"), "qty")


def q_hash_item_code(spark, sf):
    part = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_brand"])
    return part.select(
        "p_partkey", "p_name", jvm_string_hash("p_name").alias("name_hash"), jvm_string_hash("p_brand").alias("brand_hash")
    )


def q_index_items(spark, sf):
    return index_items(load_ratings(spark, sf))


def q_filter_active_users(spark, sf):
    return filter_active_users(load_ratings(spark, sf))


def q_item_totals(spark, sf):
    return item_totals(load_ratings(spark, sf))


def q_count_items(spark, sf):
    return count_items(load_ratings(spark, sf))


def q_top_share_items(spark, sf):
    return top_share_items(load_ratings(spark, sf))


def q_best_seller_ratings(spark, sf):
    return best_seller_ratings(load_ratings(spark, sf))


def q_cluster_ratings(spark, sf):
    return join_clusters(load_ratings(spark, sf), nation_clusters(spark, sf))


def q_cluster_members(spark, sf):
    return cluster_members(nation_clusters(spark, sf))


def q_cluster_sizes(spark, sf):
    return cluster_sizes(nation_clusters(spark, sf))


# ---------------------------------------------------------------- folds / ranking


def q_assign_folds(spark, sf):
    return assign_folds(filter_active_users(load_ratings(spark, sf)))


def q_fold_train(spark, sf):
    return fold_train(assign_folds(filter_active_users(load_ratings(spark, sf))), TEST_FOLD)


def q_fold_test(spark, sf):
    return fold_test(assign_folds(filter_active_users(load_ratings(spark, sf))), TEST_FOLD)


def q_user_ratings_list(spark, sf):
    """Everyone's ratings, ``LIST_CHUNK`` to a list; lists leave the query as arrays."""
    lists = user_ratings_list(load_ratings(spark, sf), LIST_CHUNK)
    return lists.select("user_id", "chunk", "n_ratings", F.col("ratings.item_id").alias("items"), F.col("ratings.qty").alias("qtys"))


def q_folds_in_arrival_order(spark, sf):
    """Rating lines, written with the largest quantities first and read back, cut into
    folds as they arrived."""
    ratings = load_ratings(spark, sf).orderBy(F.desc("qty"), "item_id", "user_id")
    path = scratch_path(spark, "lines")
    ratings.select(F.concat_ws(";", F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.col("qty").cast("string")).alias("value")).write.text(path)
    folded = assign_folds(filter_active_users(read_ratings(spark, path, item_ids="code", arrival=True)), order_cols=ARRIVAL)
    return folded.select("user_id", "item_code", "qty", "fold")


def q_top_n_per_user(spark, sf):
    r = load_ratings(spark, sf).withColumnRenamed("qty", "score")
    return top_n_per_user(r, 10)


# ---------------------------------------------------------------- evaluation (popularity recommender)


def _popular(spark, sf, as_lists=False):
    folded = prepare_folds(load_ratings(spark, sf))
    return folded, recommend_popular(folded, as_lists=as_lists)


def q_popular_recommendations(spark, sf):
    _, recs = _popular(spark, sf)
    return truncate_top_k(recs, 10)


def q_recommendation_hits(spark, sf):
    folded, recs = _popular(spark, sf)
    return recommendation_hits(recs, folded)


def q_user_item_pairs(spark, sf):
    return user_item_pairs(load_ratings(spark, sf))


def q_pairs_intersect(spark, sf):
    """Pairs bought that some fold's popular list holds for the user."""
    folded, recs = _popular(spark, sf)
    return pairs_intersect(recs, folded)


def q_own_history_scores(spark, sf):
    """The whole metric chain with a recommender that hits often: everyone's own most
    bought items."""
    folded = prepare_folds(load_ratings(spark, sf))
    own = top_n_per_user(folded.withColumnRenamed("qty", "score"), 30)
    # a list for each user, before it is repeated for each fold
    recs = recommended_lists(own, ["user_id"]).join(folded.select("user_id", "fold").distinct(), "user_id")
    return _round_scores(precision_recall_at_k(recs, folded))


def _round_scores(df):
    return df.select(*[_r6(c) if c in ("precision", "recall") else F.col(c) for c in df.columns])


def _round_summary(df):
    return df.select(*[_r6(c) if c in ("mean_precision", "mean_recall", "f1") else F.col(c) for c in df.columns])


def q_precision_recall_at_k(spark, sf):
    folded, recs = _popular(spark, sf, as_lists=True)
    return _round_scores(precision_recall_at_k(recs, folded))


def q_cv_summary(spark, sf):
    _, summary = evaluate_cv(load_ratings(spark, sf), recommender="popular")
    return _round_summary(summary)


def q_cv_summary_top_sellers(spark, sf):
    _, summary = evaluate_cv_top_sellers(load_ratings(spark, sf), recommender="popular")
    return _round_summary(summary)


def q_cv_summary_by_cluster(spark, sf):
    _, summary = evaluate_cv_by_cluster(load_ratings(spark, sf), nation_clusters(spark, sf), recommender="popular")
    return _round_summary(summary)


# ---------------------------------------------------------------- wide tables


def _brand_qty(spark, sf):
    return user_attribute_qty(load_ratings(spark, sf), read_table(spark, sf, "part"), "p_brand")


def q_user_brand_pivot(spark, sf):
    return pivot_wide(_brand_qty(spark, sf), "user_id", "attr", "qty", agg="first")


def q_user_brand_pivot_filled(spark, sf):
    wide = pivot_wide(_brand_qty(spark, sf), "user_id", "attr", "qty", agg="first")
    return fill_missing_zero(wide, [c for c in wide.columns if c != "user_id"])


def q_user_brand_arrays(spark, sf):
    """Zero-filled wide rows as ``(user_id, values)``: the array feeding dense vectors."""
    wide = pivot_wide(_brand_qty(spark, sf), "user_id", "attr", "qty", agg="first")
    filled = fill_missing_zero(wide, [c for c in wide.columns if c != "user_id"])
    return row_to_key_and_array(filled, "user_id")


# ---------------------------------------------------------------- files written and read back


def _rating_lines(spark, sf):
    """Headerless rating lines in a folder of their own; its path."""
    path = scratch_path(spark, "lines")
    lines = load_ratings(spark, sf).select(F.concat_ws(";", F.col("user_id").cast("string"), F.col("item_id").cast("string"), F.col("qty").cast("string")).alias("value"))
    lines.write.text(path)
    return path


def q_wide_item_file(spark, sf):
    """The customer x item table as one file, a column for each item; its lines."""
    path = scratch_path(spark, "wide")
    write_wide_lines(load_ratings(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def q_purchases_frame_file(spark, sf):
    return read_purchases_frame(spark, _rating_lines(spark, sf), item_type="int")


def q_cluster_file(spark, sf):
    """Customers by nation as the cluster file of a segmentation, in one file."""
    path = scratch_path(spark, "clusters")
    cluster, customer = CLUSTER_FILE_HEADER
    clusters = nation_clusters(spark, sf).select(F.col("cluster_number").alias(cluster), F.col("user_id").alias(customer))
    write_delimited(clusters, path, single_file=True, order_by=[cluster, customer])
    return read_cluster_assignments(spark, path)


def q_rules_report_file(spark, sf):
    """The report as one file with a header, read back as strings."""
    path = scratch_path(spark, "rules")
    report = basket_rules_report(spark, sf, "p_type").withColumn("confidence", F.round("confidence", 6))
    write_rules_report(report, path, single_file=True)
    return spark.read.option("sep", ";").option("header", "true").option("nullValue", "\x00").option("emptyValue", "").csv(path).na.fill("")


# ---------------------------------------------------------------- baskets


def q_basket_parse(spark, sf):
    """Order lines rendered as pipe-separated text with padding, repeated
    values and trailing empty fields, then parsed back."""
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_linestatus"])
    part = read_table(spark, sf, "part", ["p_partkey", "p_type"])
    cells = li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("basket_id"), "l_linestatus", "p_type"
    )
    lines = cells.groupBy("basket_id").agg(
        F.array_sort(F.collect_set(F.struct("l_linestatus", "p_type"))).alias("cells")
    ).select(
        "basket_id",
        F.concat(F.lit(" "), F.array_join(F.transform("cells", lambda c: c["p_type"]), "|"), F.lit("|| ")).alias("line"),
    )
    items = parse_basket_line(F.col("line"))
    return lines.select("basket_id", F.array_join(items, ",").alias("items_text"), F.size(items).alias("n_items"))


def _mined(spark, sf, attribute="p_type"):
    itemsets, n = bk.mine_once(load_baskets(spark, sf, attribute), 1.0 / bk.SUPPORT_DENOMINATOR)
    return itemsets, bk.rules_from_itemsets(itemsets, F.lit(n)), F.lit(n)


def q_frequent_itemsets(spark, sf):
    items, _, _ = _mined(spark, sf)
    return items.select(F.array_join("items", ", ").alias("items_text"), "freq", "size")


def q_frequent_itemsets_brand(spark, sf):
    items, _, _ = _mined(spark, sf, "p_brand")
    return items.select(F.array_join("items", ", ").alias("items_text"), "freq", "size")


def q_association_rules(spark, sf):
    _, rules, _ = _mined(spark, sf)
    return rules.select(
        F.array_join("antecedent", ", ").alias("antecedent_text"),
        F.array_join("consequent", ", ").alias("consequent_text"),
        "freq",
        F.round("confidence", 6).alias("confidence"),
    )


def _report(spark, sf, attribute):
    return basket_rules_report(spark, sf, attribute).withColumn("confidence", F.round("confidence", 6))


def q_rules_report(spark, sf):
    return _report(spark, sf, "p_type")


def q_rules_report_brand(spark, sf):
    return _report(spark, sf, "p_brand")


def q_rules_report_text(spark, sf):
    return rules_report_text(basket_rules_report(spark, sf, "p_type"))


def q_itemsets_by_freq(spark, sf):
    return bk.itemsets_by_freq(_mined(spark, sf, "p_brand")[0])


def q_rules_by_confidence(spark, sf):
    rules = bk.rules_by_confidence(_mined(spark, sf)[1])
    return rules.withColumn("confidence", F.round("confidence", 6))


# ---------------------------------------------------------------- centroids


def _emb(spark, sf):
    return read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])


def q_centroid_coordinates(spark, sf):
    cent = sg.label_centroids(_emb(spark, sf))
    return cent.select("label", F.posexplode("centroid").alias("pos", "value")).select(
        "label", F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value")
    )


def _nearest(spark, sf, distance):
    emb = _emb(spark, sf)
    cent = sg.label_centroids(emb).withColumnRenamed("label", "cluster")
    out = sg.assign_nearest_centroid(emb, cent, distance, id_col="vec_id", vector_col="embedding")
    return out.select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


def q_assign_nearest_centroid(spark, sf):
    return _nearest(spark, sf, "cosine")


def q_assign_nearest_centroid_euclidean(spark, sf):
    return _nearest(spark, sf, "euclidean")


def _lookalike(spark, sf, distance):
    """For each customer with an odd id, the nearest one with an even id by what was
    bought of each brand: as many centroids as there are such customers."""
    brands = load_ratings(spark, sf).join(read_table(spark, sf, "part", ["p_partkey", "p_brand"]), F.col("item_id") == F.col("p_partkey"))
    wide = pivot_wide(brands.select("user_id", "p_brand", "qty"), "user_id", "p_brand", "qty", agg="sum")
    vectors = store(row_to_key_and_array(fill_missing_zero(wide, [c for c in wide.columns if c != "user_id"]), "user_id", output_col="vector"))
    even = vectors.where("user_id % 2 = 0").select(F.col("user_id").alias("cluster"), F.col("vector").alias("centroid"))
    odd = vectors.where("user_id % 2 = 1")
    found = sg.assign_nearest_centroid(odd, even, distance, id_col="user_id", max_centroids=CENTROID_BLOCK)
    return found.select("user_id", F.col("cluster").alias("lookalike"), F.round("distance", 6).alias("distance"))


def q_nearest_lookalike(spark, sf):
    return _lookalike(spark, sf, "euclidean")


def q_nearest_lookalike_cosine(spark, sf):
    return _lookalike(spark, sf, "cosine").drop("lookalike")


# ---------------------------------------------------------------- items not bought yet


def q_top_n_unseen(spark, sf):
    """Of the embeddings, five labels stand for users' factors and five for items'; what
    the purchases pair is masked."""
    emb = read_table(spark, sf, "embeddings")
    users = emb.where(f"label < {USER_LABELS}").select(F.col("vec_id").alias("user_id"), F.col("embedding").alias("features"))
    items = emb.where(f"label >= {USER_LABELS}").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("features"))
    best = top_n_unseen(users, items, load_ratings(spark, sf), TOP_N)
    return best.withColumn("score", F.round("score", 6))


def q_als_recommendations_unseen(spark, sf):
    return recommend_top_n(filter_active_users(load_ratings(spark, sf)), exclude_seen=True)


def q_als_unseen_counts(spark, sf):
    """How many users have lists, how long these are together, and how many of their
    items the user had bought."""
    active = filter_active_users(load_ratings(spark, sf))
    found = recommend_top_n(active, exclude_seen=True)
    bought = active.select("user_id", "item_id", F.lit(1).alias("one"))
    return found.join(bought, ["user_id", "item_id"], "left").agg(
        F.count_distinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n_rows"), F.count("one").alias("n_bought")
    )


# ---------------------------------------------------------------- model fits (no SQL oracle)


def q_als_recommendations(spark, sf):
    return recommend_top_n(filter_active_users(load_ratings(spark, sf)))


def q_als_cv_summary(spark, sf):
    return evaluate_cv(load_ratings(spark, sf), recommender="als")[1]


def q_als_cv_summary_top_sellers(spark, sf):
    return evaluate_cv_top_sellers(load_ratings(spark, sf), recommender="als")[1]


def q_als_cv_summary_by_segment(spark, sf):
    """ALS evaluated inside customer segments; the market segment of the
    customer table stands in for a clustering result."""
    return evaluate_cv_by_cluster(load_ratings(spark, sf), segment_clusters(spark, sf), recommender="als")[1]


def q_als_cv_counts(spark, sf):
    """List and test sizes of the ALS evaluation, which don't hang on the model."""
    scores = als_fold_scores(prepare_folds(load_ratings(spark, sf)))
    return scores.select("fold", "k", "n_rec", "n_test")


def q_cv_summary_within_segments(spark, sf):
    """K-means segments of customers on their item vectors, each evaluated by itself."""
    segments = customer_vectors(spark, sf, "item")
    return _round_summary(evaluate_within_segments(load_ratings(spark, sf), segments, SEGMENTS_K, recommender="popular")[1])


def q_als_cv_within_segments(spark, sf):
    """K-means segments written as cluster files and read back, ALS evaluated in each."""
    segments = customer_vectors(spark, sf, "p_brand")
    return evaluate_within_segment_files(load_ratings(spark, sf), segments, [SEGMENTS_K], recommender="als")


def q_kmeans_cost_curve_cosine(spark, sf):
    return sg.kmeans_cost_curve(customer_vectors(spark, sf, "p_brand"), sg.COSINE_SWEEP, "cosine")


def q_kmeans_cost_curve_euclidean(spark, sf):
    return sg.kmeans_cost_curve(embedding_vectors(spark, sf), sg.EUCLIDEAN_SWEEP, "euclidean", id_col="vec_id")


def q_kmeans_cost_curve_items(spark, sf):
    return sg.kmeans_cost_curve(customer_vectors(spark, sf, "item"), sg.COSINE_SWEEP, "cosine")


def q_segment_users_items(spark, sf):
    return sg.segment_users(customer_vectors(spark, sf, "item"), sg.SEGMENT_KS, "cosine")


def q_segment_label_counts(spark, sf):
    """Customers with a label or a reason for having none, for each k."""
    found = sg.segment_users(customer_vectors(spark, sf, "p_brand"), sg.SEGMENT_KS, "cosine")
    told = F.col("cluster_number").between(0, F.col("k") - 1) | F.col("reason").isNotNull()
    return found.where(told).groupBy("k").agg(F.count_distinct("user_id").alias("n_users"), F.count(F.lit(1)).alias("n_rows"))


def q_user_item_cells(spark, sf):
    return user_cells(spark, sf, "item")[0]


def q_segment_users(spark, sf):
    return sg.segment_users(customer_vectors(spark, sf, "p_brand"), sg.SEGMENT_KS, "cosine")


def q_user_hash_cells(spark, sf):
    return hashed_cells(load_ratings(spark, sf), HASH_WIDTH)


def q_kmeans_cost_curve_hashed(spark, sf):
    return sg.kmeans_cost_curve(hashed_customer_vectors(spark, sf, HASH_WIDTH), sg.COSINE_SWEEP, "cosine")


def q_stored_model_labels(spark, sf):
    """Models of a sweep, saved, read back as one table of centroids and used to label
    all customers: for each k how many have no label, how many another one than
    the model gave, and by how much the cost is over that of training."""
    vectors, path = store(customer_vectors(spark, sf, "p_brand")), scratch_path(spark, "models")
    curve, labels = sg.kmeans_sweep(vectors, sg.SEGMENT_KS, "cosine", segment_ks=sg.SEGMENT_KS, model_dir=path)
    found = sg.label_by_stored(vectors, sg.stored_centroids(spark, path), sg.SEGMENT_KS)
    both = found.join(labels.select("k", "user_id", F.col("cluster_number").alias("given")), ["k", "user_id"], "full")
    sums = both.groupBy("k").agg(
        F.count(F.lit(1)).alias("n_users"),
        F.count_if(F.col("cluster_number").isNull()).alias("n_unlabelled"),
        F.count_if(~F.col("cluster_number").eqNullSafe(F.col("given"))).alias("n_other"),
        F.sum("distance").alias("again"),
    )
    over = F.round(F.greatest(F.col("again") - F.col("cost"), F.lit(0.0)), 6).alias("cost_over")
    return sums.join(curve, "k").select("k", "n_users", "n_unlabelled", "n_other", over)


def q_als_residual_counts(spark, sf):
    """Users of the fitted model, and those whose factors don't solve their equations."""
    active = store(filter_active_users(load_ratings(spark, sf)))
    model = fit_implicit_als(active)
    users, items = model.userFactors.withColumnRenamed("id", "user_id"), model.itemFactors.withColumnRenamed("id", "item_id")
    found = normal_equation_residuals(users, items, active)
    wrong = F.col("residual").isNull() | (F.col("residual") > RESIDUAL)
    return found.agg(F.count(F.lit(1)).alias("n_users"), F.sum("n_ratings").alias("n_ratings"), F.count_if(wrong).alias("n_over"))


def _vectors_as_arrays(df, col="features"):
    # vectors leave the registered query as plain arrays, readable by any collector
    return df.withColumn(col, vector_to_array(F.col(col)))


def q_user_item_vectors(spark, sf):
    return _vectors_as_arrays(customer_vectors(spark, sf, "item"))


def q_numeric_columns_to_vector(spark, sf):
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    return _vectors_as_arrays(numeric_columns_to_vector(cust, keep=["c_custkey"]))


SPARK_QUERIES: dict[str, Query] = {
    "ratings": q_ratings,
    "ratings_from_text": q_ratings_from_text,
    "hash_item_code": q_hash_item_code,
    "index_items": q_index_items,
    "filter_active_users": q_filter_active_users,
    "item_totals": q_item_totals,
    "count_items": q_count_items,
    "top_share_items": q_top_share_items,
    "best_seller_ratings": q_best_seller_ratings,
    "cluster_ratings": q_cluster_ratings,
    "cluster_members": q_cluster_members,
    "cluster_sizes": q_cluster_sizes,
    "assign_folds": q_assign_folds,
    "fold_train": q_fold_train,
    "fold_test": q_fold_test,
    "top_n_per_user": q_top_n_per_user,
    "popular_recommendations": q_popular_recommendations,
    "recommendation_hits": q_recommendation_hits,
    "precision_recall_at_k": q_precision_recall_at_k,
    "cv_summary": q_cv_summary,
    "cv_summary_top_sellers": q_cv_summary_top_sellers,
    "cv_summary_by_cluster": q_cv_summary_by_cluster,
    "user_brand_pivot": q_user_brand_pivot,
    "user_brand_pivot_filled": q_user_brand_pivot_filled,
    "user_brand_arrays": q_user_brand_arrays,
    "basket_parse": q_basket_parse,
    "frequent_itemsets": q_frequent_itemsets,
    "frequent_itemsets_brand": q_frequent_itemsets_brand,
    "association_rules": q_association_rules,
    "rules_report": q_rules_report,
    "rules_report_brand": q_rules_report_brand,
    "centroid_coordinates": q_centroid_coordinates,
    "assign_nearest_centroid": q_assign_nearest_centroid,
    "assign_nearest_centroid_euclidean": q_assign_nearest_centroid_euclidean,
    "rules_report_text": q_rules_report_text,
    "itemsets_by_freq": q_itemsets_by_freq,
    "rules_by_confidence": q_rules_by_confidence,
    "user_item_pairs": q_user_item_pairs,
    "pairs_intersect": q_pairs_intersect,
    "own_history_scores": q_own_history_scores,
    "user_item_cells": q_user_item_cells,
    "als_cv_counts": q_als_cv_counts,
    "cv_summary_within_segments": q_cv_summary_within_segments,
    "kmeans_cost_curve_items": q_kmeans_cost_curve_items,
    "segment_users_items": q_segment_users_items,
    "segment_label_counts": q_segment_label_counts,
    "als_recommendations": q_als_recommendations,
    "als_cv_summary": q_als_cv_summary,
    "als_cv_summary_top_sellers": q_als_cv_summary_top_sellers,
    "als_cv_summary_by_segment": q_als_cv_summary_by_segment,
    "kmeans_cost_curve_cosine": q_kmeans_cost_curve_cosine,
    "kmeans_cost_curve_euclidean": q_kmeans_cost_curve_euclidean,
    "segment_users": q_segment_users,
    "user_ratings_list": q_user_ratings_list,
    "folds_in_arrival_order": q_folds_in_arrival_order,
    "wide_item_file": q_wide_item_file,
    "purchases_frame_file": q_purchases_frame_file,
    "cluster_file": q_cluster_file,
    "rules_report_file": q_rules_report_file,
    "nearest_lookalike": q_nearest_lookalike,
    "nearest_lookalike_cosine": q_nearest_lookalike_cosine,
    "user_hash_cells": q_user_hash_cells,
    "kmeans_cost_curve_hashed": q_kmeans_cost_curve_hashed,
    "stored_model_labels": q_stored_model_labels,
    "als_residual_counts": q_als_residual_counts,
    "als_cv_within_segments": q_als_cv_within_segments,
    "top_n_unseen": q_top_n_unseen,
    "als_recommendations_unseen": q_als_recommendations_unseen,
    "als_unseen_counts": q_als_unseen_counts,
    "user_item_vectors": q_user_item_vectors,
    "numeric_columns_to_vector": q_numeric_columns_to_vector,
}


# ---------------------------------------------------------------- oracle SQL

W = "WITH RECURSIVE "

ORACLE_SQL: dict[str, str] = {
    "ratings": f"WITH {q.RATINGS} SELECT user_id, item_id, qty FROM ratings",
    "ratings_from_text": f"""WITH {q.RATINGS},
lines AS (SELECT CAST(user_id AS VARCHAR) || ';' || CAST(item_id AS VARCHAR) || ';' || CAST(qty AS VARCHAR) AS line FROM ratings),
f AS (SELECT string_split(line, ';') AS f FROM lines)
SELECT CAST(CAST(f[1] AS INTEGER) AS BIGINT) AS user_id, f[2] AS item_code, {q.jvm_hash('f[2]')} AS item_hash,
       CAST(f[3] AS DOUBLE) AS qty FROM f""",
    "hash_item_code": f"""SELECT p_partkey, p_name, {q.jvm_hash('p_name')} AS name_hash, {q.jvm_hash('p_brand')} AS brand_hash
FROM part""",
    "index_items": f"""WITH {q.RATINGS}
SELECT item_id, CAST(ROW_NUMBER() OVER (ORDER BY item_id) - 1 AS INTEGER) AS item_idx
FROM (SELECT DISTINCT item_id FROM ratings WHERE item_id IS NOT NULL)""",
    "filter_active_users": f"WITH {q.RATINGS}, {q.active()} SELECT user_id, item_id, qty FROM active",
    "item_totals": f"WITH {q.RATINGS} SELECT item_id, SUM(qty) AS total_qty FROM ratings GROUP BY item_id",
    "count_items": f"WITH {q.RATINGS} SELECT COUNT(DISTINCT item_id) AS n_items FROM ratings",
    "top_share_items": f"WITH {q.RATINGS}, {q.top_share()} SELECT item_id, total_qty, sales_rank FROM top_items",
    "best_seller_ratings": f"""WITH {q.RATINGS}, {q.top_share()},
best AS (SELECT * FROM ratings WHERE item_id IN (SELECT item_id FROM top_items)),
{q.active('best', 'best_active')}
SELECT user_id, item_id, qty FROM best_active""",
    "cluster_ratings": f"""WITH {q.RATINGS}
SELECT r.user_id, r.item_id, r.qty, CAST(c.c_nationkey AS INTEGER) AS cluster_number
FROM ratings r JOIN (SELECT DISTINCT c_custkey, c_nationkey FROM customer) c ON c.c_custkey = r.user_id""",
    "cluster_members": """SELECT cluster_number, user_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY cluster_number ORDER BY user_id) - 1 AS BIGINT) AS member_rank
FROM (SELECT DISTINCT CAST(c_nationkey AS INTEGER) AS cluster_number, c_custkey AS user_id FROM customer)""",
    "cluster_sizes": """SELECT cluster_number, COUNT(*) AS n_users,
       (SELECT COUNT(DISTINCT c_nationkey) FROM customer) AS n_clusters
FROM (SELECT DISTINCT CAST(c_nationkey AS INTEGER) AS cluster_number, c_custkey FROM customer)
GROUP BY cluster_number""",
    "assign_folds": f"WITH {q.RATINGS}, {q.active()}, {q.folded()} SELECT user_id, item_id, qty, fold FROM folded",
    "fold_train": f"""WITH {q.RATINGS}, {q.active()}, {q.folded()}
SELECT user_id, item_id, qty, fold FROM folded WHERE fold <> {TEST_FOLD}""",
    "fold_test": f"""WITH {q.RATINGS}, {q.active()}, {q.folded()}
SELECT user_id, item_id, qty, fold FROM folded WHERE fold = {TEST_FOLD}""",
    "top_n_per_user": f"""WITH {q.RATINGS}
SELECT user_id, item_id, score, rank FROM (
  SELECT user_id, item_id, qty AS score,
         CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY qty DESC, item_id) - 1 AS INTEGER) AS rank
  FROM ratings)
WHERE rank < 10""",
    "popular_recommendations": f"""WITH {q.RATINGS}, {q.active()}, {q.folded()}, {q.popular_recs()}
SELECT fold, user_id, rank, item_id, score FROM recs WHERE rank < 10""",
    "recommendation_hits": f"""WITH {q.RATINGS}, {q.active()}, {q.folded()}, {q.popular_recs()}, {q.scores()}
SELECT CAST(fold AS INTEGER) AS fold, user_id, item_id, CAST(rank AS INTEGER) AS rank FROM hits""",
    "precision_recall_at_k": f"""WITH {q.RATINGS}, {q.active()}, {q.folded()}, {q.popular_recs()}, {q.scores()}
SELECT fold, k, n_hits, n_rec, n_test, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall FROM scores""",
    "cv_summary": f"WITH {q.RATINGS}, {q.active()}, {q.folded()}, {q.popular_recs()}, {q.scores()}, {q.summary()}",
    "cv_summary_top_sellers": f"""WITH {q.RATINGS}, {q.top_share()},
best AS (SELECT * FROM ratings WHERE item_id IN (SELECT item_id FROM top_items)),
{q.active('best', 'active')}, {q.folded()}, {q.popular_recs()}, {q.scores()}, {q.summary()}""",
    "cv_summary_by_cluster": f"""WITH {q.RATINGS},
scoped AS (
  SELECT r.user_id, r.item_id, r.qty, CAST(c.c_nationkey AS INTEGER) AS cluster_number
  FROM ratings r JOIN (SELECT DISTINCT c_custkey, c_nationkey FROM customer) c ON c.c_custkey = r.user_id),
{q.active('scoped', 'active', 'cluster_number')}, {q.folded(scope='cluster_number')}, {q.popular_recs(scope='cluster_number')},
{q.scores(scope='cluster_number')}, {q.summary(scope='cluster_number')}""",
    "user_brand_pivot": f"""WITH {q.RATINGS},
ubq AS (SELECT r.user_id, p.p_brand AS attr, SUM(r.qty) AS qty FROM ratings r JOIN part p ON p.p_partkey = r.item_id GROUP BY 1, 2)
SELECT user_id, {q.brand_columns('max(qty) FILTER (attr = {})')} FROM ubq GROUP BY user_id""",
    "user_brand_pivot_filled": f"""WITH {q.RATINGS},
ubq AS (SELECT r.user_id, p.p_brand AS attr, SUM(r.qty) AS qty FROM ratings r JOIN part p ON p.p_partkey = r.item_id GROUP BY 1, 2)
SELECT user_id, {q.brand_columns('coalesce(max(qty) FILTER (attr = {}), 0.0)')} FROM ubq GROUP BY user_id""",
    "user_item_cells": f"""WITH {q.RATINGS}, {q.DICTIONARY}
SELECT user_id, item_idx, qty FROM ratings JOIN dictionary USING (item_id)""",
    "user_item_vectors": f"""WITH {q.RATINGS}, {q.DICTIONARY},
users AS (SELECT DISTINCT user_id FROM ratings),
grid AS (SELECT u.user_id, d.item_id, d.item_idx FROM users u CROSS JOIN dictionary d)
SELECT g.user_id, list(coalesce(r.qty, 0.0) ORDER BY g.item_idx) AS features
FROM grid g LEFT JOIN ratings r ON r.user_id = g.user_id AND r.item_id = g.item_id
GROUP BY g.user_id""",
    "numeric_columns_to_vector": """SELECT c_custkey,
       [coalesce(CAST(c_nationkey AS DOUBLE), 0.0), coalesce(CAST(c_acctbal AS DOUBLE), 0.0)] AS features FROM customer""",
    "user_item_pairs": f"WITH {q.RATINGS} SELECT user_id, item_id FROM ratings",
    "pairs_intersect": f"""WITH {q.RATINGS}, {q.active()}, {q.folded()}, {q.popular_recs()}
SELECT user_id, item_id FROM recs INTERSECT SELECT user_id, item_id FROM folded""",
    "own_history_scores": f"""WITH {q.RATINGS}, {q.active()}, {q.folded()},
own AS (
  SELECT user_id, item_id, rank FROM (
    SELECT user_id, item_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY qty DESC, item_id) - 1 AS INTEGER) AS rank FROM folded)
  WHERE rank < 30),
recs AS (SELECT f.fold, o.user_id, o.rank, o.item_id FROM own o JOIN (SELECT DISTINCT user_id, fold FROM folded) f USING (user_id)),
{q.scores()}
SELECT fold, k, n_hits, n_rec, n_test, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall FROM scores""",
    "als_cv_counts": f"""WITH {q.RATINGS}, {q.active()}, {q.folded()},
folds AS (SELECT CAST(range AS INTEGER) AS fold FROM range(10)),
trained AS (
  SELECT f.fold, COUNT(DISTINCT d.user_id) AS users, COUNT(DISTINCT d.item_id) AS items
  FROM folds f JOIN folded d ON d.fold <> f.fold GROUP BY f.fold),
tested AS (SELECT fold, COUNT(*) AS n_test FROM folded GROUP BY fold)
SELECT t.fold, CAST(k AS INTEGER) AS k, CAST(users * least(k, items) AS BIGINT) AS n_rec, n_test
FROM trained t JOIN tested USING (fold) CROSS JOIN (SELECT UNNEST({q.KS_SQL}) AS k)""",
    "user_ratings_list": f"""WITH {q.RATINGS},
placed AS (
  SELECT user_id, item_id, qty, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY item_id) - 1 AS place, COUNT(*) OVER (PARTITION BY user_id) AS n
  FROM ratings)
SELECT user_id, CAST(place // {LIST_CHUNK} AS BIGINT) AS chunk, any_value(n) AS n_ratings,
       list(item_id ORDER BY place) AS items, list(qty ORDER BY place) AS qtys
FROM placed GROUP BY user_id, place // {LIST_CHUNK}""",
    "folds_in_arrival_order": f"""WITH {q.RATINGS}, {q.active()},
lines AS (SELECT *, ROW_NUMBER() OVER (ORDER BY qty DESC, item_id, user_id) AS line_no FROM active)
SELECT user_id, CAST(item_id AS VARCHAR) AS item_code, qty,
       CAST(10 - NTILE(10) OVER (PARTITION BY user_id ORDER BY line_no DESC) AS INTEGER) AS fold FROM lines""",
    "wide_item_file": f"""WITH {q.RATINGS}, {q.DICTIONARY},
users AS (SELECT DISTINCT user_id FROM ratings),
grid AS (SELECT u.user_id, d.item_id, d.item_idx FROM users u CROSS JOIN dictionary d)
SELECT 'user_id;' || string_agg(CAST(item_id AS VARCHAR), ';' ORDER BY item_idx) AS line FROM dictionary
UNION ALL
SELECT CAST(g.user_id AS VARCHAR) || ';' || string_agg(coalesce(CAST(r.qty AS VARCHAR), ''), ';' ORDER BY g.item_idx)
FROM grid g LEFT JOIN ratings r ON r.user_id = g.user_id AND r.item_id = g.item_id
GROUP BY g.user_id""",
    "purchases_frame_file": f"WITH {q.RATINGS} SELECT user_id, CAST(item_id AS INTEGER) AS item_id, qty FROM ratings",
    "cluster_file": "SELECT DISTINCT CAST(c_nationkey AS INTEGER) AS cluster_number, c_custkey AS user_id FROM customer",
    "nearest_lookalike": f"""WITH {q.RATINGS}, {q.BRAND_VECTORS},
d AS (
  SELECT a.user_id, b.user_id AS lookalike, list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
  FROM vectors a CROSS JOIN vectors b WHERE a.user_id % 2 = 1 AND b.user_id % 2 = 0)
SELECT user_id, lookalike, ROUND(distance, 6) AS distance FROM d
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY distance, lookalike) = 1""",
    "nearest_lookalike_cosine": f"""WITH {q.RATINGS}, {q.BRAND_VECTORS},
normed AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM vectors)
SELECT a.user_id, ROUND(min(1.0 - list_dot_product(a.x, b.x) / (a.norm * b.norm)), 6) AS distance
FROM normed a CROSS JOIN normed b WHERE a.user_id % 2 = 1 AND b.user_id % 2 = 0 GROUP BY a.user_id""",
    "user_hash_cells": f"""WITH {q.RATINGS},
hashed AS (SELECT *, CAST('0x' || substr(md5(CAST(item_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM ratings)
SELECT user_id, CAST(h % {HASH_WIDTH} AS INTEGER) AS item_idx, SUM(CASE WHEN (h // {HASH_WIDTH}) % 2 = 0 THEN qty ELSE -qty END) AS qty
FROM hashed GROUP BY user_id, h % {HASH_WIDTH}""",
    "stored_model_labels": f"""WITH {q.RATINGS}
SELECT CAST(k AS INTEGER) AS k, COUNT(DISTINCT user_id) AS n_users, CAST(0 AS BIGINT) AS n_unlabelled, CAST(0 AS BIGINT) AS n_other, CAST(0 AS DOUBLE) AS cost_over
FROM ratings CROSS JOIN (SELECT UNNEST({list(sg.SEGMENT_KS)}) AS k) GROUP BY k""",
    "als_residual_counts": f"""WITH {q.RATINGS}, {q.active()}
SELECT COUNT(DISTINCT user_id) AS n_users, COUNT(*) AS n_ratings, CAST(0 AS BIGINT) AS n_over FROM active""",
    "top_n_unseen": f"""WITH {q.RATINGS},
users AS (SELECT vec_id AS user_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label < {USER_LABELS}),
items AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label >= {USER_LABELS}),
scored AS (
  SELECT u.user_id, i.item_id, list_dot_product(u.x, i.x) AS score FROM users u CROSS JOIN items i
  WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = u.user_id AND r.item_id = i.item_id))
SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, ROUND(score, 6) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) - 1 AS rank FROM scored)
WHERE rank < {TOP_N}""",
    "als_unseen_counts": f"""WITH {q.RATINGS}, {q.active()},
own AS (SELECT user_id, COUNT(DISTINCT item_id) AS n FROM active GROUP BY user_id)
SELECT COUNT(*) AS n_users, CAST(SUM(least({TOP_N}, (SELECT COUNT(DISTINCT item_id) FROM active) - n)) AS BIGINT) AS n_rows,
       CAST(0 AS BIGINT) AS n_bought FROM own""",
    "segment_label_counts": f"""WITH {q.RATINGS}
SELECT CAST(k AS INTEGER) AS k, COUNT(DISTINCT user_id) AS n_users, COUNT(DISTINCT user_id) AS n_rows
FROM ratings CROSS JOIN (SELECT UNNEST({list(sg.SEGMENT_KS)}) AS k) GROUP BY k""",
    "user_brand_arrays": f"""WITH {q.RATINGS},
ubq AS (SELECT r.user_id, p.p_brand AS attr, SUM(r.qty) AS qty FROM ratings r JOIN part p ON p.p_partkey = r.item_id GROUP BY 1, 2),
users AS (SELECT DISTINCT user_id FROM ubq),
attrs AS (SELECT DISTINCT attr FROM ubq),
grid AS (SELECT u.user_id, a.attr FROM users u CROSS JOIN attrs a)
SELECT g.user_id, list(COALESCE(CAST(b.qty AS DOUBLE), 0.0) ORDER BY g.attr) AS "values"
FROM grid g LEFT JOIN ubq b ON b.user_id = g.user_id AND b.attr = g.attr
GROUP BY g.user_id""",
    "basket_parse": """WITH cells AS (
  SELECT DISTINCT l.l_orderkey AS basket_id, l.l_linestatus, p.p_type
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
lines AS (
  SELECT basket_id, ' ' || string_agg(p_type, '|' ORDER BY l_linestatus, p_type) || '|| ' AS line
  FROM cells GROUP BY basket_id),
split AS (SELECT basket_id, string_split(trim(line), '|') AS parts FROM lines),
kept AS (
  SELECT basket_id,
         CASE WHEN len(parts) = 1 THEN parts
              ELSE list_slice(parts, 1, list_max(list_transform(parts, lambda x, i: CASE WHEN x <> '' THEN i ELSE 0 END)))
         END AS parts
  FROM split),
dedup AS (SELECT basket_id, list_filter(parts, lambda x, i: list_position(parts, x) = i) AS items FROM kept)
SELECT basket_id, array_to_string(items, ',') AS items_text, CAST(len(items) AS INTEGER) AS n_items FROM dedup""",
    "frequent_itemsets": f"""{W}{q.baskets('p_type')}
SELECT array_to_string(items, ', ') AS items_text, CAST(freq AS BIGINT) AS freq, CAST(len(items) AS INTEGER) AS size FROM freq""",
    "frequent_itemsets_brand": f"""{W}{q.baskets('p_brand')}
SELECT array_to_string(items, ', ') AS items_text, CAST(freq AS BIGINT) AS freq, CAST(len(items) AS INTEGER) AS size FROM freq""",
    "association_rules": f"""{W}{q.baskets('p_type')}
SELECT array_to_string(antecedent, ', ') AS antecedent_text, consequent AS consequent_text,
       CAST(freq AS BIGINT) AS freq, ROUND(confidence, 6) AS confidence FROM rules""",
    "rules_report": f"""{W}{q.baskets('p_type')}, {q.SWEEP}
SELECT support, '{bk.ITEMSET_LABEL}' AS type, array_to_string(items, ', ') AS antecedent_itemset, '' AS consequent,
       CAST(freq AS BIGINT) AS freq, CAST(NULL AS DOUBLE) AS confidence FROM swept_items
UNION ALL
SELECT support, '{bk.RULE_LABEL}' AS type, array_to_string(antecedent, ', ') AS antecedent_itemset, consequent,
       CAST(freq AS BIGINT) AS freq, ROUND(confidence, 6) AS confidence FROM swept_rules""",
    "rules_report_brand": f"""{W}{q.baskets('p_brand')}, {q.SWEEP}
SELECT support, '{bk.ITEMSET_LABEL}' AS type, array_to_string(items, ', ') AS antecedent_itemset, '' AS consequent,
       CAST(freq AS BIGINT) AS freq, CAST(NULL AS DOUBLE) AS confidence FROM swept_items
UNION ALL
SELECT support, '{bk.RULE_LABEL}' AS type, array_to_string(antecedent, ', ') AS antecedent_itemset, consequent,
       CAST(freq AS BIGINT) AS freq, ROUND(confidence, 6) AS confidence FROM swept_rules""",
    "rules_report_text": f"""{W}{q.baskets('p_type')}, {q.SWEEP}
SELECT CAST(support AS VARCHAR) AS "{bk.REPORT_COLUMNS[0]}", '{bk.ITEMSET_LABEL}' AS "{bk.REPORT_COLUMNS[1]}",
       array_to_string(items, ', ') AS "{bk.REPORT_COLUMNS[2]}", '' AS "{bk.REPORT_COLUMNS[3]}", CAST(freq AS VARCHAR) AS "{bk.REPORT_COLUMNS[4]}"
FROM swept_items
UNION ALL
SELECT CAST(support AS VARCHAR), '{bk.RULE_LABEL}', array_to_string(antecedent, ', '), consequent, CAST(ROUND(confidence, 6) AS VARCHAR)
FROM swept_rules""",
    "itemsets_by_freq": f"""{W}{q.baskets('p_brand')}
SELECT array_to_string(items, ', ') AS items_text, CAST(freq AS BIGINT) AS freq, CAST(len(items) AS INTEGER) AS size,
       ROW_NUMBER() OVER (ORDER BY freq DESC, array_to_string(items, ', ')) - 1 AS position FROM freq""",
    "rules_by_confidence": f"""{W}{q.baskets('p_type')}
SELECT array_to_string(antecedent, ', ') AS antecedent_text, consequent AS consequent_text, CAST(freq AS BIGINT) AS freq,
       ROUND(confidence, 6) AS confidence,
       ROW_NUMBER() OVER (ORDER BY confidence DESC, array_to_string(antecedent, ', '), consequent) - 1 AS position FROM rules""",
    "centroid_coordinates": f"""WITH {q.centroids()}
SELECT label, CAST(pos AS INTEGER) AS pos, ROUND(m, 6) AS value FROM coords""",
    "assign_nearest_centroid": f"""WITH {q.centroids()},
d AS (
  SELECT e.vec_id, c.label AS cluster,
         1.0 - list_dot_product(e.x, c.c) / (sqrt(list_dot_product(e.x, e.x)) * sqrt(list_dot_product(c.c, c.c))) AS distance
  FROM emb e CROSS JOIN cent c)
SELECT vec_id, cluster, ROUND(distance, 6) AS distance FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS rn FROM d)
WHERE rn = 1""",
    "assign_nearest_centroid_euclidean": f"""WITH {q.centroids()},
d AS (
  SELECT e.vec_id, c.label AS cluster,
         list_sum(list_transform(list_zip(e.x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
  FROM emb e CROSS JOIN cent c)
SELECT vec_id, cluster, ROUND(distance, 6) AS distance FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS rn FROM d)
WHERE rn = 1""",
}
# a file read back holds what the text form of the report holds
ORACLE_SQL["rules_report_file"] = ORACLE_SQL["rules_report_text"]

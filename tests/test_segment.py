import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cartlens.operators import segment as sg
from cartlens.plans.segmentation import customer_vectors, embedding_vectors

from .conftest import SF001


def test_nonzero_vectors(spark):
    df = spark.createDataFrame([(1, Vectors.dense([0.0, 0.0])), (2, Vectors.dense([0.0, 1.0]))], ["id", "features"])
    assert [r["id"] for r in sg.nonzero_vectors(df).collect()] == [2]


@pytest.mark.parametrize("distance", ["euclidean", "cosine"])
def test_assignment_matches_model(spark, distance):
    feats = embedding_vectors(spark, SF001).persist()
    model = sg.fit_kmeans(feats, 4, distance, seed=3, max_iter=100, tol=1e-9)
    cents = sg.model_centroids(model).withColumnRenamed("cluster_number", "cluster")
    pts = feats.select("vec_id", F.col("features"))
    from pyspark.ml.functions import vector_to_array

    pts = pts.select("vec_id", vector_to_array("features").alias("vector"))
    ours = {r["vec_id"]: (r["cluster"], r["distance"]) for r in sg.assign_nearest_centroid(pts, cents, distance, id_col="vec_id").collect()}
    theirs = {r["vec_id"]: r["cluster_number"] for r in model.transform(feats).collect()}
    assert {k: v[0] for k, v in ours.items()} == theirs
    cost = sum(v[1] for v in ours.values())
    assert cost == pytest.approx(model.summary.trainingCost, rel=1e-3)
    feats.unpersist()


def test_label_centroids_are_means(spark):
    from cartlens.sources.tables import read_table

    emb = read_table(spark, SF001, "embeddings")
    got = {r["label"]: np.array(r["centroid"]) for r in sg.label_centroids(emb).collect()}
    pdf = emb.toPandas()
    for label, grp in pdf.groupby("label"):
        exp = np.mean(np.stack(grp["embedding"].map(lambda a: np.asarray(a, dtype=np.float64)).values), axis=0)
        assert np.allclose(got[label], exp, atol=1e-9)


def test_cost_curve_and_segments(spark):
    feats = customer_vectors(spark, SF001, "p_brand")
    assert feats.select("user_id").distinct().count() == feats.count()
    curve = sg.kmeans_cost_curve(feats, [2, 3, 4], "cosine", parallelism=2).collect()
    assert [r["k"] for r in sorted(curve, key=lambda r: r["k"])] == [2, 3, 4]
    assert all(r["cost"] >= 0 for r in curve)
    seg = sg.segment_users(feats, [3, 5], "cosine")
    per_k = {r["k"]: (r["n"], r["u"], r["mx"]) for r in seg.groupBy("k").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("u"), F.max("cluster_number").alias("mx")).collect()}
    n_users = feats.count()
    assert per_k[3][0] == per_k[3][1] == n_users and per_k[3][2] < 3
    assert per_k[5][0] == n_users and per_k[5][2] < 5


def test_sparse_item_vectors(spark):
    feats = customer_vectors(spark, SF001, "item")
    row = feats.first()
    assert row["features"].size >= 200
    from cartlens.operators.relations import load_ratings

    r = load_ratings(spark, SF001)
    nnz = sum(len(x["features"].indices) for x in feats.collect())
    assert nnz == r.where("qty != 0").count()


def test_sweep_reuses_models_and_saves_them(spark, tmp_dir):
    import os

    from cartlens.plans.segmentation import segmentation
    from cartlens.sources import load_kmeans_model

    feats = customer_vectors(spark, SF001, "p_brand")
    models = os.path.join(tmp_dir, "models")
    curve, segs = segmentation(feats, [2, 3, 4], [3, 6], "cosine", seed=9, parallelism=2, model_dir=models)
    assert sorted(r["k"] for r in curve.collect()) == [2, 3, 4]
    assert sorted(r["k"] for r in segs.select("k").distinct().collect()) == [3, 6]
    assert sorted(os.listdir(models)) == ["k-2", "k-3", "k-4", "k-6"]
    # the k=3 labels come from the saved sweep model
    m3 = load_kmeans_model(os.path.join(models, "k-3"))
    pred = {r["user_id"]: r["cluster_number"] for r in m3.setPredictionCol("cluster_number").transform(sg.nonzero_vectors(feats)).collect()}
    got = {r["user_id"]: r["cluster_number"] for r in segs.where("k = 3").collect()}
    assert got == pred


def test_every_user_is_labelled_or_reported(spark):
    rows = [(i, Vectors.dense([float(i % 5), 1.0])) for i in range(40)] + [(100 + i, Vectors.dense([0.0, 0.0])) for i in range(6)]
    df = spark.createDataFrame(rows, ["user_id", "features"])
    got = sg.segment_users(df, [2, 3], "cosine").collect()
    for k in (2, 3):
        own = {r["user_id"]: r for r in got if r["k"] == k}
        assert own.keys() == {i for i, _ in rows}
        assert all((r["cluster_number"] is None) == (r["reason"] == sg.ZERO_VECTOR) == (u >= 100) for u, r in own.items())
    assert {r["reason"] for r in sg.segment_users(df, [2], "euclidean").collect()} == {None}


def test_fit_does_not_follow_the_partitions(spark):
    feats = customer_vectors(spark, SF001, "p_brand").persist()
    costs = [[r["cost"] for r in sg.kmeans_cost_curve(feats.repartition(n), [4, 7], "cosine").collect()] for n in (1, 13)]
    assert costs[0] == pytest.approx(costs[1], rel=1e-12)  # up to the order of sums
    feats.unpersist()


def test_zero_vectors_have_no_nearest_centroid(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 0.1])], "id long, vector array<double>")
    cents = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 5.0])], "cluster int, centroid array<double>")
    got = {r["id"]: (r["cluster"], r["distance"]) for r in sg.assign_nearest_centroid(points, cents).collect()}
    assert got[1] == (None, None) and got[2] == (2, pytest.approx(0.0)) and got[3][0] == 1
    assert {r["cluster"] for r in sg.assign_nearest_centroid(points, cents, "euclidean").collect()} == {0, 1}
    for distance in ("cosine", "euclidean"):  # in blocks of two as in one array
        one, two = (sorted(map(tuple, sg.assign_nearest_centroid(points, cents, distance, max_centroids=n).collect())) for n in (10, 2))
        assert one == two


def test_sparse_vector_expression(spark):
    from cartlens.operators.vectors import sparse_vector

    df = spark.createDataFrame([([1, 4], [2.5, float("nan")]), ([], []), ([0], [float("inf")])], "i array<int>, v array<double>")
    got = [r[0] for r in df.select(sparse_vector(6, F.col("i"), F.col("v"))).collect()]
    assert got[0].size == 6 and list(got[0].indices) == [1, 4] and got[0].values[0] == 2.5 and np.isnan(got[0].values[1])
    assert got[1] == Vectors.sparse(6, [], []) and got[2].values[0] == float("inf")

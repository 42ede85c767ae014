"""Customer segmentation with K-means: cost sweeps, assignment, centroids.

The vectors are persisted once per sweep and unpersisted afterwards; each
fit is Spark ML's distributed K-means (centroids broadcast per iteration,
partial sums reduced).  Nearest-centroid scoring for given centroids runs as
built-in array expressions against one small array of centroids (``k x d``
numbers, a bound set by parameters) — no join of points with centroids.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.operators.nearest import nearest_in_blocks
from cartlens.operators.recommend import DEFAULT_SEED
from cartlens.operators.sparse_kmeans import parts_of, sparse_kmeans
from cartlens.session import store

# Fixed values of the workload: cosine sweep over k = 2..45 and segment
# outputs at k = 20, 30, 40; Euclidean sweep over k = 2..20.
COSINE_SWEEP = tuple(range(2, 46))
SEGMENT_KS = (20, 30, 40)
EUCLIDEAN_SWEEP = tuple(range(2, 21))
MAX_CENTROIDS = 10_000


# K-means|| samples per partition of a fit's cached input, so their number belongs to
# the answer: it follows from the number of rows, never from the cluster.  Each iteration
# of a fit deals its sums from all partitions to as many, the square of their number in
# shuffle blocks, so beyond some partitions these take more rows before there are more.
ROWS_PER_PARTITION = 10_000
FULL_PARTITIONS, MOST_ROWS = 24, 200_000
#: Numbers in a sweep's largest set of centroids, beyond which sparse vectors by cosine distance
#: are met in blocks (:mod:`cartlens.operators.sparse_kmeans`): Spark's fit ships so many sums from each
#: partition in each iteration, through the driver.
WIDE = 1 << 23
MAX_ITER, TOL = 20, 1e-4
#: Fits that run side by side on one cached copy of the vectors.
FITS_AT_A_TIME = 8
#: Fewer where they would hold more vectors than this together.
ROWS_IN_FLIGHT = 8_000_000
ZERO_VECTOR = "zero vector"


def fit_partitions(rows: int) -> int:
    """Partitions of a fit on so many rows."""
    return max(1, min(-(-rows // ROWS_PER_PARTITION), max(FULL_PARTITIONS, -(-rows // MOST_ROWS))))


def _fit_input(data: DataFrame, id_col: str, partitions: int | None) -> DataFrame:
    """Stored vectors dealt by id into sorted partitions, as many as given or as their number
    asks for, cached: a fit sees the same rows in the same places whatever the cluster."""
    if partitions is None:
        partitions = fit_partitions(data.count())
    return data.repartition(partitions, id_col).sortWithinPartitions(id_col).persist(StorageLevel.MEMORY_AND_DISK)


def is_zero(features_col: str = "features") -> Column:
    """All-zero vectors: cosine distance is undefined for them.  A sparse vector is asked
    for its entries only."""
    return ~F.exists(parts_of(features_col)["values"], lambda x: x != F.lit(0.0))


def nonzero_vectors(features: DataFrame, features_col: str = "features") -> DataFrame:
    return features.where(~is_zero(features_col))


def fit_kmeans(
    features: DataFrame,
    k: int,
    distance: str = "cosine",
    seed: int = DEFAULT_SEED,
    max_iter: int = MAX_ITER,
    tol: float = TOL,
    features_col: str = "features",
) -> KMeansModel:
    """K-means|| initialisation with 2 steps, up to 20 iterations."""
    km = KMeans(
        k=k,
        distanceMeasure=distance,
        seed=seed,
        maxIter=max_iter,
        tol=tol,
        initMode="k-means||",
        initSteps=2,
        featuresCol=features_col,
        predictionCol="cluster_number",
    )
    return km.fit(features)


def _wide_shape(rows: DataFrame, ks: list[int], features_col: str) -> tuple[int, int, int] | None:
    """Positions, rows and entries of vectors whose centroids are too wide for Spark's fit; none
    where they aren't, or where some vector is dense."""
    v = parts_of(features_col)
    found = rows.agg(F.max(v["type"]).alias("dense"), F.max(v["size"]).alias("dim"), F.count(F.lit(1)).alias("n"), F.sum(F.size(v["indices"])).alias("cells")).first()
    if found["dense"] != 0 or found["dim"] * max(ks, default=0) <= WIDE:
        return None
    return found["dim"], found["n"], found["cells"]


def kmeans_sweep(
    features: DataFrame,
    ks: Iterable[int],
    distance: str = "cosine",
    seed: int = DEFAULT_SEED,
    parallelism: int = FITS_AT_A_TIME,
    segment_ks: Iterable[int] = (),
    model_dir: str | None = None,
    id_col: str = "user_id",
    features_col: str = "features",
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """One fit per k in ``ks`` ∪ ``segment_ks``.

    Returns the cost curve ``(k INT, distance STRING, cost DOUBLE)`` over
    ``ks`` and, when ``segment_ks`` is given, the labels ``(k, cluster_number,
    user_id, reason)`` of those models — a segment k that is also swept reuses
    the sweep's model.  Every id of ``features`` is in them: one that can't be
    labelled (a zero vector, for cosine) has a null cluster and a reason.  With
    ``model_dir`` every model is saved to ``model_dir/k-<k>``.

    The cost list has one number per k (a parameter-sized result), so it is
    assembled on the driver; the fits are distributed jobs, run
    ``parallelism`` at a time on one cached copy of the vectors.  Sparse vectors with
    more than ``WIDE`` numbers to a model, by cosine distance and without ``model_dir``, are fitted
    in blocks instead, all models together; these draw other first points.
    """
    ks, segment_ks = list(ks), list(segment_ks)
    todo = ks + [k for k in segment_ks if k not in ks]
    rows = features.select(id_col, features_col)
    if distance == "cosine":
        rows = store(rows.withColumn("__zero", is_zero(features_col)))
        left_out = rows.where("__zero").select(id_col)
        rows = rows.where("not __zero").drop("__zero")
    else:
        rows, left_out = store(rows), None
    schema = T.StructType(
        [T.StructField("k", T.IntegerType()), T.StructField("distance", T.StringType()), T.StructField("cost", T.DoubleType())]
    )

    def with_left_out(labels: DataFrame, k: int) -> DataFrame:
        labels = labels.select(F.lit(k).cast("int").alias("k"), F.col("cluster_number").cast("int").alias("cluster_number"), id_col, F.lit(None).cast("string").alias("reason"))
        if left_out is None:
            return labels
        return labels.unionByName(left_out.select(F.lit(k).cast("int").alias("k"), F.lit(None).cast("int").alias("cluster_number"), id_col, F.lit(ZERO_VECTOR).alias("reason")))

    shape = _wide_shape(rows, todo, features_col) if distance == "cosine" and not model_dir else None
    if shape:
        costs, labels = sparse_kmeans(rows, *shape, todo, seed, MAX_ITER, TOL, segment_ks, id_col, features_col)
        curve = features.sparkSession.createDataFrame([(k, distance, costs[k]) for k in ks], schema)
        return curve, reduce(DataFrame.unionByName, [with_left_out(labels.where(F.col("k") == k), k) for k in segment_ks]) if segment_ks else None
    data = _fit_input(rows, id_col, partitions)
    try:

        def one(k: int):
            # a frame that isn't cached itself, so that the fit holds its vectors as such: from the cached
            # frame each of its iterations would decode all rows again
            model = fit_kmeans(data.select(features_col), k, distance, seed, features_col=features_col)
            if model_dir:
                model.write().overwrite().save(f"{model_dir.rstrip('/')}/k-{k}")
            labels = None
            if k in segment_ks:
                labels = with_left_out(model.transform(data), k)
                # frozen before the cached vectors are released, and one model at a time
                labels = store(labels)
            return k, float(model.summary.trainingCost), labels

        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, ROWS_IN_FLIGHT // max(1, data.count())))) as pool:
            fitted = list(pool.map(one, todo))
    finally:
        data.unpersist()
    parts = [labels for _, _, labels in fitted if labels is not None]
    segments = reduce(DataFrame.unionByName, parts) if parts else None
    curve_rows = [(k, distance, cost) for k, cost, _ in fitted if k in ks]
    curve = features.sparkSession.createDataFrame(curve_rows, schema)
    return curve, segments


def kmeans_cost_curve(
    features: DataFrame,
    ks: Iterable[int],
    distance: str = "cosine",
    seed: int = DEFAULT_SEED,
    parallelism: int = FITS_AT_A_TIME,
    features_col: str = "features",
    model_dir: str | None = None,
    id_col: str = "user_id",
    partitions: int | None = None,
) -> DataFrame:
    """``(k INT, distance STRING, cost DOUBLE)``: training cost of a fit per k."""
    return kmeans_sweep(
        features, ks, distance, seed, parallelism, model_dir=model_dir, id_col=id_col, features_col=features_col, partitions=partitions
    )[0]


def segment_users(
    features: DataFrame,
    ks: Iterable[int] = SEGMENT_KS,
    distance: str = "cosine",
    seed: int = DEFAULT_SEED,
    id_col: str = "user_id",
    features_col: str = "features",
    parallelism: int = FITS_AT_A_TIME,
    model_dir: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Fit one model per k and label every user: ``(k, cluster_number, user_id,
    reason)``, see :func:`kmeans_sweep`."""
    return kmeans_sweep(
        features, [], distance, seed, parallelism, segment_ks=ks, model_dir=model_dir, id_col=id_col, features_col=features_col, partitions=partitions
    )[1]


def model_centroids(model: KMeansModel) -> DataFrame:
    """``(cluster_number INT, centroid ARRAY<DOUBLE>)`` of a fitted model."""
    spark = model.summary.predictions.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    schema = T.StructType(
        [T.StructField("cluster_number", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.DoubleType()))]
    )
    return spark.createDataFrame(rows, schema)


def stored_centroids(spark: SparkSession, model_dir: str) -> DataFrame:
    """``(k INT, cluster_number INT, centroid ARRAY<DOUBLE>)`` of all models that a sweep
    saved under ``model_dir`` (as ``k-<k>``), read as one table."""
    data = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{model_dir.rstrip('/')}/k-*/data")
    k = F.regexp_extract(F.col("_metadata.file_path"), r"/k-(\d+)/data/", 1).cast("int").alias("k")
    return data.select(k, F.col("clusterIdx").cast("int").alias("cluster_number"), vector_to_array("clusterCenter").alias("centroid"))


def label_by_stored(points: DataFrame, centroids: DataFrame, ks: Iterable[int], distance: str = "cosine", id_col: str = "user_id", features_col: str = "features") -> DataFrame:
    """``(k, cluster_number, user_id, distance)``: every point labelled with the centroids
    of each stored model; a point without a nearest one has nulls.  Summed over a model's
    points ``distance`` is its cost."""
    rows = store(points.select(id_col, vector_to_array(features_col).alias("vector")))
    parts = []
    for k in ks:
        own = centroids.where(F.col("k") == k).select("cluster_number", "centroid")
        found = assign_nearest_centroid(rows, own, distance, id_col=id_col, cluster_col="cluster_number")
        parts.append(found.select(F.lit(k).cast("int").alias("k"), "cluster_number", id_col, "distance"))
    return reduce(DataFrame.unionByName, parts)


def label_centroids(points: DataFrame, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """Mean vector per label: ``(label, centroid ARRAY<DOUBLE>)``.

    Per-position sums are combined map-side on (label, position), so the
    shuffle carries labels x dimensions rows per task.
    """
    exploded = points.select(label_col, F.posexplode(vector_col).alias("__p", "__v"))
    means = exploded.groupBy(label_col, "__p").agg(F.avg(F.col("__v").cast("double")).alias("__m"))
    return means.groupBy(label_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__p", "__m"))), lambda s: s["__m"]).alias("centroid")
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def assign_nearest_centroid(
    points: DataFrame,
    centroids: DataFrame,
    distance: str = "cosine",
    id_col: str = "id",
    vector_col: str = "vector",
    cluster_col: str = "cluster",
    max_centroids: int = MAX_CENTROIDS,
) -> DataFrame:
    """Nearest centroid per point (ties: smaller cluster id) and its distance:
    ``(id, cluster, distance)``.  The summed ``distance`` is the K-means cost.
    Cosine distance is ``1 - x.c / (|x| |c|)``, Euclidean distance is squared.

    A zero point has no cosine distance, so its cluster and distance are null; a
    zero centroid is never nearest.  Up to ``max_centroids`` centroids become one array,
    which every task holds; more are met in blocks of that size
    (:mod:`cartlens.operators.nearest`), with the same answer.  Each vector's norm is
    computed once, not for each pair.
    """
    if distance not in ("cosine", "euclidean"):
        raise ValueError("distance must be 'cosine' or 'euclidean'")
    count = centroids.select(F.count(F.lit(1)).alias("n")).first()["n"]  # a number, before anything is gathered
    if count > max_centroids:
        return nearest_in_blocks(points, centroids, distance, id_col, vector_col, cluster_col, max_centroids)
    v = F.col("centroid").cast("array<double>")
    entry = F.struct(F.col(cluster_col).alias("c"), v.alias("v"), _norm(v).alias("n"))
    table = centroids.select(F.array_sort(F.collect_list(entry))).scalar()
    x = F.col(vector_col).cast("array<double>")
    # the sub-query is projected first: lambdas cannot hold sub-queries
    staged = points.select(id_col, x.alias("__x"), _norm(x).alias("__n"), table.alias("__cents"))
    px, pn = F.col("__x"), F.col("__n")
    if distance == "cosine":
        away = lambda c: F.lit(1.0) - F.try_divide(_dot(px, c["v"]), pn * c["n"])
    else:
        away = lambda c: _sq_dist(px, c["v"])
    scored = F.transform("__cents", lambda c: F.struct(away(c).alias("d"), c["c"].alias("c")))
    best = F.array_min(F.filter(scored, lambda s: s["d"].isNotNull()))
    return staged.select(id_col, best["c"].alias(cluster_col), best["d"].alias("distance"))

"""Cross-validated recommendation quality (the three evaluation programs).

Shape of every variant::

    ratings --(optional scope join / best-seller filter)--> active users
            --> per-user folds (distributed rank), stored once by scope and fold
            --> for each (scope, fold): fit on the other folds, top-30 for all users,
                reduced at once to its K score rows, the factors released
            --> mean over folds, F1 of the means

The driver holds the loop over (scope, fold) fits and a few numbers from each; the
plan of a fit doesn't grow with their number.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.metrics import safe_ratio
from cartlens.operators.evaluate import KS, cv_summary, precision_recall_at_k
from cartlens.operators.folds import N_FOLDS, assign_folds
from cartlens.operators.ratings import (
    ACTIVE_MIN_RATINGS,
    TOP_SHARE,
    filter_active_users,
    join_clusters,
    semi_join_items,
    top_share_items,
)
from cartlens.operators.recommend import (
    DEFAULT_SEED,
    TOP_N,
    IdCodec,
    fit_blocks,
    fit_implicit_als,
    popular_lists,
    recommend_lists,
    release,
)
from cartlens.session import discard, free_unused, store

#: Fits that run side by side; a fit on little data leaves most of a cluster idle.  More of
#: them do where all their rows together stay below a number.
FITS_AT_A_TIME, MOST_FITS = 8, 24
ROWS_AT_A_TIME = 32_000_000
#: Fewer where they would hold more rows than this: each has its blocks in memory and its
#: shuffles on disk.
ROWS_IN_FLIGHT = 80_000_000
#: A fit beside others needs no tasks for a whole cluster, and the factors that it sends from each
#: block to each grow with their number.
RATINGS_PER_BLOCK = 4_000_000
#: Rows that have been fitted before the shuffles of fits that ended are dropped.
ROWS_TO_A_SWEEP = 8_000_000
ROWS_PER_FILE = 2_000_000


def prepare_folds(
    ratings: DataFrame,
    n_folds: int = N_FOLDS,
    min_rows: int = ACTIVE_MIN_RATINGS,
    scope_col: str | None = None,
) -> DataFrame:
    """Active users, folded.  With a scope, a user's rows are counted and folded in
    each scope by itself, so one who is in two scopes is two users."""
    scopes = (scope_col,) if scope_col else ()
    active = filter_active_users(ratings, min_rows, scope_cols=scopes)
    return store(assign_folds(active, n_folds=n_folds, scope_cols=scopes))


def fits_at_a_time(rows: int) -> int:
    """How many fits on at most ``rows`` rows run side by side."""
    return max(FITS_AT_A_TIME, min(MOST_FITS, ROWS_AT_A_TIME // max(1, rows)))


def blocks_beside_others(rows: int) -> int:
    """Blocks of a fit on so many rows that runs beside others."""
    return max(1, min(fit_blocks(rows), -(-rows // RATINGS_PER_BLOCK)))


def fits_in_flight(rows: int) -> int:
    """:func:`fits_at_a_time`, or more where these have few blocks, bounded by the rows that they hold."""
    few = max(fits_at_a_time(rows), MOST_FITS // blocks_beside_others(rows))
    return max(1, min(few, ROWS_IN_FLIGHT // max(1, rows)))


def als_fold_scores(
    folded: DataFrame,
    n_folds: int = N_FOLDS,
    ks: Sequence[int] = KS,
    top_n: int = TOP_N,
    seed: int = DEFAULT_SEED,
    scope_col: str | None = None,
    parallelism: int | None = None,
    als_params: dict | None = None,
) -> DataFrame:
    """``([scope,] fold, k, n_hits, n_rec, n_test, precision, recall)`` of one ALS model
    for every (scope, fold).

    Users and items are encoded to dense ids once, and counted by scope and fold once, for
    all fits.  ``parallelism`` fits (default: by their rows) run at a time; each leaves one
    row for each K and releases its factors, so the answer doesn't hang on it.  Scopes are a
    list on the driver, as each is a loop of fits.
    """
    scopes = [scope_col] if scope_col else []
    codec = IdCodec(folded)
    encoded = codec.encode(folded).select(*scopes, "fold", IdCodec.USER, IdCodec.ITEM, "qty")
    # each fit reads some scopes and folds of it: a folder for each, written by a few tasks
    n_parts = max(1, -(-folded.count() // ROWS_PER_FILE))
    encoded = encoded.repartition(*[*scopes, "fold"], F.pmod(F.xxhash64(IdCodec.USER), F.lit(n_parts)))
    encoded = store(encoded, partition_by=[*scopes, "fold"])
    rows = {(r[0] if scopes else None, r["fold"]): r["count"] for r in encoded.groupBy(*scopes, "fold").count().collect()}
    values = sorted({s for s, _ in rows}) if scopes else [None]
    totals = {s: sum(n for (other, _), n in rows.items() if other == s) for s in values}
    params = als_params or {}

    def fit(task: tuple) -> list[tuple]:
        scope, fold = task
        n_train = totals[scope] - rows.get(task, 0)
        if not n_train:
            return []
        own = encoded if scope is None else encoded.where(F.col(scope_col) == F.lit(scope))
        train, test = own.where(F.col("fold") != fold), own.where(F.col("fold") == fold)
        given = {"num_blocks": blocks_beside_others(n_train)} | params
        model = fit_implicit_als(train, seed=seed, user_col=IdCodec.USER, item_col=IdCodec.ITEM, n_ratings=n_train, **given)
        # stored, as the lists are read for their sizes and for the hits
        lists = store(recommend_lists(model, top_n, IdCodec.USER, IdCodec.ITEM))
        release(model)
        found = precision_recall_at_k(lists.withColumn("fold", F.lit(fold)), test, ks, by=["fold"], user_col=IdCodec.USER, item_col=IdCodec.ITEM).collect()
        discard(lists)
        return [(*([scope] if scopes else []), fold, r.k, r.n_hits, r.n_rec, r.n_test) for r in found]

    waiting, lock = 0, Lock()

    def run(task: tuple) -> list[tuple]:
        nonlocal waiting
        found = fit(task)
        with lock:  # the fit's own frames are gone here, so its shuffles can go too
            waiting += totals[task[0]]
            swept = waiting >= ROWS_TO_A_SWEEP
            waiting = 0 if swept else waiting
        if swept:
            free_unused(folded.sparkSession)
        return found

    tasks = [(s, b) for s in values for b in range(n_folds)]
    most = max((totals[s] - rows.get((s, b), 0) for s, b in tasks), default=0)
    with ThreadPoolExecutor(max_workers=parallelism or fits_in_flight(most)) as pool:
        found = list(pool.map(run, tasks))
    counts = [T.StructField(c, T.LongType()) for c in ("n_hits", "n_rec", "n_test")]
    schema = T.StructType([*[folded.schema[c] for c in scopes], T.StructField("fold", T.IntegerType()), T.StructField("k", T.IntegerType()), *counts])
    scores = folded.sparkSession.createDataFrame([row for rows in found for row in rows], schema)
    return scores.withColumn("precision", safe_ratio(F.col("n_hits"), F.col("n_rec"))).withColumn("recall", safe_ratio(F.col("n_hits"), F.col("n_test")))


def evaluate_cv(
    ratings: DataFrame,
    recommender: str = "als",
    n_folds: int = N_FOLDS,
    ks=KS,
    top_n: int = TOP_N,
    seed: int = DEFAULT_SEED,
    scope_col: str | None = None,
    parallelism: int | None = None,
    als_params: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Per-fold scores and their summary for ``recommender`` in {"als", "popular"}."""
    scopes = [scope_col] if scope_col else []
    folded = prepare_folds(ratings, n_folds, scope_col=scope_col)
    if recommender == "als":
        scores = als_fold_scores(folded, n_folds, ks, top_n, seed, scope_col, parallelism, als_params)
    elif recommender == "popular":
        lists = popular_lists(folded, top_n, n_folds, scope_cols=tuple(scopes))
        scores = precision_recall_at_k(lists, folded, ks, by=[*scopes, "fold"])
    else:
        raise ValueError("recommender must be 'als' or 'popular'")
    return scores, cv_summary(scores, by=scopes)


def evaluate_cv_top_sellers(ratings: DataFrame, share: float = TOP_SHARE, **kwargs) -> tuple[DataFrame, DataFrame]:
    """Same evaluation restricted to the best-selling share of items
    (filtered before the active-user rule)."""
    ratings = store(ratings)  # read for the totals and for the filter
    return evaluate_cv(semi_join_items(ratings, top_share_items(ratings, share)), **kwargs)


def evaluate_cv_by_cluster(ratings: DataFrame, clusters: DataFrame, **kwargs) -> tuple[DataFrame, DataFrame]:
    """Same evaluation inside every cluster; scores keyed by ``cluster_number``.
    Clusters without active users produce no rows."""
    return evaluate_cv(join_clusters(ratings, clusters), scope_col="cluster_number", **kwargs)

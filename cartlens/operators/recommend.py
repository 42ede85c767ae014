"""Recommenders: implicit-feedback ALS (the model the workload uses) and a
deterministic most-popular recommender with the same output shape, which
lets the evaluation chain be checked exactly against SQL.

Recommendation frames are long: ``(user_id, rank, item_id, score)`` with a
0-based ``rank``; when produced per fold they also carry ``fold``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.operators.ranking import top_n_per_group
from cartlens.operators.ratings import index_items, int32
from cartlens.operators.unseen import best_lists, top_n_unseen
from cartlens.session import free_unused, store

# Fixed values of the workload: implicit ALS with rank 10, 10 iterations,
# lambda 0.01, alpha 1.0, and 30 recommendations per user.
ALS_RANK = 10
ALS_MAX_ITER = 10
ALS_REG_PARAM = 0.01
ALS_ALPHA = 1.0
TOP_N = 30
DEFAULT_SEED = 42
# Starting factors are drawn per block of users and of items, so their number belongs to
# the answer: it follows from the number of ratings, never from the cluster.  A block of
# so many ratings keeps well under executor memory, and few blocks keep the exchange
# of factors between all pairs of blocks small.
# A half step sends each row of factors to every block that needs it, so beyond some
# blocks these take more ratings before there are more.
RATINGS_PER_BLOCK = 500_000
FULL_BLOCKS, MOST_RATINGS = 8, 32_000_000
# A task builds its block of ratings in memory (some 50 bytes each), so a fit has more blocks where
# one would hold more than this.
BLOCK_RATINGS = 16_000_000
# Every iteration of a fit leaves its exchange of factors on disk until the next checkpoint of the
# factors, so a fit on more ratings than this checkpoints each time.
SMALL_FIT = 4_000_000


def als_blocks(ratings: DataFrame | int) -> int:
    """Blocks for a fit on ``ratings`` (rows or their number), by their number."""
    n = ratings if isinstance(ratings, int) else ratings.count()
    return max(1, min(-(-n // RATINGS_PER_BLOCK), max(FULL_BLOCKS, -(-n // MOST_RATINGS))))


def fit_blocks(n: int) -> int:
    """Blocks of a fit on ``n`` ratings that are bounded in memory too."""
    return max(als_blocks(n), -(-n // BLOCK_RATINGS))


def checkpoint_interval(n: int, max_iter: int = ALS_MAX_ITER) -> int:
    """Iterations between two checkpoints of a fit on ``n`` ratings."""
    return 1 if n > SMALL_FIT else max(1, max_iter)


def fit_implicit_als(
    ratings: DataFrame,
    rank: int = ALS_RANK,
    max_iter: int = ALS_MAX_ITER,
    reg_param: float = ALS_REG_PARAM,
    alpha: float = ALS_ALPHA,
    seed: int = DEFAULT_SEED,
    user_col: str = "user_id",
    item_col: str = "item_id",
    rating_col: str = "qty",
    num_blocks: int | None = None,
    n_ratings: int | None = None,
) -> ALSModel:
    """Fit implicit ALS.  Ids must fit in 32 bits, or the fit raises
    (:class:`IdCodec` and ``recommend_top_n`` map any others).  ``num_blocks`` follows
    from the number of ratings (:func:`fit_blocks`), which is counted unless given."""
    n_ratings = ratings.count() if n_ratings is None else n_ratings
    if num_blocks is None:
        num_blocks = fit_blocks(n_ratings)
    als = ALS(
        rank=rank,
        maxIter=max_iter,
        regParam=reg_param,
        alpha=alpha,
        implicitPrefs=True,
        seed=seed,
        userCol=user_col,
        itemCol=item_col,
        ratingCol=rating_col,
        numUserBlocks=num_blocks,
        numItemBlocks=num_blocks,
        checkpointInterval=checkpoint_interval(n_ratings, max_iter),
        coldStartStrategy="nan",
    )
    data = ratings.select(
        int32(user_col).alias(user_col),
        int32(item_col).alias(item_col),
        F.col(rating_col).cast("float").alias(rating_col),
    )
    return als.fit(data)


def release(model: ALSModel) -> None:
    """Drop the cached factors of a model that isn't needed any more: the nearest cached
    data below its two factor tables, nobody else's."""
    for factors in (model.userFactors, model.itemFactors):
        todo = [factors._jdf.rdd()]
        while todo:
            data = todo.pop()
            level = data.getStorageLevel()
            if level.useMemory() or level.useDisk():
                data.unpersist(False)
                continue
            below = data.dependencies()
            todo += [below.apply(i).rdd() for i in range(below.size())]


def _factors(model: ALSModel, user_col: str, item_col: str) -> tuple[DataFrame, DataFrame]:
    return model.userFactors.withColumnRenamed("id", user_col), model.itemFactors.withColumnRenamed("id", item_col)


def recommend_lists(model: ALSModel, n: int = TOP_N, user_col: str = "user_id", item_col: str = "item_id") -> DataFrame:
    """``(user_id, items)``: the same lists with one row for each user, best first."""
    return best_lists(*_factors(model, user_col, item_col), None, n, user_col, item_col).select(user_col, "items")


def recommend_all_users(
    model: ALSModel, n: int = TOP_N, user_col: str = "user_id", item_col: str = "item_id"
) -> DataFrame:
    """Top-``n`` items for every user the model knows, items already bought
    included.  Long form ``(user_id BIGINT, rank INT, item_id BIGINT, score DOUBLE)``.

    The products are those of the model's own ``recommendForAllUsers``, met in large groups
    (:mod:`cartlens.operators.unseen`): the model's way ships ``n`` entries for each user and
    each partition of items, and scores one user at a time."""
    return top_n_unseen(*_factors(model, user_col, item_col), None, n, user_col, item_col)


def recommend_unseen(
    model: ALSModel, seen: DataFrame, n: int = TOP_N, user_col: str = "user_id", item_col: str = "item_id"
) -> DataFrame:
    """Top-``n`` items for every user the model knows, without the items that ``seen``
    pairs with the user; the form of :func:`recommend_all_users`."""
    return top_n_unseen(*_factors(model, user_col, item_col), seen, n, user_col, item_col)


def normal_equation_residuals(
    user_factors: DataFrame,
    item_factors: DataFrame,
    ratings: DataFrame,
    rank: int = ALS_RANK,
    reg_param: float = ALS_REG_PARAM,
    alpha: float = ALS_ALPHA,
    user_col: str = "user_id",
    item_col: str = "item_id",
    rating_col: str = "qty",
    factor_col: str = "features",
) -> DataFrame:
    """``(user_id, n_ratings, residual)``: how far each user's factors are from solving the
    equations of implicit ALS's last half step, ``A x = b`` with

        A = sum over all items of y y' + sum over the user's of c y y' + reg n I
        b = sum over the user's of (1 + c) y,   c = alpha |rating|

    (``n`` and ``b`` over positive ratings); ``residual`` is the greatest coordinate of
    ``A x - b`` against that of ``b``.  With exact arithmetic it is 0 for a fitted model; its
    factors are single precision.  A user of ``ratings`` without factors has a null
    residual.

    The items' Gram matrix is one aggregate of ``rank * (rank + 1) / 2`` sums; a user's
    products are summed per coordinate, combined before the shuffle.
    """
    if rank < 1:
        raise ValueError("rank must be at least 1")
    # factors travel as they are, and are doubles where they are used
    y, x = (lambda p: F.get("y", p).cast("double")), (lambda p: F.get("x", p).cast("double"))
    items = item_factors.select(F.col(item_col).cast("bigint").alias("i"), F.col(factor_col).alias("y"))
    users = user_factors.select(F.col(user_col).cast("bigint").alias("u"), F.col(factor_col).alias("x"))
    gram = items.agg(*[F.sum(y(p) * y(q)).alias(f"g{p}_{q}") for p in range(rank) for q in range(p, rank)])
    gram = gram.select(F.struct(*gram.columns)).scalar()
    c, positive = F.lit(alpha) * F.abs("r"), F.col("r") > 0
    rows = ratings.select(F.col(user_col).cast("bigint").alias("u"), F.col(item_col).cast("bigint").alias("i"), F.col(rating_col).cast("float").cast("double").alias("r"))
    rows = rows.join(items, "i").join(users, "u", "left")
    dot = reduce(lambda a, b: a + b, [x(p) * y(p) for p in range(rank)])
    rows = rows.withColumn("c", c).withColumn("xy", dot).withColumn("w", F.when(positive, F.col("c") + 1).otherwise(0.0))
    sums = rows.groupBy("u").agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.sum(positive.cast("int")).alias("n"),
        F.first("x").alias("x"),
        *[F.sum(F.col("c") * F.col("xy") * y(p)).alias(f"a{p}") for p in range(rank)],
        *[F.sum(F.col("w") * y(p)).alias(f"b{p}") for p in range(rank)],
    ).withColumn("g", gram)
    whole = lambda p: reduce(lambda a, b: a + b, [F.col("g")[f"g{min(p, q)}_{max(p, q)}"] * x(q) for q in range(rank)])
    off = [F.abs(whole(p) + F.col(f"a{p}") + F.lit(reg_param) * F.col("n") * x(p) - F.col(f"b{p}")) for p in range(rank)]
    most = lambda cols: F.array_max(F.array(*cols))
    known = F.when(F.col("x").isNotNull(), F.try_divide(most(off), most([F.abs(f"b{p}") for p in range(rank)])))
    return sums.select(F.col("u").alias(user_col), "n_ratings", known.alias("residual"))


class IdCodec:
    """Collision-free dictionaries mapping user and item ids to dense 32-bit
    ids for ALS, built with a distributed sort (``index_items``), and the
    inverse mapping for recommendation lists.  The dictionary joins are left
    to the planner: broadcast only when their measured size is small."""

    USER, ITEM = "__user_idx", "__item_idx"

    def __init__(self, ratings: DataFrame, user_col: str = "user_id", item_col: str = "item_id"):
        self.user_col, self.item_col = user_col, item_col
        self.users = index_items(ratings, item_col=user_col, index_col=self.USER)
        self.items = index_items(ratings, item_col=item_col, index_col=self.ITEM)

    def encode(self, ratings: DataFrame) -> DataFrame:
        """Add the two dense id columns."""
        return ratings.join(self.users, self.user_col).join(self.items, self.item_col)

    def decode(self, recs: DataFrame) -> DataFrame:
        """``(__user_idx, rank, __item_idx, score)`` -> original ids."""
        users = self.users.select(F.col(self.USER).cast("bigint").alias(self.USER), self.user_col)
        items = self.items.select(F.col(self.ITEM).cast("bigint").alias(self.ITEM), self.item_col)
        out = recs.join(users, self.USER).join(items, self.ITEM)
        return out.select(self.user_col, "rank", self.item_col, "score")


def recommend_top_n(
    ratings: DataFrame,
    n: int = TOP_N,
    user_col: str = "user_id",
    item_col: str = "item_id",
    rating_col: str = "qty",
    encode_ids: bool = True,
    exclude_seen: bool = False,
    **als_kwargs,
) -> DataFrame:
    """Fit implicit ALS and return the top-``n`` list of every user; with
    ``exclude_seen`` without the items that the user has a rating for.

    Ids of any type and width are mapped through collision-free dictionaries
    and back.  ``encode_ids=False`` is for ids that are 32-bit numbers already;
    the fit raises if one is not.
    """
    def lists(own: DataFrame, user: str, item: str) -> DataFrame:
        own = store(own)  # counted, then read by the fit and for the mask
        model = fit_implicit_als(own, user_col=user, item_col=item, rating_col=rating_col, **als_kwargs)
        # stored, so that nothing of the fit (its blocks of ratings, its shuffles) is held any more
        users, items = (store(factors) for factors in _factors(model, user, item))
        release(model)
        del model
        free_unused(own.sparkSession)
        return top_n_unseen(users, items, own if exclude_seen else None, n, user, item)

    if not encode_ids:
        return lists(ratings, user_col, item_col)
    codec = IdCodec(ratings, user_col, item_col)
    own = codec.encode(ratings).select(IdCodec.USER, IdCodec.ITEM, rating_col)
    return codec.decode(lists(own, IdCodec.USER, IdCodec.ITEM))


def truncate_top_k(recs: DataFrame, k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` entries of every ranked list."""
    return recs.where(F.col(rank_col) < k)


def top_n_per_user(
    scores: DataFrame, n: int, user_col: str = "user_id", item_col: str = "item_id", score_col: str = "score"
) -> DataFrame:
    """Best ``n`` items per user by score, ties by item id; 0-based ``rank``."""
    return top_n_per_group(
        scores.select(user_col, item_col, score_col),
        [user_col],
        [F.col(score_col).desc(), F.col(item_col).asc()],
        n,
    )


def popular_items_per_fold(
    folded: DataFrame,
    n: int = TOP_N,
    n_folds: int = 10,
    item_col: str = "item_id",
    qty_col: str = "qty",
    fold_col: str = "fold",
    scope_cols: tuple[str, ...] = (),
) -> DataFrame:
    """For every fold, the ``n`` items with the largest quantity in the *other*
    folds (ties by item id): ``(scope.., fold, rank, item_id, score)``.

    Training totals are ``total - total in fold`` over an items x folds grid,
    so one aggregate serves all folds.  Only items that can be among the best of some
    fold enter the grid: an item whose greatest score over the folds is below ``n`` items'
    least scores is in no list.
    """
    keys = list(scope_cols)
    per = folded.groupBy(*keys, fold_col, item_col).agg(
        F.sum(qty_col).alias("__fq"), F.count(F.lit(1)).alias("__fc")
    )
    whole = per.groupBy(*keys, item_col).agg(
        F.sum("__fq").alias("__tq"), F.sum("__fc").alias("__tc"), F.max("__fq").alias("__most"), F.min("__fq").alias("__least"), F.max("__fc").alias("__mc")
    )
    # a fold without the item takes nothing away; subtraction keeps the order when it rounds
    zero = F.lit(0.0)
    whole = store(
        whole.select(
            *keys, item_col, "__tq", "__tc", "__mc",
            (F.col("__tq") - F.greatest("__most", zero)).alias("__low"),
            (F.col("__tq") - F.least("__least", zero)).alias("__high"),
        )
    )
    everywhere = whole.where((F.col("__tc") > F.col("__mc")) & F.col("__low").isNotNull())  # trained in each fold
    reached = F.when(F.count(F.lit(1)) == n, F.min("__low")).alias("__bound")
    if keys:
        bounds = top_n_per_group(everywhere.select(*keys, "__low"), keys, [F.col("__low").desc()], n).groupBy(*keys).agg(reached)
        whole = whole.join(F.broadcast(bounds), keys, "left")
    else:
        whole = whole.withColumn("__bound", everywhere.orderBy(F.col("__low").desc()).limit(n).agg(reached).scalar())
    whole = whole.where(F.col("__bound").isNull() | (F.col("__high") >= F.col("__bound")))
    grid = whole.select(*keys, item_col, "__tq", "__tc", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias(fold_col))
    train = (
        grid.join(per, [*keys, fold_col, item_col], "left")
        .select(
            *keys,
            fold_col,
            item_col,
            (F.col("__tq") - F.coalesce(F.col("__fq"), F.lit(0.0))).alias("score"),
            (F.col("__tc") - F.coalesce(F.col("__fc"), F.lit(0))).alias("__n"),
        )
        .where(F.col("__n") > 0)
        .drop("__n")
    )
    return top_n_per_group(train, [*keys, fold_col], [F.col("score").desc(), F.col(item_col).asc()], n)


def popular_lists(
    folded: DataFrame,
    n: int = TOP_N,
    n_folds: int = 10,
    user_col: str = "user_id",
    item_col: str = "item_id",
    qty_col: str = "qty",
    fold_col: str = "fold",
    scope_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Per fold, the fold's popular list for every user who has training rows in
    that fold: ``(scope.., fold, user_id, items)``, best first.

    Without scopes the lists are ``folds`` rows of at most ``n`` items, a bound set
    by parameters, so they are broadcast; with scopes the planner decides by size.
    """
    keys = list(scope_cols)
    top = popular_items_per_fold(folded, n, n_folds, item_col, qty_col, fold_col, scope_cols)
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.col(item_col).alias("item"), "score")))
    lists = top.groupBy(*keys, fold_col).agg(ranked.alias("__l"))
    lists = lists.select(*keys, fold_col, F.col("__l.item").alias("items"), F.col("__l.score").alias("scores"))
    per_fold = folded.groupBy(*keys, user_col, fold_col).agg(F.count(F.lit(1)).alias("__c"))
    per_user = per_fold.groupBy(*keys, user_col).agg(F.sum("__c").alias("__n"))
    user_folds = per_user.select(*keys, user_col, "__n", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias(fold_col))
    trained = (
        user_folds.join(per_fold, [*keys, user_col, fold_col], "left")
        .where(F.col("__n") - F.coalesce(F.col("__c"), F.lit(0)) > 0)
        .select(*keys, fold_col, user_col)
    )
    return trained.join(lists if keys else F.broadcast(lists), [*keys, fold_col], "inner").select(*keys, fold_col, user_col, "items", "scores")


def recommend_popular(
    folded: DataFrame,
    n: int = TOP_N,
    n_folds: int = 10,
    user_col: str = "user_id",
    item_col: str = "item_id",
    qty_col: str = "qty",
    fold_col: str = "fold",
    scope_cols: tuple[str, ...] = (),
    as_lists: bool = False,
) -> DataFrame:
    """:func:`popular_lists` with a row for each entry: ``(scope.., fold, user_id,
    rank, item_id, score)``; ``as_lists`` leaves a user's entries together."""
    keys = list(scope_cols)
    lists = popular_lists(folded, n, n_folds, user_col, item_col, qty_col, fold_col, scope_cols)
    if as_lists:
        return lists
    entries = lists.select(*keys, fold_col, user_col, F.posexplode(F.arrays_zip("items", "scores")).alias("rank", "e"))
    return entries.select(*keys, fold_col, user_col, F.col("rank").cast("int").alias("rank"), F.col("e.items").alias(item_col), F.col("e.scores").alias("score"))

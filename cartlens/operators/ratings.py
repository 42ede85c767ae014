"""Relational operators on ratings: dictionary ids, filters, best sellers,
cluster membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.operators.ranking import global_position, rank_within_groups
from cartlens.session import store

ACTIVE_MIN_RATINGS = 10  # fixed value: users need at least 10 rating rows (one per fold)
TOP_SHARE = 0.5  # fixed value: best sellers are the top half of the items


def user_item_pairs(df: DataFrame, user_col: str = "user_id", item_col: str = "item_id") -> DataFrame:
    """Project the (user, item) pair — the unit compared in evaluation."""
    return df.select(user_col, item_col)


def int32(c: str | Column) -> Column:
    """An id as INT; raises on null and on ids that 32 bits can't hold, whatever
    the session's ANSI setting (a plain cast would wrap and merge ids)."""
    col = F.col(c) if isinstance(c, str) else c
    message = F.concat(F.lit("id is null or beyond 32 bits: "), F.coalesce(col.cast("string"), F.lit("null")))
    return F.when(col.cast("decimal(38,0)").between(-(2**31), 2**31 - 1), col.cast("int")).otherwise(F.raise_error(message).cast("int"))


def index_items(df: DataFrame, item_col: str = "item_id", index_col: str = "item_idx") -> DataFrame:
    """Collision-free dense integer id per distinct item, in item order.

    Built with a distributed sort (no single-partition ``dense_rank``), so it
    scales with the catalogue.  Returns the dictionary ``(item, index)``.
    """
    items = df.select(item_col).where(F.col(item_col).isNotNull()).distinct()
    return global_position(items, [item_col], pos_col=index_col).select(
        item_col, int32(index_col).alias(index_col)
    )


def filter_active_users(
    df: DataFrame, min_rows: int = ACTIVE_MIN_RATINGS, user_col: str = "user_id", scope_cols: Sequence[str] = ()
) -> DataFrame:
    """Keep users with at least ``min_rows`` rows (inside their scope, if any).

    The rows are stored once: counting them and filtering them would otherwise
    derive them twice, as the two plans need different columns.  Counting is a
    partial aggregate (a hot user is pre-counted in every map task); the
    qualifying users then drive a left-semi join, which AQE can split if one
    user dominates.
    """
    keys, df = [*scope_cols, user_col], store(df)
    active = df.groupBy(*keys).count().where(F.col("count") >= min_rows).select(*keys)
    return df.join(active, keys, "left_semi")


def item_totals(df: DataFrame, item_col: str = "item_id", qty_col: str = "qty") -> DataFrame:
    """Total quantity per item."""
    return df.groupBy(item_col).agg(F.sum(qty_col).alias("total_qty"))


def count_items(df: DataFrame, item_col: str = "item_id") -> DataFrame:
    """Number of distinct items, as a one-row frame."""
    return df.agg(F.count_distinct(item_col).alias("n_items"))


def top_share_items(
    df: DataFrame, share: float = TOP_SHARE, item_col: str = "item_id", qty_col: str = "qty"
) -> DataFrame:
    """Best-selling ``floor(share x n_items)`` items by total quantity, ties by id.

    The cut is a data-dependent number (half the catalogue), so it is not a
    ``limit`` — that would funnel every candidate through one task.  Items get
    a global rank from a distributed sort; the item count comes out of the
    same ranking.
    Output ``(item_id, total_qty, sales_rank)``.
    """
    totals = item_totals(df, item_col, qty_col)
    ranked = rank_within_groups(
        totals, [], [F.col("total_qty").desc(), F.col(item_col).asc()], rank_col="sales_rank", size_col="__n_items"
    )
    # the item count comes with the ranking (no second aggregation of the totals)
    cut = F.floor(F.col("__n_items") * F.lit(share))
    return ranked.where(F.col("sales_rank") < cut).drop("__n_items")


def semi_join_items(df: DataFrame, items: DataFrame, item_col: str = "item_id") -> DataFrame:
    """Keep rows whose item is in ``items`` (left-semi; AQE broadcasts the set
    when its measured size is small)."""
    return df.join(items.select(item_col), item_col, "left_semi")


def best_seller_ratings(
    ratings: DataFrame, share: float = TOP_SHARE, min_rows: int = ACTIVE_MIN_RATINGS
) -> DataFrame:
    """Ratings on best-selling items of users still active *after* that filter
    (the best-seller filter runs first)."""
    ratings = store(ratings)  # read for the totals and for the filter
    return filter_active_users(semi_join_items(ratings, top_share_items(ratings, share)), min_rows)


def join_clusters(ratings: DataFrame, clusters: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Attach ``cluster_number`` to every rating: one join replaces a filter per cluster."""
    return ratings.join(clusters.select("cluster_number", user_col).distinct(), user_col, "inner")


def cluster_members(clusters: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Users of each cluster in long form ``(cluster_number, user_id, member_rank)``.

    Membership stays a relation — it is never gathered into one list per
    cluster, since one cluster may hold a third of all users.
    """
    members = clusters.select("cluster_number", user_col).distinct()
    return rank_within_groups(members, ["cluster_number"], [user_col], rank_col="member_rank")


def cluster_sizes(clusters: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Users per cluster plus the number of clusters (``n_clusters``) on every row."""
    sizes = clusters.select("cluster_number", user_col).distinct().groupBy("cluster_number").agg(
        F.count(F.lit(1)).alias("n_users")
    )
    n_clusters = sizes.select(F.count(F.lit(1))).scalar()
    return sizes.withColumn("n_clusters", n_clusters)

"""A user's ratings as lists of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.operators.ranking import OrderSpec, partitions_for, rank_within_groups, spread
from cartlens.session import store

CHUNK = 1000


def user_ratings_list(
    df: DataFrame,
    chunk: int = CHUNK,
    user_col: str = "user_id",
    item_col: str = "item_id",
    qty_col: str = "qty",
    order_cols: tuple[OrderSpec, ...] = ("item_id",),
) -> DataFrame:
    """``(user_id, chunk, n_ratings, ratings)``: each user's rows, in order, as lists of at
    most ``chunk`` structs ``(item_id, qty)``; chunk *c* holds places ``c * chunk`` and on,
    and ``n_ratings`` is the user's number of rows.

    Places come from a distributed sort, so one user's rows are gathered ``chunk`` at a
    time, never as a whole: a user with a third of all rows becomes many rows.
    Repeated rows are kept; a null user is a user.
    """
    if chunk < 1:
        raise ValueError("chunk must be at least 1")
    df = store(df)  # counted, then ranked
    ranked = rank_within_groups(df, [user_col], list(order_cols), rank_col="__place", size_col="__n")
    ranked = spread(ranked.withColumn("chunk", F.floor(F.col("__place") / chunk)), partitions_for(df), user_col, "chunk")
    entry = F.struct("__place", F.col(item_col).alias("item_id"), F.col(qty_col).alias("qty"))
    lists = ranked.groupBy(user_col, "chunk").agg(
        F.max("__n").alias("n_ratings"), F.array_sort(F.collect_list(entry)).alias("__list")
    )
    held = F.transform("__list", lambda e: F.struct(e["item_id"].alias("item_id"), e["qty"].alias("qty")))
    return lists.select(user_col, "chunk", "n_ratings", held.alias("ratings"))


def unlist_ratings(lists: DataFrame, user_col: str = "user_id") -> DataFrame:
    """The rows of :func:`user_ratings_list`: ``(user_id, item_id, qty)``."""
    return lists.select(user_col, F.explode("ratings").alias("r")).select(user_col, "r.item_id", "r.qty")

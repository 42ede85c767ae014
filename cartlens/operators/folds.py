"""Per-user cross-validation folds.

Each user's ``n`` rows, in item order, are cut into ``n_folds`` consecutive
slices: the first ``n_folds - n % n_folds`` slices hold ``n // n_folds`` rows
and the remaining ``n % n_folds`` hold one more (large slices last).  A row's
fold follows from its 0-based position ``r`` in the user's order and ``n``:

    q = n // F, small = F - n % F
    fold = r // q                           if r <  small * q
         = small + (r - small * q) // (q+1)  otherwise

Positions come from :func:`cartlens.operators.ranking.rank_within_groups`
(a window for users counted small, a distributed sort for others), so a user with a
third of all rows is still spread over many tasks.  Their order is total; train
and test of every fold are filters of one stored frame and can never
overlap or lose rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.operators.ranking import rank_within_groups

N_FOLDS = 10  # fixed value: ten folds per user


def fold_of(position: Column, n: Column, n_folds: int = N_FOLDS) -> Column:
    """Fold index from a 0-based position and the user's row count."""
    q = F.floor(n / F.lit(n_folds)).cast("bigint")
    small = (F.lit(n_folds) - F.pmod(n, F.lit(n_folds))).cast("bigint")
    boundary = small * q
    return (
        F.when(position < boundary, F.floor(position / q))
        .otherwise(small + F.floor((position - boundary) / (q + 1)))
        .cast("int")
    )


def assign_folds(
    df: DataFrame,
    n_folds: int = N_FOLDS,
    user_col: str = "user_id",
    order_cols: tuple[str, ...] = ("item_id",),
    fold_col: str = "fold",
    scope_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``fold`` (0 .. n_folds-1) to every row; order inside a user (of a scope,
    if any) is ``order_cols`` then the other columns."""
    ranked = rank_within_groups(df, [*scope_cols, user_col], list(order_cols), rank_col="__fold_pos", size_col="__fold_n")
    return ranked.withColumn(fold_col, fold_of(F.col("__fold_pos"), F.col("__fold_n"), n_folds)).drop(
        "__fold_pos", "__fold_n"
    )


def fold_train(folded: DataFrame, fold: int, fold_col: str = "fold") -> DataFrame:
    """All folds but one."""
    return folded.where(F.col(fold_col) != F.lit(fold))


def fold_test(folded: DataFrame, fold: int, fold_col: str = "fold") -> DataFrame:
    """One fold."""
    return folded.where(F.col(fold_col) == F.lit(fold))

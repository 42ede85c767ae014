"""Ranking primitives that stay balanced when one group — or one run of
identical rows — holds a third of the data.

A plain ``row_number().over(Window.partitionBy(g).orderBy(o))`` sends every
row of a group to one task.  Two cases are handled instead:

* **bounded top-N per group** (:func:`top_n_per_group`): ``row_number`` with a
  ``<= n`` filter.  Spark plans a partial ``WindowGroupLimit`` before the
  shuffle, so each map task forwards at most ``n`` rows per group and a hot
  group costs ``n x tasks`` rows, not its size.
* **full ranking** (:func:`rank_within_groups`, :func:`global_position`): groups
  that are counted small (a share of a task's rows) are dealt whole and ranked by a
  window; any other, and a ranking without groups, goes through these steps:

  1. identical rows are collapsed into ``(row, multiplicity)`` by a
     map-side-combined count, so copies never pile up in one task and the
     remaining rows are all distinct;
  2. a distributed range sort on ``(group, order, tie-breaks)`` then splits
     a hot group over many partitions, and each distinct row gets its
     position inside its sorted partition; the sorted frame is stored,
     which freezes that numbering and cuts lineage.  There are at least as many
     partitions as the counted rows ask for, here and in the join of step 3;
  3. a per-(partition, group) table of row counts — at most
     ``#groups + #partitions`` rows, at most ``#partitions`` for any one
     group — gives the rows of the group in earlier partitions; a window over
     one (partition, group) run gives the rows before it inside the
     partition;
  4. each distinct row is expanded back to its multiplicity with
     consecutive positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.session import store

_MULT = "__rk_mult"
_ID = "__rk_id"
_PART = "__rk_part"
_LOC = "__rk_loc"
_GK = "__rk_gk"
_CNT = "__rk_cnt"
_BEFORE = "__rk_before"
_LOCAL = "__rk_local"
_I = "__rk_i"
# monotonically_increasing_id = partition index << 33 | row index in partition
_LOC_BITS = 33
#: Rows that a task sorts or joins.
ROWS_PER_PARTITION = 250_000
#: So many of the greatest groups that aren't spread over tasks make up a task's rows.
GROUPS_TO_A_PARTITION = 5

OrderSpec = str | Column


def _orderable(dt: T.DataType) -> bool:
    if isinstance(dt, (T.MapType, T.UserDefinedType, T.VariantType)):
        return False
    if isinstance(dt, T.ArrayType):
        return _orderable(dt.elementType)
    if isinstance(dt, T.StructType):
        return all(_orderable(f.dataType) for f in dt.fields)
    return True


def _names(spec: Sequence[OrderSpec]) -> set[str]:
    return {s for s in spec if isinstance(s, str)}


def _tiebreak(df: DataFrame, used: set[str]) -> list[Column]:
    """All remaining orderable columns, so the order is total on distinct rows."""
    return [F.col(f.name).asc_nulls_first() for f in df.schema.fields if f.name not in used and _orderable(f.dataType)]


def _asc(spec: Sequence[OrderSpec]) -> list[Column]:
    return [F.col(s).asc_nulls_first() if isinstance(s, str) else s for s in spec]


def partitions_for(df: DataFrame) -> int | None:
    """Partitions for the rows of a stored frame, so that a task's share doesn't grow with
    the input; none where the session's own number is enough."""
    parts = -(-df.count() // ROWS_PER_PARTITION)
    return parts if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into ``parts`` partitions, if that number is given."""
    return df.repartition(parts, *keys) if parts else df


def sorted_distinct_rows(df: DataFrame, keys: Sequence[Column], group_key: Column) -> DataFrame:
    """Steps 1-2: collapse copies into a multiplicity, range-sort the distinct
    rows on ``keys`` and freeze ``(partition, position in partition)`` by storing
    them.  Columns: the input's, ``__rk_mult``, ``__rk_part``,
    ``__rk_loc`` and ``__rk_gk`` (the group key)."""
    cols = df.columns
    counted = store(df.groupBy(*cols).agg(F.count(F.lit(1)).alias(_MULT)))
    parts = partitions_for(counted)
    ordered = counted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) if parts else counted.orderBy(*keys)
    ordered = ordered.withColumn(_ID, F.monotonically_increasing_id())
    return store(
        ordered.select(
            *cols,
            _MULT,
            F.shiftright(F.col(_ID), _LOC_BITS).alias(_PART),
            F.col(_ID).bitwiseAND(F.lit((1 << _LOC_BITS) - 1)).alias(_LOC),
            group_key.alias(_GK),
        )
    )


def rank_within_groups(
    df: DataFrame,
    group_cols: Sequence[str],
    order_by: Sequence[OrderSpec],
    rank_col: str = "rank",
    size_col: str | None = None,
    spread_all: bool = False,
) -> DataFrame:
    """Add the 0-based position of each row inside its group (and optionally the
    group size), under ``order_by`` then every other column as tie-break.
    ``spread_all`` leaves the counting of groups out where most are large.

    Exact and deterministic: the order is total on distinct rows, and copies
    of a row are interchangeable.  Every column must be groupable (no map or
    vector columns); project them away first.
    """
    group_cols = list(group_cols)
    bad = [f.name for f in df.schema.fields if not _orderable(f.dataType)]
    if bad:
        raise ValueError(f"rank_within_groups needs groupable columns; drop {bad} first")
    cols = df.columns
    used = set(group_cols) | _names(order_by)
    keys = _asc(group_cols) + _asc(order_by) + _tiebreak(df, used)
    gkey = F.struct(*[F.col(g) for g in group_cols]) if group_cols else F.lit(0)
    if spread_all or not group_cols:
        return _rank_spread(df, cols, keys, gkey, rank_col, size_col)

    df = store(df)  # counted, then ranked
    counts = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(_CNT))
    large = store(counts.where(F.col(_CNT) > max(1, ROWS_PER_PARTITION // GROUPS_TO_A_PARTITION)).select(gkey.alias(_GK)))
    some = not large.isEmpty()
    # equality of the group struct is null-safe; there are few large groups by their size
    small = df.withColumn(_GK, gkey).join(F.broadcast(large), _GK, "left_anti") if some else df
    own = Window.partitionBy(*group_cols)
    rank = (F.row_number().over(own.orderBy(*keys[len(group_cols) :])) - 1).cast("bigint").alias(rank_col)
    size = [F.count(F.lit(1)).over(own).alias(size_col)] if size_col else []
    ranked = spread(small, partitions_for(df), *group_cols).select(*cols, rank, *size)
    if not some:
        return ranked
    rest = df.withColumn(_GK, gkey).join(F.broadcast(large), _GK, "left_semi").select(*cols)
    return ranked.unionByName(_rank_spread(rest, cols, keys, gkey, rank_col, size_col))


def _rank_spread(df: DataFrame, cols: Sequence[str], keys: Sequence[Column], gkey: Column, rank_col: str, size_col: str | None) -> DataFrame:
    """:func:`rank_within_groups` by a range sort, whatever the size of a group."""
    tagged = sorted_distinct_rows(df, keys, gkey)
    parts = partitions_for(tagged)

    stats = tagged.groupBy(_PART, _GK).agg(F.sum(_MULT).alias(_CNT))
    earlier = Window.partitionBy(_GK).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn(_BEFORE, F.coalesce(F.sum(_CNT).over(earlier), F.lit(0)))
    if size_col:
        stats = stats.withColumn(size_col, F.sum(_CNT).over(Window.partitionBy(_GK)))
    stats = stats.drop(_CNT)

    # equi-join on (partition, group struct): struct equality is null-safe,
    # and the window below reuses the join's partitioning (no extra shuffle)
    joined = spread(tagged, parts, _PART, _GK).join(stats, [_PART, _GK], "inner")
    run = Window.partitionBy(_PART, _GK).orderBy(_LOC).rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn(_LOCAL, F.coalesce(F.sum(_MULT).over(run), F.lit(0)))
    size = [F.col(size_col).cast("bigint").alias(size_col)] if size_col else []
    # step 4: every copy of a distinct row takes the next position
    expanded = joined.select(
        *cols,
        (F.col(_BEFORE) + F.col(_LOCAL)).alias("__rk_base"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(_MULT) - 1)).alias(_I),
        *size,
    )
    rank = (F.col("__rk_base") + F.col(_I)).cast("bigint").alias(rank_col)
    return expanded.select(*cols, rank, *([size_col] if size_col else []))


def global_position(df: DataFrame, order_by: Sequence[OrderSpec], pos_col: str = "pos") -> DataFrame:
    """0-based position of every row in one total order, without a
    single-partition window."""
    return rank_within_groups(df, [], order_by, rank_col=pos_col)


def top_n_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    order_by: Sequence[OrderSpec],
    n: int,
    rank_col: str = "rank",
) -> DataFrame:
    """First ``n`` rows of each group (0-based ``rank_col``), ties broken by the
    remaining columns.  Up to the engine's limit for it (``n`` of 1,000) this is
    planned with a partial WindowGroupLimit before the shuffle, so a hot group never
    ships more than ``n`` rows per map task; beyond that the rows are ranked by
    :func:`rank_within_groups`, which spreads a hot group."""
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        ranked = rank_within_groups(df, group_cols, order_by, rank_col=rank_col, spread_all=True)
        return ranked.where(F.col(rank_col) < n).withColumn(rank_col, F.col(rank_col).cast("int"))
    used = set(group_cols) | _names(order_by)
    w = Window.partitionBy(*group_cols).orderBy(*(_asc(order_by) + _tiebreak(df, used)))
    rn = "__rk_rn"
    return (
        df.withColumn(rn, F.row_number().over(w))
        .where(F.col(rn) <= n)
        .withColumn(rank_col, (F.col(rn) - 1).cast("int"))
        .drop(rn)
    )

"""Wide tables and feature vectors.

The original program builds customer vectors by pivoting purchases into one
column per item and reading rows back as arrays.  A pivot wider than a few
thousand columns is slow and capped by ``spark.sql.pivotMaxValues``, so the
vector path here stays long: per-user ``(index, value)`` pairs are combined
(map-side first) and turned into a vector with built-in expressions.  The
wide pivot remains available for reports with a bounded column list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.session import PIVOT_MAX_VALUES

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def pivot_wide(
    df: DataFrame,
    row_col: str,
    column_col: str,
    value_col: str,
    values: Sequence | None = None,
    agg: str = "first",
) -> DataFrame:
    """One row per ``row_col``, one column per distinct ``column_col`` value
    (sorted), empty cells NULL.

    ``agg="first"`` keeps one value per cell like the original (meaningful
    when cells are unique); ``"sum"`` adds duplicates.  Pass ``values`` to
    skip the extra job that discovers the column list (which is as long as the
    result is wide; over ``PIVOT_MAX_VALUES`` raise).  The pivot is a grouped
    aggregate, combined map-side, so a hot row key is not a problem.
    """
    fn = {"first": F.first, "sum": F.sum}[agg]
    if values is None:
        found = df.select(column_col).distinct().limit(PIVOT_MAX_VALUES + 1).collect()
        if len(found) > PIVOT_MAX_VALUES:
            raise ValueError(f"a pivot of over {PIVOT_MAX_VALUES} columns")
        values = [r[0] for r in found if r[0] is not None]
    return df.groupBy(row_col).pivot(column_col, sorted(values)).agg(fn(value_col))


def fill_missing_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL -> 0.0 in the given (default: all numeric) columns."""
    targets = list(cols) if cols is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    return df.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in targets else F.col(c) for c in df.columns])


def row_to_key_and_array(df: DataFrame, key_col: str, value_cols: Sequence[str] | None = None, output_col: str = "values") -> DataFrame:
    """Wide row -> ``(key, array<double> of the remaining columns)``."""
    cols = list(value_cols) if value_cols is not None else [c for c in df.columns if c != key_col]
    return df.select(key_col, F.array(*[F.col(c).cast("double") for c in cols]).alias(output_col))


def numeric_columns_to_vector(df: DataFrame, output_col: str = "features", keep: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """The given columns (default: all that aren't in ``keep``) -> double (NULL -> 0.0)
    -> dense vector.  A column that isn't numeric raises; none is left out silently."""
    chosen = list(columns) if columns is not None else [c for c in df.columns if c not in keep]
    other = [c for c in chosen if not isinstance(df.schema[c].dataType, _NUMERIC)]
    if other:
        raise ValueError(f"columns {other} are not numeric; name the columns of the vector")
    arr = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in chosen])
    return df.select(*keep, array_to_vector(arr).alias(output_col))


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """A sparse ML vector from parallel arrays (indices ascending), without Python:
    the vector type's own struct, written and read back as JSON by the engine."""
    body = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), indices.cast("array<int>").alias("indices"), values.cast("array<double>").alias("values"))
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(body.alias("v"))), schema)["v"]


def hashed_cells(
    pairs: DataFrame, width: int, user_col: str = "user_id", item_col: str = "item_id", value_col: str = "qty", index_col: str = "item_idx"
) -> DataFrame:
    """Long ``(user, item, value)`` rows as ``(user_id, item_idx, qty)`` cells of a fixed
    width: signed feature hashing.

    An item's column and sign come from its MD5, so no dictionary of items is built and
    vectors have ``width`` positions whatever the catalogue.  Items that share a column
    add up with their signs, which leaves dot products right on average.
    """
    if width < 1:
        raise ValueError("width must be at least 1")
    # 60 bits of the digest: the column from the low ones, the sign from the next
    number = F.conv(F.substring(F.md5(F.col(item_col).cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    even = F.pmod(F.call_function("div", number, F.lit(width).cast("bigint")), F.lit(2)) == 0
    signed = F.when(even, F.col(value_col)).otherwise(-F.col(value_col))
    cells = pairs.select(user_col, F.pmod(number, F.lit(width)).cast("int").alias(index_col), signed.cast("double").alias(value_col))
    return cells.groupBy(user_col, index_col).agg(F.sum(value_col).alias(value_col))


def user_item_vectors(
    pairs: DataFrame,
    dim: int,
    user_col: str = "user_id",
    index_col: str = "item_idx",
    value_col: str = "qty",
    output_col: str = "features",
    sparse: bool = True,
) -> DataFrame:
    """Customer vectors from long ``(user, index, value)`` rows.

    Duplicate cells are summed first (partial aggregate), so a user's list
    holds at most ``dim`` entries however many rows the user has.  Sparse
    vectors hold the non-zero entries, so their cost follows the purchases;
    ``sparse=False`` writes all ``dim`` positions, for short vectors only.
    Users without any entry are absent; users whose entries are all zero have a
    zero vector.
    """
    cells = pairs.groupBy(user_col, index_col).agg(F.sum(value_col).alias("__v"))
    grouped = cells.groupBy(user_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(index_col).cast("int").alias("i"), F.col("__v").cast("double").alias("v")))).alias("__e")
    )
    if sparse:
        held = F.filter("__e", lambda e: e["v"] != 0)
        return grouped.select(user_col, held.alias("__e")).select(user_col, sparse_vector(dim, F.col("__e.i"), F.col("__e.v")).alias(output_col))
    grouped = grouped.select(user_col, F.filter("__e", lambda e: e["i"].between(0, dim - 1)).alias("__e"))
    # each entry after as many zeros as positions lie before it, then the rest
    before = lambda k: F.when(k > 0, F.get("__e", k - 1)["i"]).otherwise(-1)
    runs = F.transform("__e", lambda e, k: F.concat(F.array_repeat(F.lit(0.0), e["i"] - before(k) - 1), F.array(F.coalesce(e["v"], F.lit(0.0)))))
    rest = F.array_repeat(F.lit(0.0), F.lit(dim - 1) - F.coalesce(F.try_element_at("__e", F.lit(-1))["i"], F.lit(-1)))
    return grouped.select(user_col, array_to_vector(F.concat(F.flatten(runs), rest)).alias(output_col))

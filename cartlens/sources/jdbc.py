"""JDBC feature source.

The query is passed as a parenthesised sub-query in ``dbtable``, so the
database evaluates it.  With ``partition_column`` and bounds the scan is
split into ``num_partitions`` parallel range queries instead of the single
connection a plain JDBC read uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartlens.operators.vectors import numeric_columns_to_vector


def jdbc_options(
    url: str,
    query: str,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 10000,
) -> dict[str, str]:
    opts = {"url": url, "dbtable": f"({query}) features_query", "fetchsize": str(fetch_size)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if driver is not None:
        opts["driver"] = driver
    if partition_column is not None:
        if lower_bound is None or upper_bound is None or num_partitions is None:
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        opts.update(
            partitionColumn=partition_column,
            lowerBound=str(lower_bound),
            upperBound=str(upper_bound),
            numPartitions=str(num_partitions),
        )
    return opts


def read_jdbc_features(spark: SparkSession, output_col: str = "features", id_col: str | None = None, **kwargs) -> DataFrame:
    """Run the caller's query over JDBC and turn every numeric column (except
    ``id_col``) into one dense vector; NULL becomes 0.0."""
    raw = spark.read.format("jdbc").options(**jdbc_options(**kwargs)).load()
    return numeric_columns_to_vector(raw, output_col=output_col, keep=[id_col] if id_col else [])

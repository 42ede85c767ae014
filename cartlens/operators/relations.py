"""Canonical relations derived from the star-schema tables.

* ``ratings(user_id, item_id, qty)``  — one row per (customer, part): the
  summed quantity the customer bought.
* ``baskets(basket_id, items)``       — one row per order: the distinct part
  attribute values (type or brand) in it.
* ``user_attribute_qty(user_id, attr, qty)`` — ratings rolled up to a part
  attribute, the long form behind low-dimensional customer vectors.
* ``nation_clusters(cluster_number, user_id)`` — a deterministic stand-in
  for a segmentation result.

Only the needed columns are selected so the parquet scans prune.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.operators.ratings import index_items
from cartlens.sources.tables import read_table


def build_ratings(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """orders ⋈ lineitem on the order key, summed per (customer, part).

    The join is a shuffle join on ``l_orderkey`` (AQE may turn it into a
    broadcast when the orders side is measured small, and splits a hot order
    key); the aggregate combines map-side before shuffling on the pair.
    """
    o = orders.select("o_orderkey", "o_custkey")
    li = lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    return (
        li.join(o, li["l_orderkey"] == o["o_orderkey"], "inner")
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
        .agg(F.sum("l_quantity").alias("qty"))
    )


def load_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_ratings(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "lineitem"))


def build_baskets(lineitem: DataFrame, part: DataFrame, attribute: str = "p_type") -> DataFrame:
    """Per order, the sorted distinct values of a part attribute.

    ``collect_set`` de-duplicates map-side (partial aggregate) before the one
    shuffle on the order key, so even an order with a huge number of lines
    reaches the final task as at most one entry per distinct value and map
    task.
    """
    li = lineitem.select("l_orderkey", "l_partkey")
    p = part.select("p_partkey", F.col(attribute).alias("item"))
    pairs = li.join(p, li["l_partkey"] == p["p_partkey"], "inner").select(
        F.col("l_orderkey").alias("basket_id"), "item"
    )
    return pairs.groupBy("basket_id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def load_baskets(spark: SparkSession, sf_dir: str, attribute: str = "p_type") -> DataFrame:
    return build_baskets(read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part"), attribute)


def user_attribute_qty(ratings: DataFrame, part: DataFrame, attribute: str = "p_brand") -> DataFrame:
    """Ratings rolled up to a part attribute: ``(user_id, attr, qty)``."""
    p = part.select(F.col("p_partkey").alias("item_id"), F.col(attribute).alias("attr"))
    return ratings.join(p, "item_id").groupBy("user_id", "attr").agg(F.sum("qty").alias("qty"))


def nation_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cluster_number, user_id)`` taken from the customer's nation."""
    return read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).select(
        F.col("c_nationkey").cast("int").alias("cluster_number"), F.col("c_custkey").alias("user_id")
    )


def segment_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cluster_number, user_id)`` from the customer's market segment; the
    segment names are numbered in sorted order with a distributed dictionary."""
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    ids = index_items(cust, item_col="c_mktsegment", index_col="cluster_number")
    return cust.join(ids, "c_mktsegment").select("cluster_number", F.col("c_custkey").alias("user_id"))

"""Basket rules report over the minimum-support grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from cartlens.operators.baskets import ITEMSET_LABEL, REPORT_COLUMNS, mine_support_sweep, report_strings
from cartlens.operators.relations import load_baskets
from cartlens.sources.sinks import write_delimited


def basket_rules_report(spark: SparkSession, sf_dir: str, attribute: str = "p_type", num_partitions: int | None = None) -> DataFrame:
    return mine_support_sweep(load_baskets(spark, sf_dir, attribute), num_partitions=num_partitions)


def rules_report_text(report: DataFrame) -> DataFrame:
    """The report as the text file holds it: five string columns, confidences to
    six places."""
    rounded = report.withColumn("confidence", F.round("confidence", 6))
    return report_strings(rounded).select(*REPORT_COLUMNS)


def write_rules_report(report: DataFrame, path: str, single_file: bool = False) -> None:
    """Text report: supports ascending; inside each, itemsets (most frequent
    first) then rules (most confident first); ties by item text."""
    strength = F.when(F.col("type") == ITEMSET_LABEL, F.col("freq").cast("double")).otherwise(F.col("confidence"))
    ordered = report.orderBy(
        F.col("support").asc(), F.col("type").asc(), strength.desc(), F.col("antecedent_itemset"), F.col("consequent")
    )
    write_delimited(report_strings(ordered), path, single_file=single_file)

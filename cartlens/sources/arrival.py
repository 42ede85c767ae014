"""Lines of text files with the place at which they arrived.

Spark reads a file in splits, so a line's number isn't known where it is read.  Here each
line gets its file, the begin of its split and its place in the split; these are stored
once, so that what follows sees one numbering.  A count for each split, summed over the
earlier splits of the file, turns the place into the line's number in its file.  The number is
the same however the file was split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.session import store


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, line_no)`` of every line under ``path``; ``line_no`` from 0 in each
    file.  Files read in the order of their names, lines in that of their numbers, give
    the order of arrival.  An empty file has no lines.

    The sum runs over a file's splits: one row for each, some 800,000 for a file of 100 TB.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__begin"),
        F.monotonically_increasing_id().alias("__at"),  # a split is read in one go, by one task
    )
    lines = store(lines)
    splits = lines.groupBy("file", "__begin").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("file").orderBy("__begin").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "__begin", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    numbered = lines.join(splits, ["file", "__begin"])
    return numbered.select("value", "file", (F.col("__before") + F.col("__at") - F.col("__first")).alias("line_no"))


ARRIVAL = ("file", "line_no")  # order columns for what is cut as it arrives

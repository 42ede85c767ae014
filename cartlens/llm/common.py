"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute available)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read back:
    computed once, safe from lost executors, without lineage, and (unlike
    ``checkpoint()``) compressed and planned by its real size, so that a loop's
    size estimates don't multiply."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, base: str) -> str:
    """A column name ``df`` doesn't use (Spark compares names without case)."""
    used, name = {c.lower() for c in df.columns}, base
    while name.lower() in used:
        name += "_"
    return name


_SPLITS = "spark.sql.files.minPartitionNum"


#: Plan nodes that keep rows where the files (or a fixed list of rows) have them.
_IN_PLACE = {"Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation", "DataSourceV2ScanRelation"}


def _in_place(df: DataFrame) -> bool:
    """Whether a row's partition and place in it follow from stored rows alone."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in _IN_PLACE:
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def row_ids(df: DataFrame, name: str) -> DataFrame:
    """Give each row a number of its own, so that rows with null or repeated ids
    stay apart.  It is made of the partition and the place in it: two plans over the
    same stored files (a table, a checkpoint) number the rows alike, and a retried
    task repeats its numbers.  What isn't a plain scan of stored rows (a shuffle, a
    join, a limit) may come in another order each time, so it is stored first.

    Spark cuts files by the cores that it has at that time unless the session says
    into how many parts; where it doesn't, the present number is set, so that
    executors that come or go between two plans change nothing.
    """
    conf = df.sparkSession.conf
    if conf.get(_SPLITS, None) is None:
        conf.set(_SPLITS, str(df.sparkSession.sparkContext.defaultParallelism))
    return (df if _in_place(df) else stored(df)).withColumn(name, F.monotonically_increasing_id())


_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from task to task (a codec, a scorer).
    A worker lives through all stages of a job, so it keeps one at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def slices(batches: Iterable[pa.RecordBatch], text_index: int, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``max_bytes`` of text (one
    row at least), which bounds a task's Python memory by that or its longest text."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text_index)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)

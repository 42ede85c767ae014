"""Exact dedup by deterministic block naming (operator 2), DataFrame operations only.

Every text is cut into blocks of a fixed number of bytes.  Blocks are sorted and
numbered, equal ones alike, so an integer *names* a block's content.  Neighbouring
names are then paired and the distinct pairs numbered in turn, until one name is
left for each text.  Two texts are equal exactly if they have the same length and
the same last name: a name is given to a content, never derived from a hash, so
nothing can collide.  A text of *n* blocks takes ``log2 n`` levels, and each level
has half the rows of the one before.

The text is shuffled once, for the first numbering.  A block that makes up at
least 1/256 of all blocks (there can't be more than 256 such) is dealt out over
``SALTS`` partitions, named in each of them, and one of these names is then given
to all.  Hashes only choose where such blocks go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.common import fresh, row_ids, stored, text_of

BLOCK_BYTES = 4096
#: A block with this share of all blocks is hot, so there are at most its inverse.
HOT_SHARE = 1 / 256
SALTS = 64


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """One row for each block of ``rows(row_, doc_id, text)``; the row of the first
    block also carries the document's own columns."""
    docs = rows.select("row_", "doc_id", F.col("text").cast("binary").alias("bytes"))
    docs = docs.select("*", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha"))
    cut = F.expr(f"transform(sequence(0, greatest(n_bytes - 1, 0) div {size}), i -> substring(bytes, cast(i * {size} + 1 as int), {size}))")
    blocks = docs.select("row_", "doc_id", "n_bytes", "sha", F.posexplode(cut).alias("pos", "block"))
    first = F.col("pos") == 0
    return blocks.select("row_", "pos", "block", "n_bytes", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"))


def _name_blocks(rows: DataFrame, size: int, total: int) -> DataFrame:
    """The blocks without their content, with its ``name``."""
    blocks = _blocks(rows, size)
    counts = blocks.groupBy(F.xxhash64("block").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") >= max(2, total * HOT_SHARE)).select("h", F.lit(True).alias("hot"))
    dealt = blocks.withColumn("h", F.xxhash64("block")).join(F.broadcast(hot), "h", "left")  # at most 1 / HOT_SHARE rows
    dealt = dealt.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row_", "pos"), F.lit(SALTS))).otherwise(F.lit(0)))
    dealt = dealt.drop("h").repartition("block", "salt").sortWithinPartitions("block", "salt", "row_", "pos")
    numbered = dealt.withColumn("at", F.monotonically_increasing_id())
    run = Window.partitionBy("block", "salt").orderBy("row_", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = numbered.withColumn("name", F.first("at").over(run))
    content = F.when(F.col("hot") & (F.col("at") == F.col("name")), F.col("block"))
    named = stored(named.select("row_", "pos", "name", "n_bytes", "doc_id", "sha", content.alias("hot_block")))
    # the names that one hot block got in different partitions (at most SALTS) become one
    salted = named.where("hot_block is not null").select("hot_block", "name")
    one = salted.withColumn("one", F.min("name").over(Window.partitionBy("hot_block"))).select("name", "one")
    joined = named.drop("hot_block").join(stored(one), "name", "left")
    return joined.withColumn("name", F.coalesce("one", "name")).drop("one")


def text_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``row_`` (its number by
    :func:`~cartlens.llm.common.row_ids`), ``doc_id``, ``n_bytes``, ``name`` and
    ``sha`` (lowercase hex SHA-256 of the UTF-8 text).  Two rows have equal texts
    exactly if ``(n_bytes, name)`` are equal."""
    rows = row_ids(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text")), "row_")
    blocks = F.expr(f"greatest(octet_length(text) - 1, 0) div {block_bytes} + 1")
    total, most = rows.agg(F.sum(blocks), F.max(blocks)).first()
    named = stored(_name_blocks(rows, block_bytes, total or 0))
    whole = f"n_bytes <= {block_bytes}"
    found = named.where(whole).select("row_", "doc_id", "n_bytes", "sha", "name")
    if (most or 1) > 1:
        many = named.where(f"not ({whole})")
        level = many.select("row_", "pos", "name", F.expr(f"(n_bytes - 1) div {block_bytes} + 1").alias("left"))
        finished, left = None, most
        while left > 1:
            side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
            pairs = level.groupBy("row_", F.expr("pos div 2").alias("pos")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"), F.max("left").alias("left"))
            names = stored(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()))
            level = stored(pairs.join(names, ["a", "b"]).select("row_", "pos", "name", F.expr("(left + 1) div 2").alias("left")))
            done = level.where("left = 1").select("row_", "name")
            finished = done if finished is None else finished.union(done)
            level, left = level.where("left > 1"), (left + 1) // 2
        heads = many.where("pos = 0").select("row_", "doc_id", "n_bytes", "sha")
        found = found.union(heads.join(finished, "row_").select("row_", "doc_id", "n_bytes", "sha", "name"))
    return found


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``row_``, ``doc_id``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest doc_id stays; null is below any id,
    and of rows with the same id the first one stays.  Null texts are equal to
    empty ones.  An empty table gives an empty result; other columns of ``docs``
    don't matter.
    """
    names = stored(text_names(docs, block_bytes, text, doc_id))
    last = F.max(F.struct("doc_id", (-F.col("row_")).alias("turned"))).alias("last")
    groups = stored(names.groupBy("n_bytes", "name").agg(F.count(F.lit(1)).alias("group_size"), last))
    return names.join(groups, ["n_bytes", "name"]).select(
        "row_",
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_") == -F.col("last.turned")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the one row of each text that :func:`exact_duplicates` keeps."""
    number = fresh(docs, "row_")
    kept = exact_duplicates(docs, block_bytes, text, doc_id).where("kept").select(F.col("row_").alias(number))
    return row_ids(docs, number).join(kept, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

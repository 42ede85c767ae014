"""Packed token-id matrices (operator 7).

Every text becomes its token ids and an end mark, so even an empty text is there; ids
beyond ``seq_len`` are cut into pieces, none is dropped.  All pieces of the corpus are packed
by best fit decreasing: the longest goes first, each into the sequence with the least
room that still holds it.

Best fit decreasing asks for nothing but lengths, and there are at most ``seq_len`` of them.  So
the pieces of each length are counted, and the packing is planned with these counts: a range
of equal sequences takes a range of equal pieces at once.  A segment tree over
capacities counts the open ranges of each remaining room and finds that of the least
sufficient room in ``log(seq_len)`` steps.  Then every piece, by its number among those of its
length, looks up its sequence and place.

Pieces are stored once and shuffled once, to the matrices of ``MATRIX_ROWS`` sequences that a
row of the result holds, with the cumulative lengths of the segments in each sequence and
the places where positions restart.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.bpe import parse_ranks
from cartlens.llm.common import held, row_ids, slices, stored, text_of

SEQ_LEN = 2048
MATRIX_ROWS = 64
#: Matrices that a task puts together, one after the other.
MATRICES_TO_A_TASK = 64


class CapacityTree:
    """Open ranges of sequences by remaining room: a segment tree of counts over 0..``most``."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]

    def add(self, room: int, first: int, number: int) -> None:
        self.open[room].append((first, number))
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int, int] | None:
        """Room, first and number of the (last opened) sequences with the least room of at
        least ``need``, which are taken out; None if there are none."""
        node = self.size + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up to a subtree on the right that has any
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return room, *self.open[room].pop()


def best_fit_decreasing(counts: Mapping[int, int], seq_len: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The packing of ``counts[length]`` pieces of each length: rows ``(length, rank, until,
    first, per, start)``, and the number of sequences.  Of the pieces of that length those
    numbered from ``rank`` to ``until`` (exclusive) go to the sequences from ``first`` on,
    ``per`` to each, from place ``start``.

    Placed one by one, a piece leaves its sequence the one with the least room, so the next
    of the same length follows it there while it fits: a sequence takes as many as it
    holds before another is asked.
    """
    tree, rows, total = CapacityTree(seq_len), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room, first, number = tree.take(length) or (seq_len, total, -(-left // (seq_len // length)))
            total = max(total, first + number)
            per = room // length
            full = min(number, left // per)
            if full:
                rows.append((length, rank, rank + full * per, first, per, seq_len - room))
                tree.add(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            rest = number - full
            if rest and left and left < per:
                rows.append((length, rank, rank + left, first + full, left, seq_len - room))
                tree.add(room - left * length, first + full, 1)
                left, full, rest = 0, full + 1, rest - 1
            if rest:
                tree.add(room, first + full, rest)
    return rows, total


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


SEGMENT = T.StructType(
    [
        T.StructField("sequence", T.IntegerType()),  # row of the matrix
        T.StructField("start", T.IntegerType()),  # first column
        T.StructField("length", T.IntegerType()),
        T.StructField("row_", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("offset", T.LongType()),  # of the piece in its text's ids
    ]
)
MATRIX = T.StructType(
    [
        T.StructField("matrix", T.LongType()),
        T.StructField("n_rows", T.IntegerType()),
        T.StructField("seq_len", T.IntegerType()),
        T.StructField("id_bytes", T.IntegerType()),
        T.StructField("ids", T.BinaryType()),  # row-major, little-endian, padded with the end mark
        T.StructField("cu_seqlens", T.ArrayType(T.ArrayType(T.IntegerType()))),  # of each sequence, from 0
        T.StructField("position_resets", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("segments", T.ArrayType(SEGMENT)),
    ]
)
_SEGMENT_ARROW = pa.struct([("sequence", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("row_", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64())])
_MATRIX_ARROW = pa.schema(
    [("matrix", pa.int64()), ("n_rows", pa.int32()), ("seq_len", pa.int32()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.list_(pa.int32()))), ("position_resets", pa.list_(pa.list_(pa.int32()))), ("segments", pa.list_(_SEGMENT_ARROW))]
)


def matrix_of(number: int, table: pa.Table, seq_len: int, dtype: np.dtype, end: int, size: int) -> pa.Table:
    """One matrix of ``size`` sequences (the last one of fewer) from the pieces that are placed
    in it."""
    names = ("sequence", "start", "length", "row_", "doc_id", "offset", "ids")
    rows = sorted(zip(*(table.column(c).to_pylist() for c in names), strict=True), key=lambda r: r[:2])
    base = number * size
    lines = rows[-1][0] - base + 1
    ids, cumulative, segments = np.full((lines, seq_len), end, dtype=dtype), [[0] for _ in range(lines)], []
    for sequence, start, length, row, doc_id, offset, raw in rows:
        k = sequence - base
        ids[k, start : start + length] = np.frombuffer(raw, dtype=dtype)
        cumulative[k].append(start + length)
        segments.append({"sequence": k, "start": start, "length": length, "row_": row, "doc_id": doc_id, "offset": offset})
    out = {"matrix": number, "n_rows": lines, "seq_len": seq_len, "id_bytes": dtype.itemsize, "ids": ids.tobytes(), "cu_seqlens": cumulative, "position_resets": [s[:-1] for s in cumulative], "segments": segments}
    return pa.Table.from_pylist([out], schema=_MATRIX_ARROW)


def _encoder(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    return held(("packing", hash(ranks), pattern), lambda: tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=parse_ranks(ranks), special_tokens={}))


def pieces(docs: DataFrame, ranks: bytes, pattern: str, end: int, seq_len: int = SEQ_LEN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``row_``, ``doc_id``, ``offset`` and ``ids`` of every piece of every text, its
    ``length``, the ``task`` that cut it and its number ``at`` among the task's pieces of that
    length.  Store the result before the numbers are used."""
    source = row_ids(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text")), "row_").select("row_", "doc_id", "text")
    numbers = [T.StructField("length", T.IntegerType()), T.StructField("task", T.IntegerType()), T.StructField("at", T.LongType())]
    schema = T.StructType([*source.schema.fields[:2], T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType()), *numbers])
    shared, dtype = docs.sparkSession.sparkContext.broadcast(ranks), id_type(end + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value, pattern).encode_ordinary
        task, seen = TaskContext.get().partitionId(), [0] * (seq_len + 1)
        for batch in slices(batches, 2):
            index, offsets, cut, lengths, places = [], [], [], [], []
            for r, body in enumerate(batch.column(2).to_pylist()):
                ids = np.array([*encode(body), end], dtype=dtype)
                for at in range(0, len(ids), seq_len):
                    index.append(r)
                    offsets.append(at)
                    part = ids[at : at + seq_len]
                    cut.append(part.tobytes())
                    lengths.append(len(part))
                    places.append(seen[len(part)])
                    seen[len(part)] += 1
            rows = pa.array(index, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(offsets, type=pa.int64()), pa.array(cut, type=pa.binary()), pa.array(lengths, type=pa.int32()), pa.array([task] * len(index), type=pa.int32()), pa.array(places, type=pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, ranks: bytes, pattern: str, end: int, seq_len: int = SEQ_LEN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Matrices that hold the ids of all texts of ``docs``, each exactly once.

    ``end`` is an id outside the vocabulary; it ends each text and pads.  Null texts
    count as empty (the end mark alone); null and repeated ids and repeated rows are
    packed as they are, told apart by ``row_``; an empty table gives no matrix; other
    columns of ``docs`` don't matter.  Write the result as Parquet to keep it.
    """
    spark, dtype = docs.sparkSession, id_type(end + 1)
    cut = stored(pieces(docs, ranks, pattern, end, seq_len, text, doc_id))
    # numbers among all pieces of a length: those of earlier tasks come before
    tasks = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = stored(tasks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    counts = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # seq_len rows at most
    rows, sequences = best_fit_decreasing(counts, seq_len)
    by_length: dict[int, list[tuple]] = {}
    for length, *rest in rows:
        by_length.setdefault(length, []).append(tuple(rest))
    plan = spark.createDataFrame(list(by_length.items()), "length int, plan array<struct<rank: bigint, until: bigint, first: bigint, per: bigint, start: bigint>>")
    placed = cut.join(tasks.select("length", "task", "before"), ["length", "task"]).join(F.broadcast(plan), "length")  # a row for each length
    placed = placed.withColumn("rank", F.col("before") + F.col("at")).withColumn("own", F.expr("filter(plan, p -> p.rank <= rank and rank < p.until)[0]"))
    placed = placed.select(
        F.expr("own.first + (rank - own.rank) div own.per").alias("sequence"),
        F.expr("cast(own.start + (rank - own.rank) % own.per * length as int)").alias("start"),
        "length",
        "row_",
        "doc_id",
        "offset",
        "ids",
    ).withColumn("matrix", F.expr(f"sequence div {MATRIX_ROWS}"))

    size = MATRIX_ROWS

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return matrix_of(key[0].as_py(), table, seq_len, dtype, end, size)

    width = max(1, -(-sequences // (size * MATRICES_TO_A_TASK)))
    return placed.repartition(width, "matrix").groupBy("matrix").applyInArrow(run, MATRIX)


def unpack(matrices: DataFrame) -> DataFrame:
    """``row_``, ``doc_id`` and ``ids`` (binary, without the end mark) of every text
    back from its matrices."""
    schema = T.StructType([T.StructField("row_", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("part", T.BinaryType()), T.StructField("id_bytes", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m in batch.to_pylist():
                line = m["seq_len"] * m["id_bytes"]
                for s in m["segments"]:
                    at = s["sequence"] * line + s["start"] * m["id_bytes"]
                    out.append((s["row_"], s["doc_id"], s["offset"], m["ids"][at : at + s["length"] * m["id_bytes"]], m["id_bytes"]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    parts = matrices.select("seq_len", "id_bytes", "ids", "segments").mapInArrow(run, schema)
    whole = parts.groupBy("row_").agg(F.first("doc_id").alias("doc_id"), F.first("id_bytes").alias("w"), F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p.part))
    return whole.select("row_", "doc_id", F.expr("w").alias("w"), joined.alias("ids")).select("row_", "doc_id", F.substring("ids", F.lit(1), F.length("ids") - F.col("w")).alias("ids"))

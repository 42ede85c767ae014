"""SimHash near-duplicates through deletion-variant signatures (operator 8).

Fingerprint: XXH64 (seed 42) of every shingle of four words, repeats included;
a bit is set where over half of the hashes have it.

Search: two fingerprints within *r* bits, cut into ``r // 2 + 1`` segments, have
a segment that differs in one bit at most.  Such segments agree once that bit is
struck out, so every fingerprint is indexed under all its one-wildcard segment
variants (64 keys, one for each bit), and an equality join on the key with the
bit distance in its condition finds every link.

Groups: copies collapse to one row per fingerprint first.  A dense group of near
copies would still give a number of pairs that grows with its square, so links
are taken in two steps.  *Pivots*: in every bucket each member is held against
one member only, and what is within the distance is joined into components; that
takes linear work, and is done twice with other pivots.  *Rest*: members of
different components that share a variant are all held against each other, but
a component of over ``DENSE`` fingerprints never against itself.  A pair inside
one component needs no link, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import fresh, stored, row_ids, slices, text_of
from cartlens.llm.components import connected_components

SEED = 42
BITS = 64
#: Words of a long text that are hashed at once.
CHUNK = 1 << 17
#: Fingerprints from which on a component counts as dense; parts of a bucket in the pivot step.
DENSE, SHARDS = 64, 8
_BIT_AT = 40  # place of the bit number in a key, above a segment's width
_LANES = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first."""
    if hashes.size < 256:
        return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    counts = np.empty((8, 8), dtype=np.int64)  # byte, bit within it
    padded = np.concatenate([hashes, np.zeros(-hashes.size % 255, dtype=np.uint64)]).reshape(-1, 255)
    for k in range(8):  # at most 255 in a byte lane: no carry
        lanes = ((padded >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts[:, k] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.reshape(64)


def fingerprint(text: str, shingle: int = 4) -> int:
    """The 64-bit fingerprint (unsigned) of one text; zero where it has no word."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    size, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    total, counts = len(words) - size + 1, np.zeros(BITS, dtype=np.int64)
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + size - 1]
        joined = b" ".join(part)
        starts = list(accumulate((len(w) + 1 for w in part), initial=0))
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)]
        counts += _bit_counts(np.array(hashes, dtype=np.uint64))
    return int((1 << np.arange(BITS, dtype=np.uint64))[2 * counts > total].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", into: str = "fp", shingle: int = 4) -> DataFrame:
    """``keep`` columns of every row and the fingerprint as a signed long.
    Row by row, whole texts; null texts count as empty (fingerprint zero)."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    source = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(text).alias(fresh(kept, "text_")))
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, len(keep)):
            values = np.array([fingerprint(t, shingle) for t in part.column(len(keep)).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(values.view(np.int64))], names=[*keep, into])

    return source.mapInArrow(run, schema)


# -- search -------------------------------------------------------------------


def segments(distance: int) -> list[tuple[int, int]]:
    """First bit and width of each segment: ``distance // 2 + 1`` nearly equal ones."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(fps: DataFrame, distance: int, fp: str = "fp") -> DataFrame:
    """``fps`` once for each one-wildcard segment variant, with its ``key``: the
    bit struck out (which names the segment too), and the segment without it."""
    keys = []
    for start, width in segments(distance):
        for bit in range(start, start + width):
            mask = ((1 << width) - 1 << start) & ~(1 << bit)
            part = F.shiftrightunsigned(F.col(fp).bitwiseAND(F.lit(_signed(mask)).cast("long")), start)
            keys.append(part.bitwiseOR(F.lit(bit << _BIT_AT).cast("long")))
    return fps.select("*", F.explode(F.array(*keys)).alias("key"))


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def _first_common(a: Column, b: Column, key: Column, distance: int) -> Column:
    """Whether ``key`` is the one variant of its segment that stands for this
    pair: that of the bit that differs, or of the segment's first bit where none
    does (equal segments agree in all their variants)."""
    bit = F.shiftright(key, _BIT_AT).cast("int")
    parts = [(start, width) for start, width in segments(distance) for _ in range(width)]
    pick = lambda xs: F.element_at(F.array(*[F.lit(_signed(x)).cast("long") for x in xs]), bit + 1)
    differ = a.bitwiseXOR(b).bitwiseAND(pick([(1 << width) - 1 << start for start, width in parts]))
    return (differ == pick([1 << i for i in range(BITS)])) | ((differ == 0) & (bit == pick([start for start, _ in parts])))


def _pivot_links(fps: DataFrame, distance: int, salt: int) -> DataFrame:
    """Links ``(a, b)`` between members of a bucket and one of them.  Buckets are
    taken in ``SHARDS`` parts with a pivot each (other parts for other keys), so
    that one which holds very many fingerprints spreads over several tasks."""
    keyed = variants(fps, distance).withColumn("h", F.xxhash64(F.lit(salt), "fp", "key"))
    keyed = keyed.withColumn("shard", F.pmod("h", F.lit(SHARDS)))
    part = Window.partitionBy("key", "shard").orderBy("h", "fp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = keyed.withColumn("pivot", F.first("fp").over(part))
    return held.where((F.col("fp") != F.col("pivot")) & _near(F.col("fp"), F.col("pivot"), distance)).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))


def _cross_links(left: DataFrame, right: DataFrame, distance: int, ordered: bool) -> DataFrame:
    """All links ``(a, b)`` between members of two components, from variants with
    their ``label``; ``ordered`` where both tables are the same one."""
    one = left.select(F.col("key").alias("at"), F.col("fp").alias("a"), F.col("label").alias("la"))
    two = right.select("key", F.col("fp").alias("b"), F.col("label").alias("lb"))
    a, b = F.col("a"), F.col("b")
    other = F.col("la") < F.col("lb") if ordered else F.col("la") != F.col("lb")
    pair = (F.col("at") == F.col("key")) & other & _near(a, b, distance) & _first_common(a, b, F.col("key"), distance)
    # the planner doesn't see that a fingerprint has 64 variants: keep it from broadcasting them
    return one.hint("merge").join(two, pair).select("a", "b")


def fingerprint_components(fps: DataFrame, distance: int = 4, rounds: int = 2) -> DataFrame:
    """``(fp, component)`` of distinct non-null fingerprints ``fps(fp)``: linked
    within ``distance`` bits, transitively; ``component`` is a fingerprint that
    stands for the group."""
    fps, label = fps.select("fp"), F.coalesce("component", "fp").alias("label")
    links = components = None
    for salt in range(rounds):  # from the second on, only what has a link already: fragments of dense groups
        found = _pivot_links(fps if components is None else components.select(F.col("node").alias("fp")), distance, salt)
        links = stored((found if links is None else links.union(found)).distinct())
        components = connected_components(links)
    labelled = stored(fps.join(components.withColumnRenamed("node", "fp"), "fp", "left").select("fp", label))
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sized = stored(labelled.join(sizes, "label").select("fp", "label", (F.col("n") > DENSE).alias("dense")))
    loose, dense = (variants(sized.where(F.col("dense") == x), distance).select("key", "fp", "label") for x in (False, True))
    # two dense groups meet in few buckets, and only there their members are paired
    shared = dense.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    met = stored(dense.join(shared, "key"))
    rest = _cross_links(loose, loose, distance, True).union(_cross_links(loose, dense, distance, False)).union(_cross_links(met, met, distance, True))
    components = connected_components(links.union(rest))
    return fps.join(components.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``row_`` (its number by
    :func:`~cartlens.llm.common.row_ids`), ``doc_id``, ``fp``, ``component_id``
    (the smallest doc_id of the linked group) and ``stays``: true for one row of
    each group, that with the smallest doc_id (of repeated ids: one row).

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows with a null doc_id take part; they never name a group, unless all
    members are null (then ``component_id`` is null), and stay only then.  An
    empty table gives an empty result; other columns of ``docs`` don't matter.
    """
    ids = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text"))
    rows = stored(fingerprints(row_ids(ids, "row_"), ["row_", "doc_id"], shingle=shingle))
    by_fp = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_")).alias("first"))
    by_fp = stored(by_fp)
    groups = fingerprint_components(by_fp.select("fp"), distance)
    member = stored(by_fp.join(groups, "fp"))
    first = member.groupBy("component").agg(F.min("first").alias("first"))
    named = stored(member.select("fp", "component").join(first, "component").select("fp", "first"))
    out = rows.join(named, "fp")
    return out.select("row_", "doc_id", "fp", F.col("first.doc_id").alias("component_id"), (F.col("row_") == F.col("first.row_")).alias("stays"))


def drop_near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of :func:`near_duplicates`."""
    marked = near_duplicates(docs, distance, shingle, text, doc_id).where("stays")
    number = fresh(docs, "row_")
    stays = marked.select(F.col("row_").alias(number))
    return row_ids(docs, number).join(stays, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

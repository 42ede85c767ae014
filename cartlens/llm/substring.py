"""Substring dedup by sliding sentence spans (operator 10).

A sentence goes up to ``.``, ``!``, ``?`` or a line's end.  Of every ``RUN`` consecutive sentences
of a text the words' 96-bit hash joins the run with its equals in all texts.  Of
equal runs the first stays (by doc_id, row, place); sentences covered by any other
one go.

Passages without stops, or that begin inside a sentence, share no whole sentences.  So
sentences are also cut into parts, by their words alone: in every ``WINDOW`` successive
words of a sentence (but for its last, which ends it anyway) the one of least rank
ends a part.  No part is longer than that, and a cut depends on the words less than
``WINDOW`` away, within its sentence.  From every part runs a span of ``RUN`` consecutive
parts, or as many more as hold ``MIN_WORDS`` words, which is treated like a run of
sentences.  Of a passage in two texts, whatever stands around it, the cuts agree
from one in its first ``WINDOW`` words to one in its last: over 50 words share at least 35
in whole parts, five or more of them, and at least 28 of these lie in common spans.

Counts of equal spans are combined before the shuffle.  Spans are found a second time
to be joined with the repeated ones; a table of marked hash bits, whose size is fixed,
tells many of those that can't be among them before they are shuffled (fewer as more
spans are repeated; with over 10^8 of them next to none).  The
join is an equality join with one row for each repeated span, which adaptive execution
can split where one span is very common.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import row_ids, slices, stored, text_of

RUN, MIN_WORDS = 3, 16
#: In so many successive words of a sentence, one at least ends a part.
WINDOW = 8
#: Bits of the table that tells which hashes may be repeated (4 MB).
PLACES = 1 << 25
_BUCKET = 1 << 15  # fixed value: bits of one of Spark's bitmaps
_LAST_ID = (1 << 63) - 1
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_STOP = np.isin(np.arange(256), list(b".!?\n"))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_EVEN_ODDER = 0xD6E8FEB86659FD93
_INVERSE = pow(_EVEN_ODDER, -1, 1 << 64)


@dataclass
class Words:
    """The words of some texts that stand one after the other in ``raw``: their places,
    and for each whether it begins a sentence, and its text."""

    raw: bytes
    bounds: np.ndarray  # where each text begins, and the end
    starts: np.ndarray
    ends: np.ndarray
    opens: np.ndarray
    owner: np.ndarray


def words_of(texts: Sequence[bytes]) -> Words:
    """Words are parted by white space (ASCII) and by the end of a sentence."""
    raw = b"\n".join([*texts, b""])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data = np.frombuffer(raw, dtype=np.uint8)
    space, stop = _SPACE[data], _STOP[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[1:] = stop
    begins[:-1] &= ~stop  # a sentence begins after a run of stops
    begins[bounds] = True
    begins = begins[: len(data)]
    outside = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & (outside | begins))
    closes = np.concatenate([space[1:] | begins[1:], [True]])
    ends = np.flatnonzero(~space & closes) + 1
    sentence = np.cumsum(begins)[starts]
    opens = np.diff(sentence, prepend=-1) != 0
    return Words(raw, bounds, starts, ends, opens, np.searchsorted(bounds, starts, side="right") - 1)


def ranks(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, made of its length, its first and its last eight bytes."""
    padded = raw + bytes(8)
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = (ends - starts).astype(np.uint64)
    short = np.minimum(length, np.uint64(8))
    head = eight[starts] & np.where(short == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (short * np.uint64(8) & np.uint64(63))) - np.uint64(1))
    tail = np.where(length > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))
    mixed = (head ^ (tail * _ODD) ^ length) * np.uint64(_EVEN_ODDER)
    mixed ^= mixed >> np.uint64(32)
    mixed *= _ODD
    return mixed ^ (mixed >> np.uint64(29))


def part_starts(words: Words) -> np.ndarray:
    """Whether each word begins a part."""
    n = len(words.starts)
    out = words.opens.copy()
    if n > WINDOW:
        sentence = np.cumsum(words.opens)
        # the window from each word on, where the sentence has a word beyond it
        whole = np.flatnonzero(sentence[:-WINDOW] == sentence[WINDOW:])
        rank = ranks(words.raw, words.starts, words.ends) >> np.uint64(8) << np.uint64(8)
        least = rank[whole]
        for k in range(1, WINDOW):
            least = np.minimum(least, rank[whole + k] | np.uint64(k))
        out[whole + (least & np.uint64(255)).astype(np.int64) + 1] = True
    return out


@dataclass
class Spans:
    """Spans of some texts: the text, the first byte of the span and the one after it, both
    counted from the text's begin, and two numbers that hash the span's words."""

    owner: np.ndarray
    first: np.ndarray
    until: np.ndarray
    h1: np.ndarray
    h2: np.ndarray


def spans(texts: Sequence[bytes]) -> Spans:
    """Every run of ``RUN`` sentences and every span of parts."""
    words = words_of(texts)
    begins = np.flatnonzero(part_starts(words))  # words that begin a part
    n = len(begins)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Spans(none, none, none, none, none)
    after = np.append(begins[1:], len(words.starts))
    # a part's words are hashed as they stand, or joined by one space where other space is between
    odd = np.zeros(len(words.starts) + 1, dtype=np.int64)
    gap = (words.starts[1:] - words.ends[:-1] != 1) | (np.frombuffer(words.raw, dtype=np.uint8)[words.ends[:-1]] != 32)
    odd[1:-1] = np.cumsum(gap)
    odd[-1] = odd[-2]
    lo, hi = words.starts[begins].tolist(), words.ends[after - 1].tolist()
    strange = (odd[after - 1] != odd[begins]).tolist()
    raw, digest = words.raw, xxhash.xxh3_128_digest
    digests = b"".join([digest(b" ".join(raw[a:b].split()) if s else raw[a:b]) for a, b, s in zip(lo, hi, strange, strict=True)])
    lanes = np.frombuffer(digests, dtype="<u8").reshape(n, 2)
    # sums of parts' hashes times rising powers: a span's hash is a difference, brought back to power 0
    up, down = _powers(_EVEN_ODDER, n), _powers(_INVERSE, n)
    sums = np.zeros((n + 1, 2), dtype=np.uint64)
    np.cumsum(lanes * up[:, None], axis=0, out=sums[1:])

    owner = words.owner[begins]
    last = np.searchsorted(owner, owner, side="right")  # the part after the text's last
    at = np.arange(n)
    need = np.searchsorted(np.append(begins, len(words.starts)), begins + MIN_WORDS)
    stop = np.maximum(at + RUN, need)
    fits = stop <= last
    first, until = at[fits], stop[fits]
    opening = np.flatnonzero(words.opens[begins])  # parts that begin a sentence
    beyond = np.append(opening, n)[np.minimum(np.arange(len(opening)) + RUN, len(opening))]
    fits = (np.arange(len(opening)) + RUN <= np.searchsorted(owner[opening], owner[opening], side="right")) & ((beyond != stop[opening]) | (stop[opening] > last[opening]))
    first, until = np.append(first, opening[fits]), np.append(until, beyond[fits])
    hashes = (sums[until] - sums[first]) * down[first][:, None]
    hashes ^= hashes >> np.uint64(31)
    base = words.bounds[owner[first]]
    # a span reaches to the next part, or to the end of the text
    finish = np.append(words.starts[begins], 0)[until]
    finish = np.where(until == last[first], words.bounds[owner[first] + 1] - 1, finish)
    return Spans(owner[first], words.starts[begins][first] - base, finish - base, hashes[:, 0].view(np.int64), hashes[:, 1].astype(np.uint32).view(np.int32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _source(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return row_ids(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text")), "row_").select("row_", "doc_id", "text")


def all_spans(source: DataFrame, marked: bytes | None = None) -> DataFrame:
    """Every span of every text of ``row_``, ``doc_id``, ``text``: ``row_``, ``doc_id``,
    ``first`` and ``until`` (bytes of the text in UTF-8), ``h1`` and ``h2`` (64 and 32 bits
    of the hash); only those whose place is marked, where ``marked`` is given."""
    schema = T.StructType([*source.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in ("first", "until", "h1")), T.StructField("h2", T.IntegerType())])
    shared = source.sparkSession.sparkContext.broadcast(marked) if marked is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.frombuffer(shared.value, dtype=np.uint8) if shared else None
        for batch in slices(batches, 2, 2 << 20):
            found = spans([t.encode("utf-8", "replace") for t in batch.column(2).to_pylist()])
            at = found.h1 & PLACES - 1
            kept = slice(None) if places is None else (places[at >> 3] >> (at & 7) & 1).astype(bool)
            index = pa.array(found.owner[kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), *(pa.array(a[kept]) for a in (found.first, found.until, found.h1, found.h2))],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


def repeated_spans(source: DataFrame) -> DataFrame:
    """``row_``, ``first``, ``until`` of every span that isn't the first of its equals."""
    place = F.struct(F.coalesce("doc_id", F.lit(_LAST_ID)).alias("d"), "row_", "first")
    groups = all_spans(source).groupBy("h1", "h2").agg(F.min(place).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = stored(groups.select("h1", "h2", F.col("lead.row_").alias("lead_row"), F.col("lead.first").alias("lead_first")))
    place = F.col("h1").bitwiseAND(F.lit(PLACES - 1))
    bits = groups.groupBy(F.expr(f"(h1 & {PLACES - 1}) div {_BUCKET}").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(_BUCKET))).alias("bits"))
    marked = bytearray(PLACES // 8)
    for row in bits.collect():  # PLACES bits at most
        marked[row.bucket * _BUCKET // 8 : (row.bucket + 1) * _BUCKET // 8] = row.bits
    later = (F.col("row_") != F.col("lead_row")) | (F.col("first") != F.col("lead_first"))
    return all_spans(source, bytes(marked)).drop("doc_id").join(groups, ["h1", "h2"]).where(later).select("row_", "first", "until")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``clean_text`` (without what a repeated
    span covers), ``n_sentences``, ``n_removed`` (sentences of which something went) and
    ``removed`` (character ranges of the text, merged, in order).

    Null texts count as empty.  Rows with null ids come last in the order that
    picks the first of equal spans; repeated rows are texts like any other (so one
    of them stays whole); texts too short for a span stay as they are; an empty
    table gives an empty result; other columns of ``docs`` don't matter.
    """
    source = _source(docs, text, doc_id)
    marks = repeated_spans(source).groupBy("row_").agg(F.sort_array(F.collect_list(F.struct("first", "until"))).alias("marks"))
    joined = source.join(marks, "row_", "left").select("doc_id", "text", "marks")
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("until", T.LongType())]))
    schema = T.StructType([joined.schema["doc_id"], T.StructField("clean_text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span)])
    arrow = pa.list_(pa.struct([("first", pa.int64()), ("until", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 2 << 20):
            texts = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            words = words_of(texts)
            begins = words.starts[words.opens]
            bounds = np.searchsorted(begins, words.bounds)
            clean, gone, ranges = [], [], []
            for k, (raw, marked) in enumerate(zip(texts, batch.column(2).to_pylist(), strict=True)):
                merged: list[list[int]] = []
                for m in marked or ():
                    if merged and m["first"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], m["until"])
                    else:
                        merged.append([m["first"], m["until"]])
                cuts = [0, *(x for m in merged for x in m), len(raw)]
                pieces = [raw[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)]
                clean.append("".join(pieces[::2]))
                places = np.cumsum([len(p) for p in pieces])
                ranges.append([{"first": int(a), "until": int(b)} for a, b in zip(places[:-1:2], places[1::2], strict=True)])
                own = begins[bounds[k] : bounds[k + 1]] - words.bounds[k]
                # from the sentence that holds a range's first byte to the one that holds its last
                hit = {(int(np.searchsorted(own, a, side="right")), int(np.searchsorted(own, b))) for a, b in merged}
                gone.append(_covered(sorted(hit)))
            counts = [pa.array(np.diff(bounds), type=pa.int64()), pa.array(gone, type=pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, type=pa.string()), *counts, pa.array(ranges, type=arrow)], names=schema.names)

    return joined.mapInArrow(run, schema)


def _covered(ranges: Sequence[tuple[int, int]]) -> int:
    """How many numbers lie in some of the ranges (both ends included), given in order."""
    total, done = 0, 0
    for a, b in ranges:
        total += max(0, b - max(a - 1, done))
        done = max(done, b)
    return total

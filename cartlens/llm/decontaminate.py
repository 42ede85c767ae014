"""Benchmark decontamination (operator 4).

Texts are lower-cased and cut into words (letters, digits and everything beyond
ASCII).  For every benchmark item, windows of the item's own length in words slide
over each text, by one word at a time:

1. a window that holds fewer than 0.8 times as many of the item's shingles as the
   item has cannot reach a similarity of 0.8; such windows are left out (this is
   a bound, not a guess: the shared shingles are at most the smaller multiset);
2. the windows left get a SimHash fingerprint over their shingles of five words;
3. a multi-index over the items' fingerprints (eight blocks of eight bits, each
   looked up within two bits) returns every item within ``RADIUS`` = 23 bits: more
   than 23 differing bits are needed to put three into each of eight blocks;
4. the weighted Jaccard similarity of the two shingle multisets, compared word by
   word, decides (0.8 or more).

So step 1 says which windows are worth a fingerprint, and the fingerprint which items
a window is compared with.

Every text is handled on its own, without a shuffle.  The benchmark is read in
chunks of bounded size that are broadcast one after the other, each in a pass
of its own over the texts, so that neither a task nor the driver holds more than one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cartlens.llm.common import fresh, slices, stored

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
BLOCKS, BLOCK_RADIUS = 8, 2
#: A chunk of the benchmark: at most about so many bytes and items.
CHUNK_BYTES, CHUNK_ITEMS = 4 << 20, 20_000
#: Entries of the multi-index that are looked at together.
LOOKED_UP = 1 << 20
_PRIME = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_PRIME_INVERSE = pow(_PRIME, -1, 1 << 64)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_POWERS: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _PRIME), ("down", _PRIME_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word of a lower-cased UTF-8 text."""
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _WORD_BYTE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # pieces of about 64 KB that end with a word: prefix sums stay small
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 16), side="right")))
        lo, hi = starts[at], ends[to - 1]
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        hashes[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return starts, ends, _mixed(hashes)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(_PRIME) + hashes[k : k + n]
    return _mixed(total)


def simhashes(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the windows of ``length`` shingles from each of ``starts``."""
    lo, hi = int(starts.min()), int(starts.max()) + length
    bits = np.unpackbits(hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((hi - lo + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    at = starts - lo
    held = 2 * (sums[at + length] - sums[at]) > length
    return np.packbits(held, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def _runs(text: bytes, starts: np.ndarray, ends: np.ndarray, size: int) -> Counter:
    found = [text[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return Counter(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


_BYTES = np.arange(256, dtype=np.uint8)
#: For each value of a block, the values within ``BLOCK_RADIUS`` bits of it.
_AROUND = np.stack([np.flatnonzero(np.bitwise_count(_BYTES ^ v) <= BLOCK_RADIUS) for v in _BYTES])


class MultiIndex:
    """All fingerprints within ``RADIUS`` bits of a query.  For each block the items are
    listed by the block's value; a query looks up the lists of all values near its own."""

    def __init__(self, fingerprints: np.ndarray):
        self.fingerprints = fingerprints
        values = fingerprints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        self.items = [np.argsort(values[:, b], kind="stable") for b in range(BLOCKS)]
        self.begins = [np.searchsorted(values[order, b], np.arange(257)) for b, order in enumerate(self.items)]

    def near_all(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place of the query, item), by query, then item."""
        step = max(1, LOOKED_UP // max(1, len(self.fingerprints)))
        parts = [self._near(queries[k : k + step], k) for k in range(0, len(queries), step)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0, int))

    def _near(self, queries: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        blocks = queries.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        found = []
        for b, (items, begins) in enumerate(zip(self.items, self.begins, strict=True)):
            around = _AROUND[blocks[:, b]]
            lo, many = begins[around].ravel(), (begins[around + 1] - begins[around]).ravel()
            owner = np.repeat(np.repeat(np.arange(len(queries)), around.shape[1]), many)
            place = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
            item = items[place]
            close = np.bitwise_count(self.fingerprints[item] ^ queries[owner]) <= RADIUS
            found.append(owner[close] * len(self.fingerprints) + item[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.fingerprints) + base, pairs % len(self.fingerprints)

    def near(self, query: int) -> np.ndarray:
        return self.near_all(np.array([query], dtype=np.uint64))[1]


@dataclass
class Benchmark:
    """One chunk of items, indexed."""

    ids: list[int | None]
    texts: list[bytes]
    length: list[int] = field(default_factory=list)  # words
    size: list[int] = field(default_factory=list)  # words of a shingle
    counts: list[Counter] = field(default_factory=list)
    index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        fingerprints, by_size = [], {}
        for i, text in enumerate(self.texts):
            starts, ends, hashes = words(text)
            size = min(SHINGLE, len(starts))
            self.length.append(len(starts))
            self.size.append(size)
            self.counts.append(_runs(text, starts, ends, size) if size else Counter())
            own = shingles(hashes, size) if size else np.zeros(0, dtype=np.uint64)
            fingerprints.append(simhashes(own, np.zeros(1, dtype=np.int64), len(own))[0] if size else np.uint64(0))
            if size:
                for h in set(own.tolist()):
                    by_size.setdefault(size, []).append((h, i))
        self.multi = MultiIndex(np.array(fingerprints, dtype=np.uint64))
        for size, pairs in by_size.items():
            pairs.sort()
            keys, first = np.unique(np.array([h for h, _ in pairs], dtype=np.uint64), return_index=True)
            items = np.array([i for _, i in pairs], dtype=np.int64)
            screen = np.zeros(1 << 20, dtype=bool)
            screen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.index[size] = (keys, np.append(first, len(items)), items, screen)

    def find(self, text: bytes) -> list[tuple[int, int, int, float]]:
        """``(item, first word, words, similarity)`` of the best window (the first of
        equals) for every item that the text holds."""
        starts, ends, hashes = words(text)
        best: dict[int, tuple[float, int, int]] = {}
        for (size, n_words), begins in self._windows(hashes).items():
            self._verify(size, n_words, np.unique(np.concatenate(begins)), text, starts, ends, shingles(hashes, size), best)
        return [(i, s, n, similar) for i, (similar, s, n) in sorted(best.items())]

    def _windows(self, hashes: np.ndarray) -> dict[tuple[int, int], list[np.ndarray]]:
        """Begins of windows, by shingle size and words: those that hold enough shingles of
        some item of that length."""
        out: dict[tuple[int, int], list[np.ndarray]] = {}
        for size, (keys, first, items, screen) in self.index.items():
            own = shingles(hashes, size)
            at = np.flatnonzero(screen[(own & np.uint64((1 << 20) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(keys, own[at]), len(keys) - 1)
            same = keys[place] == own[at]
            at, place = at[same], place[same]
            if not at.size:
                continue
            many = first[place + 1] - first[place]
            spread = np.repeat(np.arange(len(at)), many)
            of = items[np.repeat(first[place], many) + np.arange(len(spread)) - np.repeat(np.cumsum(many) - many, many)]
            order = np.argsort(of, kind="stable")
            who, cut = np.unique(of[order], return_index=True)
            for item, hits in zip(who.tolist(), np.split(at[spread[order]], cut[1:]), strict=True):
                need = int(np.ceil(SIMILARITY * sum(self.counts[item].values()) - 1e-9))
                n_words = min(self.length[item], len(hashes))
                if len(hits) >= need and (begin := _rich(hits, need, n_words - size + 1, len(own))).size:
                    out.setdefault((size, n_words), []).append(begin)
        return out

    def _verify(self, size: int, n_words: int, begin: np.ndarray, text: bytes, starts: np.ndarray, ends: np.ndarray, own: np.ndarray, best: dict) -> None:
        """Look windows of one length up in the multi-index, and compare each with the items
        of that length that it names."""
        fits = (np.minimum(np.array(self.length), len(starts)) == n_words) & (np.array(self.size) == size)
        for part in (begin[i : i + 4096] for i in range(0, len(begin), 4096)):
            query, item = self.multi.near_all(simhashes(own, part, n_words - size + 1))
            query, item = query[fits[item]], item[fits[item]]
            held, last = Counter(), -1
            for q, i in zip(query.tolist(), item.tolist(), strict=True):
                s = int(part[q])
                if q != last:
                    held, last = _runs(text, starts[s : s + n_words], ends[s : s + n_words], size), q
                similar = weighted_jaccard(held, self.counts[i])
                if similar >= SIMILARITY and (i not in best or similar > best[i][0]):
                    best[i] = (similar, s, n_words)


def _rich(hits: np.ndarray, need: int, span: int, total: int) -> np.ndarray:
    """Begins of the windows of ``span`` shingles, of ``total``, that hold ``need`` of the places
    ``hits``."""
    lo = max(0, int(hits[0]) - span + 1)
    hi = min(int(hits[-1]), total - span)  # last begin
    lo = min(lo, hi)
    sums = np.zeros(int(max(hits[-1], hi + span)) - lo + 2, dtype=np.int32)
    np.add.at(sums, hits[hits >= lo] - lo + 1, 1)
    sums = np.cumsum(sums)
    begin = np.arange(lo, hi + 1)
    return begin[sums[begin - lo + span] - sums[begin - lo] >= need]


def chunks(benchmark: DataFrame, text: str = "text") -> Iterator[Benchmark]:
    """The benchmark, at most about ``CHUNK_BYTES`` and ``CHUNK_ITEMS`` of it at a time;
    items without text are left out."""
    body = benchmark.select("item_id", F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).cast("binary").alias("body")).where("octet_length(body) > 0")
    total = body.agg(F.sum(F.octet_length("body")).alias("size"), F.count(F.lit(1)).alias("items")).first()
    n = 1 + max((total["size"] or 0) // CHUNK_BYTES, total["items"] // CHUNK_ITEMS)
    for k in range(n):
        rows = body.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(n)) == k).orderBy("item_id", "body").collect()
        if rows:
            yield Benchmark([r.item_id for r in rows], [bytes(r.body) for r in rows])


def _lowered(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    body = F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("binary")
    return docs.select(*[F.col(f"`{c}`") for c in keep], body.alias(fresh(kept, "body_")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", benchmark_text: str = "text") -> DataFrame:
    """One row for each row of ``docs`` and item that it holds: ``doc_id``,
    ``item_id``, ``first_word``, ``n_words`` (the best window) and ``similarity``.

    Items of fewer than five words have one shingle, their whole sequence; items
    and texts without words match nothing, as do null ones.  Null and repeated ids
    are reported as they are; of repeated items each is reported.  A text shorter
    than an item is one window.  Empty tables give an empty result.
    """
    out = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())])
    source, found, shared = _lowered(docs, text, [doc_id]), None, None
    item_type = to_arrow_type(out["item_id"].dataType)
    for part in chunks(benchmark, benchmark_text):
        if shared is not None:  # the chunk before is done with, so its broadcast may go
            found = stored(found)
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in slices(batches, 1):
                hits = [(r, *hit) for r, body in enumerate(batch.column(1).to_pylist()) for hit in items.find(body)]
                columns = list(zip(*hits, strict=True)) or [[]] * 5
                ids = batch.column(0).take(pa.array(columns[0], type=pa.int64()))
                rest = [pa.array([items.ids[i] for i in columns[1]], type=item_type), pa.array(columns[2], type=pa.int64()), pa.array(columns[3], type=pa.int64()), pa.array(columns[4], type=pa.float64())]
                yield pa.RecordBatch.from_arrays([ids, *rest], names=out.names)

        own = source.mapInArrow(run, out)
        found = own if found is None else found.union(own)
    return docs.sparkSession.createDataFrame([], out) if found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", benchmark_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (see :func:`find_leaks`), all their
    columns.  Rows with null or empty texts stay, as do repeated rows that hold none;
    an empty benchmark leaves all rows, an empty table is one."""
    clean, columns, shared = docs, docs.columns, None
    for part in chunks(benchmark, benchmark_text):
        if shared is not None:
            clean = stored(clean)
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, len(columns)):
                kept = pa.array([not shared.value.find(body) for body in batch.column(len(columns)).to_pylist()], type=pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(kept) for c in batch.columns[: len(columns)]], names=columns)

        clean = _lowered(clean, text, columns).mapInArrow(run, docs.schema)
    return clean

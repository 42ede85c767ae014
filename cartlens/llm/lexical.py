"""Ranked lexical search by NRA (operator 12).

Terms are maximal runs of digits, ASCII letters (lower-cased) and characters beyond
ASCII.  A document's score for a query is the sum, over the query's different terms, of
the term's impact in the document: ``weight * saturation``, both whole numbers, so
that scores are exact and don't depend on the order of adding.

**Index.**  One pass over the documents stores, for each, its number of terms and its
terms with their counts, as far as some query may ask for them (told by a table of
hash places of the queries' terms, whose size is fixed; what slips through is
never asked for).  Document frequencies and the corpus sums come from the stored index.

**Search.**  A task takes its documents in shards of bounded size.  A shard's inverted
lists are sorted by impact, and each query runs NRA over its terms' lists: all lists
are read from the top, some entries at a time, and only onwards.  A document's lower
bound is the sum of its impacts read so far, its upper bound adds, for each list that it
hasn't been met in, the last impact read there (0 once the list ends).  Reading goes on until
every document whose upper bound reaches the k-th best lower bound is fully known; so
membership, ties and scores are exact.  The k-th best score of the task's earlier shards
bounds the later ones from below, which ends most reads early.

A task hands on ``k`` documents a query; a window with a per-task limit picks the ``k``
best of all.  Queries are taken in blocks of bounded size, one after the other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute available)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import row_ids, slices, stored, text_of

TOP = 10
#: Places of the table that tells which terms are worth storing.
PLACES = 1 << 22
#: A block of queries: at most about so many of them, and so many terms.
BLOCK_QUERIES, BLOCK_TERMS = 20_000, 500_000
#: A shard: at most so many documents, postings (or one document's), and cells of NRA's table.
SHARD_DOCS, SHARD_POSTINGS, SHARD_CELLS = 8192, 2_000_000, 8_000_000
#: Entries of each list that NRA reads at first; each further read is four times longer.
FIRST_READ = 64

_LETTERS = bytes(range(ord("a"), ord("z") + 1))
_KEPT = frozenset(b"0123456789" + _LETTERS)
_FOLD = bytes(b if b > 0x7F or b in _KEPT else b + 32 if b + 32 in _LETTERS and b < 0x60 else 0x20 for b in range(256))


def terms_of_text(text: str) -> list[bytes]:
    """The terms of a text, repeats included, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def weight(documents: int, frequency: int) -> int:
    """A term's weight: 0 for one in (nearly) all documents."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def norms(sizes: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Each document's length against the mean, in hundredths, a tenth of it fixed."""
    return 100 - 90 + 90 * sizes * documents // terms


def saturation(counts: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """How much of its weight a term brings that occurs ``counts`` times."""
    return 1_000_000_000 * counts // (1000 * counts + 8 * norm)


def nra(lists: Sequence[tuple[np.ndarray, np.ndarray]], documents: int, k: int, floor: int) -> np.ndarray:
    """NRA over lists of (documents, impacts), each by falling impact: a row (document,
    score) for every document that is among the ``k`` best or ties with the last of
    them, and scores ``floor`` at least and more than 0."""
    lower = np.zeros(documents, dtype=np.int64)
    met = np.zeros((len(lists), documents))
    bound = np.array([float(impacts[0]) for _, impacts in lists])
    at, read = 0, FIRST_READ
    while True:
        for n, (docs, impacts) in enumerate(lists):
            if at < len(docs):
                some = docs[at : at + read]
                lower[some] += impacts[at : at + read]
                met[n, some] = 1
                bound[n] = impacts[at + read - 1] if at + read < len(docs) else 0
        at, read = at + read, read * 4
        least = max(floor, 1, int(np.partition(lower, documents - k)[documents - k]) if documents >= k else 0)
        missing = bound.sum() - bound @ met  # whole numbers below 2 ** 53: exact
        open_ = lower + missing >= least
        if not (missing[open_] > 0).any():
            found = np.flatnonzero(open_)
            return np.stack([found, lower[found]], axis=1)


@dataclass
class QueryBlock:
    """Some queries, the terms that they ask for, and the corpus sums."""

    numbers: list[int]
    terms: list[np.ndarray]  # of each query, as places in ``names``
    names: list[str]
    weights: np.ndarray
    documents: int
    total: int
    k: int

    def __post_init__(self) -> None:
        widest = max((len(t) for t in self.terms), default=1)
        self.shard_docs = max(1, min(SHARD_DOCS, SHARD_CELLS // max(1, widest)))

    def inverted(self, sizes: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The postings by term, then falling impact: documents, impacts, and where each
        term's list begins."""
        impacts = self.weights[terms] * saturation(counts, norms(sizes, self.documents, self.total)[owner])
        order = np.lexsort((-impacts, terms))
        begins = np.searchsorted(terms[order], np.arange(len(self.names) + 1))
        return owner[order], impacts[order], begins

    def search(self, best: list[list[tuple]], ids: list, sizes: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Bring ``best`` (of each query: ``(-score, id is null, id)``, best first) up to
        date with a shard."""
        docs, impacts, begins = self.inverted(sizes, owner, terms, counts)
        begin = begins.tolist()
        for n, asked in enumerate(self.terms):
            lists = [(docs[begin[t] : begin[t + 1]], impacts[begin[t] : begin[t + 1]]) for t in asked.tolist() if begin[t] < begin[t + 1]]
            if not lists:
                continue
            floor = -best[n][-1][0] if len(best[n]) == self.k else 0
            if sum(int(i[0]) for _, i in lists) < max(floor, 1):
                continue
            found = nra(lists, len(ids), self.k, floor)
            rows = ((-score, ids[d] is None, ids[d]) for d, score in found.tolist())
            best[n] = sorted([*best[n], *rows], key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[: self.k]


def _terms(df: DataFrame, places: bytes | None) -> DataFrame:
    """``id``, ``n`` and, in place of ``text``, its different terms and their counts; only
    terms whose place is marked, where ``places`` are given."""
    schema = T.StructType([df.schema[0], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    shared = df.sparkSession.sparkContext.broadcast(places) if places is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value if shared else None
        for part in slices(batches, 1):
            sizes, ends, names, counts = [], [0], [], []
            for text in part.column(1).to_pylist():
                words = terms_of_text(text)
                found = Counter(words)
                kept = list(found) if marked is None else [t for t in found if marked[crc32(t) & PLACES - 1]]
                names += kept
                counts += map(found.__getitem__, kept)
                sizes.append(len(words))
                ends.append(len(names))
            offsets = pa.array(ends, type=pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(names, type=pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(counts, type=pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, type=pa.int64()), *lists], names=schema.names)

    return df.mapInArrow(run, schema)


def _collected(blocks: DataFrame, block: int, documents: int, total: int, k: int) -> QueryBlock:
    rows = blocks.where(F.col("block") == block).select("query_", "asked").collect()
    names = sorted({t.term for r in rows for t in r.asked})
    place = {t: i for i, t in enumerate(names)}
    weights = np.zeros(len(names), dtype=np.int64)
    for r in rows:
        for t in r.asked:
            weights[place[t.term]] = weight(documents, t.df)
    terms = [np.array(sorted(place[t.term] for t in r.asked if weights[place[t.term]] > 0), dtype=np.int64) for r in rows]
    return QueryBlock([r.query_ for r in rows], terms, names, weights, documents, total, k)


def _scored(index: DataFrame, block: QueryBlock) -> DataFrame:
    """For each task at most ``k`` rows a query: ``query_``, ``doc_id``, ``score``."""
    shared = index.sparkSession.sparkContext.broadcast(block)
    id_type = index.schema["doc_id"]
    schema = T.StructType([T.StructField("query_", T.LongType()), id_type, T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        names = pa.array(block.names, type=pa.string())
        best: list[list[tuple]] = [[] for _ in block.numbers]
        id_arrow = None
        for batch in batches:
            id_arrow = batch.column(0).type
            lists, counts = batch.column(2), batch.column(3)
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            found = pa.compute.index_in(lists.flatten(), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            number = counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes, ids, first = batch.column(1).to_numpy(), batch.column(0).to_pylist(), 0
            while first < batch.num_rows:
                until = int(np.searchsorted(ends, ends[first] + SHARD_POSTINGS, side="right")) - 1
                until = min(max(until, first + 1), first + block.shard_docs, batch.num_rows)
                a, b = int(ends[first]), int(ends[until])
                owner = np.repeat(np.arange(until - first), np.diff(ends[first : until + 1]))
                asked = np.flatnonzero(found[a:b] >= 0)
                block.search(best, ids[first:until], sizes[first:until], owner[asked], found[a:b][asked], number[a:b][asked])
                first = until
        rows = [(q, r[2], -r[0]) for q, top in zip(block.numbers, best, strict=True) for r in top]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], type=pa.int64()), pa.array(columns[1], type=id_arrow), pa.array(columns[2], type=pa.int64())], names=schema.names)

    return index.mapInArrow(run, schema)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, text: str = "text", doc_id: str = "doc_id", query_text: str = "text", query_id: str = "item_id") -> DataFrame:
    """The ``k`` best documents of each row of ``queries``: ``item_id``, ``rank`` (from 1),
    ``doc_id``, ``score`` (over 0; of equal scores the smaller id is first).

    Null and empty texts have no terms: such a document counts for nothing and such a query
    finds nothing.  Rows with null or repeated ids are documents and queries of
    their own (null ids come last among equal scores); repeated rows are found
    side by side; empty tables give an empty result; other columns don't matter.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = stored(row_ids(queries.select(F.col(f"`{query_id}`").alias("item_id"), text_of(query_text).alias("text")), "query_").select("query_", "item_id", "text"))
    terms = stored(_terms(asked.select("query_", "text"), None).where("n > 0").select("query_", F.explode("terms").alias("term")))
    mask = terms.select(F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(PLACES - 1)).alias("place")).distinct()
    places = bytearray(PLACES)
    for row in mask.collect():  # PLACES rows at most
        places[row.place] = 1
    index = stored(_terms(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text")), bytes(places)).where("n > 0"))
    sums = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
    found = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = terms.agg(F.count(F.lit(1)).alias("terms"), F.countDistinct("query_").alias("queries")).first()
    blocks = max(1, -(-size.terms // BLOCK_TERMS), -(-size.queries // BLOCK_QUERIES))
    known = terms.join(found, "term").groupBy("query_").agg(F.collect_list(F.struct("term", "df")).alias("asked"))
    known = stored(known.withColumn("block", F.pmod(F.xxhash64("query_"), F.lit(blocks))))
    scored = [stored(_scored(index, _collected(known, b, sums.documents, sums.total, k))) for b in range(blocks)]
    rows = reduce(DataFrame.unionByName, scored)
    order = Window.partitionBy("query_").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("query_", "item_id"), "query_").select("item_id", "rank", "doc_id", "score")

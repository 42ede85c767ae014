"""Periodic run detection over words (operator 13).

A run is a stretch of words with smallest period *q*, at least ``MIN_LENGTH`` words and two
periods long, that no neighbouring word extends.  Runs are found by Kruskal's
algorithm over the suffixes of a text:

* the suffixes are sorted, and neighbours in that order are joined by edges weighed
  by the words that they share (LCP);
* edges are taken by decreasing LCP.  Classes of suffixes are kept by union-find, each
  with its positions in order, and an edge unites two of them: the smaller one's
  positions go into the larger one's;
* two positions *i* < *j* that come to stand side by side this way share exactly LCP
  words.  With *j - i* at most LCP, ``text[i : j + LCP]`` has period *j - i*; if the word
  before *i* doesn't continue it, that is a run.

Every run is found at its start: were there a position of the class between its first
two periods, the period would not be the smallest, and for the same reason a pair
that stands side by side never shows a multiple of the period.

A run needs an LCP of ``MIN_LENGTH / 2`` words, so texts in which no stretch of so many
words occurs twice (told by hashes, whose collisions only cost time) are passed by.
Many texts are sorted together, as one sequence with a mark between them.

A row needs no other row: no shuffle; a task's memory is bounded by a slice of texts or
its longest text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, compress
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import slices, text_of

MIN_LENGTH = 12
#: Positions that wait beside a large class before they are merged into it.
LATE = 1000
_MIX = 0x9E3779B97F4A7C15

Run = tuple[int, int, int]  # start, length, period


def sorted_suffixes(ids: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence of numbers in order, by doubling: those that share
    their first 1, 2, 4, ... numbers have one rank until the next ones tell them apart."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = _first_of_equals(ids[order])
    width, open_ = 1, order
    while True:
        open_ = open_[np.bincount(rank[open_], minlength=len(ids))[rank[open_]] > 1]
        if not open_.size:
            break
        after = open_ + width
        key = np.where(after < len(ids), rank[np.minimum(after, len(ids) - 1)] + 1, 0)
        by = np.lexsort((key, rank[open_]))
        open_, key = open_[by], key[by]
        old = rank[open_]
        begins = np.flatnonzero(np.diff(old, prepend=-1))  # of the old classes
        place = np.arange(len(open_)) - np.repeat(begins, np.diff(np.append(begins, len(open_)))) + old
        new = np.diff(old, prepend=-1).astype(bool) | np.diff(key, prepend=-1).astype(bool)
        rank[open_] = np.repeat(place[new], np.diff(np.append(np.flatnonzero(new), len(open_))))
        width *= 2
    suffixes = np.empty(len(ids), dtype=np.int64)
    suffixes[rank] = np.arange(len(ids))
    return suffixes


def _first_of_equals(values: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the first place of the same value."""
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return np.repeat(begins, np.diff(np.append(begins, len(values))))


def shared_prefixes(ids: list[int], suffixes: list[int]) -> list[int]:
    """For each suffix in order, the numbers that it shares with the one before it."""
    before = [-1] * len(ids)
    for a, b in zip(suffixes, suffixes[1:], strict=False):
        before[b] = a
    common, shared = [0] * len(ids), 0
    for i, j in enumerate(before):
        if j < 0:
            shared = 0
            continue
        while ids[i + shared] == ids[j + shared]:  # marks differ, so this ends in time
            shared += 1
        common[i] = shared
        if shared:
            shared -= 1
    return [common[i] for i in suffixes]


class _Class:
    """The positions of a class in order; those that came late to a large class stand
    apart until there are enough of them to be worth a merge."""

    __slots__ = ("main", "late")

    def __init__(self, position: int):
        self.main, self.late = [position], []

    def __len__(self) -> int:
        return len(self.main) + len(self.late)

    def around(self, position: int) -> tuple[int, int]:
        """The neighbours that ``position`` would have, -1 for none."""
        left = right = -1
        for part in (self.main, self.late):
            at = bisect_left(part, position)
            if at and part[at - 1] > left:
                left = part[at - 1]
            if at < len(part) and (right < 0 or part[at] < right):
                right = part[at]
        return left, right

    def add(self, positions: Sequence[int]) -> None:
        if len(self.main) < LATE:
            if len(positions) == 1:
                self.main.insert(bisect_left(self.main, positions[0]), positions[0])
            else:
                self.main = sorted(self.main + list(positions))
            return
        self.late = sorted(self.late + list(positions))
        if len(self.late) > LATE:
            self.main, self.late = sorted(self.main + self.late), []

    def all(self) -> list[int]:
        return sorted(self.main + self.late) if self.late else self.main


def newly_adjacent(edges: Iterator[tuple[int, int, int]], size: int) -> Iterator[Run]:
    """Unite positions below ``size`` along ``edges`` (two positions and their LCP, by
    decreasing LCP), and give each pair that comes to stand side by side: the earlier,
    the later, their LCP."""
    parent = list(range(size))
    classes: dict[int, _Class] = {}
    for a, b, shared in edges:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        large, small = classes.pop(a, None) or _Class(a), classes.pop(b, None) or _Class(b)
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        moved = small.all()
        gap, last = None, -1
        for position in moved:
            around = large.around(position)
            if around != gap:
                if gap and gap[1] >= 0:
                    yield last, gap[1], shared
                if around[0] >= 0:
                    yield around[0], position, shared
                gap = around
            last = position
        if gap and gap[1] >= 0:
            yield last, gap[1], shared
        large.add(moved)
        parent[b] = a
        classes[a] = large


def _repeating(ids: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """For each text whether some stretch of ``MIN_LENGTH / 2`` words occurs twice in it."""
    need = MIN_LENGTH // 2
    out = np.zeros(texts, dtype=bool)
    if len(ids) < need:
        return out
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
    mixed ^= mixed >> np.uint64(29)
    count = len(ids) - need + 1
    digest = owner[:count].astype(np.uint64)
    for k in range(need):
        digest = digest * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + count]
    inside = np.flatnonzero(owner[:count] == owner[need - 1 :])
    order = inside[np.argsort(digest[inside])]
    same = (digest[order][1:] == digest[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out[owner[order[1:][same]]] = True
    return out


def find_runs(texts: Sequence[Sequence[Any]]) -> list[list[Run]]:
    """The runs of each text (a sequence of words), by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    number = {word: i for i, word in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), dtype=np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    kept = np.flatnonzero(_repeating(ids, np.repeat(np.arange(len(texts)), sizes), len(texts)))
    if not kept.size:
        return out
    # one sequence: mark, text, mark, text, ..., mark, in which no two marks are equal,
    # and a word of one text differs from the same word of another
    ends = np.cumsum(sizes)
    marks = iter(range(-1, -len(kept) - 3, -1))
    parts, starts, at = [np.array([next(marks)])], [], 1
    for k, t in enumerate(kept.tolist()):
        starts.append(at)
        parts += [ids[ends[t] - sizes[t] : ends[t]] + k * len(number), np.array([next(marks)])]
        at += int(sizes[t]) + 1
    line = np.concatenate(parts)
    suffixes, words = sorted_suffixes(line), line.tolist()
    common = np.array(shared_prefixes(words, suffixes.tolist()))
    far = np.flatnonzero(common >= MIN_LENGTH // 2)
    far = far[np.argsort(-common[far], kind="stable")]
    edges = zip(suffixes[far - 1].tolist(), suffixes[far].tolist(), common[far].tolist(), strict=True)
    bounds = np.array(starts)
    for i, j, shared in newly_adjacent(edges, len(words)):
        period = j - i
        if period <= shared and period + shared >= MIN_LENGTH and words[i - 1] != words[j - 1]:
            k = int(np.searchsorted(bounds, i, side="right")) - 1
            out[kept[k]].append((i - starts[k], period + shared, period))
    for found in out:
        found.sort(key=lambda run: (run[0], run[2]))
    return out


def collapse(words: Sequence[Any], runs: Sequence[Run]) -> list[Any]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return list(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def periodic_runs(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    prepare: Callable[[Any, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``runs`` (array of ``start``,
    ``length``, ``period``, in words, by start, then period) and ``collapsed`` (the words
    that no run repeats, joined by one space).  Words are parted by space and the
    characters 9 to 13; ``prepare(doc_id, words)``, where given, may put others in their
    place before runs are sought.

    Null and empty texts have no words and no runs; null and repeated ids and repeated
    rows are texts like any other; an empty table gives an empty result; other columns
    of ``docs`` don't matter.
    """
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text"))
    fields = ("start", "length", "period")
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in fields]))
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", run_type), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 2 << 20):
            texts = [t.encode("utf-8", "replace").split() for t in part.column(1).to_pylist()]
            if prepare:
                texts = [prepare(d, words) for d, words in zip(part.column(0).to_pylist(), texts, strict=True)]
            found = find_runs(texts)
            flat = np.array([r for runs in found for r in runs], dtype=np.int64).reshape(-1, 3)
            ends = pa.array(np.cumsum([0, *map(len, found)]), type=pa.int32())
            runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=list(fields)))
            short = [b" ".join(collapse(words, r)).decode() for words, r in zip(texts, found, strict=True)]
            sizes = pa.array([len(words) for words in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, runs, pa.array(short, type=pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)

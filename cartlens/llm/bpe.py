"""Byte-level BPE encoding and decoding (operator 9).

A text is cut by the vocabulary's pattern, and each match is merged by itself:
as long as two neighbouring parts form a token, the pair of lowest rank (the
leftmost of equal ones) becomes one part.  A segment tree over the byte
positions finds that pair: leaf *j* holds ``(rank, j)`` of the part that starts
at byte *j* joined with its right neighbour, each inner node the least of its
two children, so the root is the next merge.  A merge changes three leaves (its
own, the absorbed part's, the left neighbour's), each in ``log n`` steps.

Two forms of the same tree are used: :meth:`BpeCodec._merge_batch` runs it over
thousands of short matches side by side in numpy, and :meth:`BpeCodec._merge_long`
over one long match.  Results of short matches are kept in a bounded per-process
memo, because words repeat.

Encoding a row needs no other row: no shuffle, and the memory of a task is
bounded by the memo and its longest text's ids.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import cached_property
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import fresh, held, slices, text_of

_INF = np.iinfo(np.int64).max
#: A match of at most this many bytes goes to the batched tree and the memo.
SHORT_BYTES = 64
MEMO_ENTRIES = 300_000
#: Matches taken at once from a long text.
CHUNK = 200_000
_POSITION_BITS = 32


def load_ranks(path: str) -> bytes:
    """The rank file's bytes; the driver reads it and ships it to the tasks."""
    return Path(path).read_bytes()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def latin_form(pattern: str) -> re.Pattern | None:
    """The pattern with its Unicode classes written out for code points below
    256, where Python's faster ``re`` can stand in for ``regex``; None if the
    pattern uses anything beyond the classes known here."""
    letters = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
    numbers = "0-9²³¹¼-¾"
    spaces = "\t\n\x0b\x0c\r \x85\xa0"
    for inside, outside, chars in (("\\p{L}", None, letters), ("\\p{N}", None, numbers), ("\\s", None, spaces)):
        pattern = re.sub(r"\[[^\]]*\]", lambda m, i=inside, c=chars: m[0].replace(i, c), pattern)
        pattern = pattern.replace(inside, f"[{chars}]")
    pattern = pattern.replace("\\S", f"[^{spaces}]")
    return None if "\\" in pattern else re.compile(pattern)


class BpeCodec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.latin, self.beyond_latin = latin_form(pattern), re.compile("[^\x00-\xff]")
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} single bytes; every byte must be a token")
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.memo: dict[str, bytes] = {}

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All ways to put a token together from two: sorted ``left * tokens + right``,
        and the token's rank.  Decoding doesn't need them."""
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * len(self.tokens) + right)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        return np.array(keys, dtype=np.int64)[order], np.array(values, dtype=np.int64)[order]

    @cached_property
    def pair_rank(self) -> dict[int, int]:
        """The same as a dictionary, for long matches."""
        return dict(zip(*(x.tolist() for x in self.pairs), strict=True))

    # -- encoding ---------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text.  Matches that are new to the memo are merged for all
        texts together, since a batch of trees costs little more than one."""
        out: list[bytes | None] = [None] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= 1 << 20]
        for i, ids in zip(short, self._encode_matches([self._pattern_for(texts[i]).findall(texts[i]) for i in short]), strict=True):
            out[i] = ids
        for i, text in enumerate(texts):
            if out[i] is None:
                found, parts = (m.group() for m in self._pattern_for(text).finditer(text)), []
                while chunk := list(islice(found, CHUNK)):
                    parts += self._encode_matches([chunk])
                out[i] = b"".join(parts)
        return out  # type: ignore[return-value]

    def _pattern_for(self, text: str) -> re.Pattern | regex.Pattern:
        return self.pattern if self.latin is None or self.beyond_latin.search(text) else self.latin

    def _encode_matches(self, texts: Sequence[Sequence[str]]) -> list[bytes]:
        memo, all_ = self.memo, set().union(*texts)
        new = [m for m in all_ if m not in memo]
        if len(memo) + len(new) > MEMO_ENTRIES:
            memo.clear()
            new = list(all_)
        raw = [m.encode("utf-8", "replace") for m in new]
        short = [i for i, b in enumerate(raw) if len(b) <= SHORT_BYTES]
        for i, ids in zip(short, self.merge([raw[i] for i in short]), strict=True):
            memo[new[i]] = ids
        long = {m: self._whole(b) or self._merge_long(b) for m, b in zip(new, raw, strict=True) if len(b) > SHORT_BYTES}
        if not long:
            return [b"".join(map(memo.__getitem__, matches)) for matches in texts]
        return [b"".join([memo[m] if m in memo else long[m] for m in matches]) for matches in texts]

    def _whole(self, piece: bytes) -> bytes | None:
        """A match that is a token as it stands is that token."""
        rank = self.ranks.get(piece)
        return None if rank is None else rank.to_bytes(4, "little")

    def merge(self, pieces: Sequence[bytes]) -> list[bytes]:
        out: list[bytes | None] = [self._whole(p) for p in pieces]
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if out[i] is None:
                if piece:
                    by_size.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
                else:
                    out[i] = b""
        for size, index in by_size.items():
            for at in range(0, len(index), 8192):
                part = index[at : at + 8192]
                for i, ids in zip(part, self._merge_batch([pieces[i] for i in part], size), strict=True):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * len(self.tokens) + right
        keys, values = self.pairs
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], -1)

    def _merge_batch(self, pieces: Sequence[bytes], size: int) -> list[bytes]:
        """The tree of every piece (``size`` leaves, a power of two) as a row of one array."""
        n, levels = len(pieces), size.bit_length() - 1
        length = np.array([len(p) for p in pieces])
        joined = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(n, size)
        ids = self.byte_rank[joined]
        live = np.arange(size) < length[:, None]
        after = np.tile(np.arange(1, size + 1), (n, 1))  # the next live part, or the length
        before = np.tile(np.arange(-1, size - 1), (n, 1))
        tree = np.full((n, 2 * size), _INF, dtype=np.int64)
        rank = self._ranks_of(ids[:, :-1], ids[:, 1:])
        tree[:, size : 2 * size - 1] = np.where((rank >= 0) & live[:, 1:], rank << _POSITION_BITS | np.arange(size - 1), _INF)
        for level in range(levels - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        row = np.flatnonzero(tree[:, 1] != _INF)
        while row.size:
            root = tree[row, 1]
            at, new = root & ((1 << _POSITION_BITS) - 1), root >> _POSITION_BITS
            gone = after[row, at]
            then = after[row, gone]
            ids[row, at] = new
            live[row, gone] = False
            after[row, at] = then
            has_next = then < length[row]
            before[row[has_next], then[has_next]] = at[has_next]
            # the merged part with its right neighbour
            right = np.where(has_next, then, at)
            rank = self._ranks_of(new, ids[row, right])
            mine = np.where(has_next & (rank >= 0), rank << _POSITION_BITS | at, _INF)
            # its left neighbour with the merged part
            prior = before[row, at]
            has_prior = prior >= 0
            left = np.where(has_prior, prior, gone)
            rank = self._ranks_of(ids[row, left], new)
            theirs = np.where(has_prior & (rank >= 0), rank << _POSITION_BITS | left, _INF)
            tree[row, size + gone] = _INF
            tree[row, size + at] = mine
            tree[row, size + left] = theirs
            rows = np.concatenate([row, row, row])
            node = np.concatenate([size + gone, size + at, size + left])
            for _ in range(levels):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            row = row[tree[row, 1] != _INF]
        flat, ends = ids[live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)]

    def _merge_long(self, piece: bytes) -> bytes:
        """The same tree over one long match, in plain lists."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        base, lookup = len(self.tokens), self.pair_rank.get
        ids: list[int] = self.byte_rank[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = 1 << 62
        tree = [none] * (2 * size)
        for j in range(n - 1):
            rank = lookup(ids[j] * base + ids[j + 1])
            if rank is not None:
                tree[size + j] = rank << _POSITION_BITS | j
        for node in range(size - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def put(j: int, value: int) -> None:
            node = size + j
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least

        while tree[1] != none:
            at, new = tree[1] & ((1 << _POSITION_BITS) - 1), tree[1] >> _POSITION_BITS
            gone = after[at]
            then = after[gone]
            ids[at], ids[gone], after[at] = new, -1, then
            put(gone, none)
            rank = None
            if then < n:
                before[then] = at
                rank = lookup(new * base + ids[then])
            put(at, none if rank is None else rank << _POSITION_BITS | at)
            prior = before[at]
            if prior >= 0:
                rank = lookup(ids[prior] * base + new)
                put(prior, none if rank is None else rank << _POSITION_BITS | prior)
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for; an id outside the vocabulary raises."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def codec(data: bytes, pattern: str) -> BpeCodec:
    """The process's codec for a vocabulary."""
    return held(("bpe", hash(data), pattern), lambda: BpeCodec(parse_ranks(data), pattern))


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",), into: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``keep`` columns of every row of ``docs`` plus its ids (binary: unsigned
    32-bit integers, little-endian) and, where ``decoded`` names a column, the bytes
    decoded from these ids by the same worker.

    Null and empty texts get no ids.  Null or repeated ids and repeated rows are
    encoded row by row; an empty table gives an empty table; other columns of
    ``docs`` don't matter.  ``ranks`` (a vocabulary file, bounded by its own size)
    travels to the tasks as one broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    column = fresh(kept, "text_")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(text).alias(column))
    names = [*keep, into, *([decoded] if decoded else [])]
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, T.BinaryType()) for c in names[len(keep) :])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(shared.value, pattern)
        for part in slices(batches, len(keep), 2 << 20):
            ids = bpe.encode_all(part.column(len(keep)).to_pylist())
            out = [ids, [bpe.decode(x) for x in ids]] if decoded else [ids]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(x, type=pa.binary()) for x in out)], names=names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: bytes, pattern: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """Add the decoded bytes (binary) to a table of :func:`encode`.  Null ids
    decode to empty bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    names, at = encoded.columns, encoded.columns.index(ids)
    schema = T.StructType([*encoded.schema.fields, T.StructField(into, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(shared.value, pattern)
        for part in slices(batches, at, 16 << 20):
            out = pa.array([bpe.decode(x or b"") for x in part.column(at).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*names, into])

    return encoded.mapInArrow(run, schema)

"""SentencePiece (BPE) encoding and decoding (operator 11).

Spaces become ``▁`` and one ``▁`` goes before the text.  Merging takes, time after
time, the neighbouring pair whose joined piece has the best score (the leftmost of
equal ones).  No merge is simulated over the text.  For every prefix of it the last
token of the prefix's encoding is unique, and a token *t* that ends there is that
one if and only if

* *t* encodes to itself, and
* it is compatible with the last token *u* of the prefix before it: merging ``u t``
  by itself never joins across their seam.

So a table of one token a prefix, filled from left to right with the matches of an
Aho-Corasick automaton, holds the encoding of every prefix, and the ids of the whole
are read backwards from its end.  Time is linear in the text, whatever the text.

The test of a pair replays the two tokens' own merges in order of score and asks
at each moment whether the two symbols at the seam would go first.

A character outside the vocabulary takes part in no merge (loading checks that no
piece holds one) and becomes its UTF-8 bytes.  Where no piece of the vocabulary goes
on from another character to ``▁`` (checked too), no merge crosses such a place, so a
text falls into units there; ids of short units are kept in a bounded memo.

Encoding a row needs no other row: no shuffle, and the memory of a task is bounded
by the memo and its longest text's ids.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import fresh, held, slices, text_of

SPACE = "▁"
#: Units of at most this many characters go to the memo.
SHORT = 40
MEMO_ENTRIES = 400_000
#: New units whose tables are filled side by side.
BATCH = 20_000
_UNIT = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
_PLACES, _MIX = 1 << 21, 0x9E3779B97F4A7C15 - (1 << 64)
_UNKNOWN_SURFACE = " ⁇ "

# Fixed values of the model format: field numbers, piece types, the model type.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_MODEL_TYPE, _BPE, _BYTE_FALLBACK = 3, 2, 35
_CHARSMAP, _DUMMY_PREFIX, _EXTRA_SPACES, _ESCAPE = 2, 3, 4, 5


def load_model(path: str) -> bytes:
    """The model file's bytes; the driver reads it and ships it to the tasks."""
    return Path(path).read_bytes()


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, Any]]:
    """Field numbers and raw values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceCodec:
    """Encoder and decoder of one model: BPE with byte fallback and no text
    normalisation but the marking of spaces."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: dict[str, float] = {}
        trainer: dict[int, Any] = {}
        normalizer: dict[int, Any] = {}
        for number, value in _fields(model):
            if number == _PIECES:
                piece = dict(_fields(value))
                text, kind = piece[_PIECE].decode("utf-8"), piece.get(_TYPE, _NORMAL)
                if kind == _NORMAL:
                    scores[text] = struct.unpack("<f", piece.get(_SCORE, b"\0\0\0\0"))[0]
                self.pieces.append(text)
                self.kinds.append(kind)
            elif number == _TRAINER:
                trainer = dict(_fields(value))
            elif number == _NORMALIZER:
                normalizer = dict(_fields(value))
        self._check(trainer, normalizer, scores)
        self.prefixed = bool(normalizer.get(_DUMMY_PREFIX, 1))
        self.id_of = {t: i for i, (t, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _NORMAL}
        self.byte_ids = [0] * 256
        for i, (text, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if kind == _BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
        self.surface = [{_CONTROL: "", _UNKNOWN: _UNKNOWN_SURFACE}.get(k, t.replace(SPACE, " ")) for t, k in zip(self.pieces, self.kinds, strict=True)]
        self.plain = np.array([k == _NORMAL for k in self.kinds])
        by_score = sorted({-s for s in scores.values()})
        order = {s: r for r, s in enumerate(by_score)}
        self.rank = {self.id_of[t]: order[-s] for t, s in scores.items()}
        self._replay_merges()
        self.automaton = ahocorasick.Automaton()
        for token in self.births:
            self.automaton.add_word(self.pieces[token], token)
        self.automaton.make_automaton()
        self.size = np.array([len(t) for t in self.pieces])
        self.outside = next(c for c in map(chr, range(1 << 16)) if c not in self.id_of)
        self.memo: dict[str, bytes] = {}
        self.pair_key = np.full(_PLACES, -1, dtype=np.int64)
        self.pair_fits = np.zeros(_PLACES, dtype=bool)

    @staticmethod
    def _check(trainer: dict[int, Any], normalizer: dict[int, Any], scores: dict[str, float]) -> None:
        if trainer.get(_MODEL_TYPE) != _BPE or not trainer.get(_BYTE_FALLBACK):
            raise ValueError("only BPE models with byte fallback are encoded here")
        if normalizer.get(_CHARSMAP) or normalizer.get(_EXTRA_SPACES, 1) or not normalizer.get(_ESCAPE, 1):
            raise ValueError("only models without text normalisation are encoded here")
        letters = {t for t in scores if len(t) == 1}
        if any(c not in letters for t in scores for c in t):
            raise ValueError("a piece holds a character that is no piece by itself")
        if any(SPACE in t.lstrip(SPACE) for t in scores):
            raise ValueError(f"a piece goes on to {SPACE} after another character")

    def _replay_merges(self) -> None:
        """Encode every piece by plain merging.  ``births`` holds, for each that comes
        back as itself, its merges in order: the rank, then the symbol that now stands at
        its left end and at its right end.  ``joined`` maps the last two symbols of
        each to its rank; no other pair can ever merge into it, since the merges inside
        a stretch of text that ends as one symbol are those of the stretch alone."""
        self.births: dict[int, list[tuple[int, int, int]]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for text, token in self.id_of.items():
            symbols, steps, last = [self.id_of[c] for c in text], [], None
            while len(symbols) > 1:
                found = []
                for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)):
                    whole = self.id_of.get(self.pieces[a] + self.pieces[b])
                    if whole is not None:
                        found.append((self.rank[whole], i, whole))
                if not found:
                    break
                rank, i, whole = min(found)
                last = (symbols[i], symbols[i + 1])
                symbols[i : i + 2] = [whole]
                steps.append((rank, symbols[0], symbols[-1]))
            if symbols == [token]:
                self.births[token] = steps
                if last:
                    self.joined[last] = self.rank[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` side by side encode to themselves.  Of equal
        ranks the merge that begins further left goes first: those inside ``left``,
        then the one across the seam, then those inside ``right``."""
        ours, theirs = self.births[left], self.births[right]
        a, b = self.id_of[self.pieces[left][-1]], self.id_of[self.pieces[right][0]]
        i = j = 0
        while True:
            next_left = ours[i][0] if i < len(ours) else None
            next_right = theirs[j][0] if j < len(theirs) else None
            seam = self.joined.get((a, b))
            if seam is not None and (next_left is None or seam < next_left) and (next_right is None or seam <= next_right):
                return False
            if next_left is not None and (next_right is None or next_left <= next_right):
                a, i = ours[i][2], i + 1
            elif next_right is not None:
                b, j = theirs[j][1], j + 1
            else:
                return True

    # -- encoding ---------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text.  The prefix tables of units that are new to the memo are
        filled for all texts together."""
        cut = [_UNIT.findall((SPACE if self.prefixed else "") + t) if t else [] for t in texts]
        memo, all_ = self.memo, set().union(*cut)
        new = [u for u in all_ if u not in memo]
        if len(memo) + len(new) > MEMO_ENTRIES:
            memo.clear()
            new = list(all_)
        short = [u for u in new if len(u) <= SHORT]
        for at in range(0, len(short), BATCH):
            part = short[at : at + BATCH]
            memo.update(zip(part, self._short_units(part), strict=True))
        long = {u: self._unit(u) for u in new if len(u) > SHORT}
        if not long:
            return [b"".join(map(memo.__getitem__, units)) for units in cut]
        return [b"".join([memo[u] if u in memo else long[u] for u in units]) for units in cut]

    def _bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")]

    def _unit(self, unit: str) -> bytes:
        """One unit of any length: its prefix table, then the ids from its end."""
        unit = unit.replace(" ", SPACE)
        table: list[tuple[int, int]] = [(1, -1)] * len(unit)  # length and id of each prefix's last token
        done, fits = -1, {}
        for end, token in self.automaton.iter(unit):
            if end == done:  # this prefix has its token
                continue
            size = self.size[token]
            before = table[end - size][1] if size <= end else -1
            if before < 0:  # nothing before it that could merge
                found = True
            else:
                found = fits.get((before, token))
                if found is None:
                    found = fits[before, token] = self.compatible(before, token)
            if found:
                table[end], done = (size, token), end
        ids, at = [], len(unit)
        while at:
            size, token = table[at - 1]
            ids += [token] if token >= 0 else reversed(self._bytes_of(unit[at - 1]))
            at -= size
        return np.array(ids[::-1], dtype="<u4").tobytes()

    def _compatible_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`compatible` for many pairs.  Answers are kept in a table with one
        place for each hash, which a pair takes from the one before."""
        key = left * len(self.pieces) + right
        place = key * _MIX >> 32 & _PLACES - 1
        strange = np.flatnonzero(self.pair_key[place] != key)
        if not strange.size:
            return self.pair_fits[place]
        keys, back = np.unique(key[strange], return_inverse=True)
        answers = np.array([self.compatible(*divmod(k, len(self.pieces))) for k in keys.tolist()], dtype=bool)
        out = self.pair_fits[place]
        out[strange] = answers[back]
        place = keys * _MIX >> 32 & _PLACES - 1
        self.pair_key[place], self.pair_fits[place] = keys, answers
        return out

    def _short_units(self, units: Sequence[str]) -> list[bytes]:
        """The same for many units side by side: their tables stand in one array, a
        place before the first prefix of each, and are filled by prefix length."""
        joined = self.outside.join(units).replace(" ", SPACE)
        length = np.array([len(u) for u in units])
        start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
        token = np.full(len(joined) + 2, -1, dtype=np.int64)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), dtype=np.int64).reshape(-1, 2)
        ends, tokens = found[:, 0] + 1, found[:, 1]
        offset = ends - np.repeat(start, length + 1)[ends - 1]
        order = np.argsort(offset, kind="stable")
        ends, tokens = ends[order], tokens[order]
        sizes = self.size[tokens]
        bounds = np.searchsorted(offset[order], np.arange(1, length.max() + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            before = token[ends[a:b] - sizes[a:b]]
            good = before < 0
            ask = np.flatnonzero(~good)
            good[ask] = self._compatible_pairs(before[ask], tokens[a:b][ask])
            token[ends[a:b][good]] = tokens[a:b][good]
        owner, at, rows, places = np.arange(len(units)), start + length, [], []
        while owner.size:
            rows.append(owner)
            places.append(at)
            at = at - np.where(token[at] < 0, 1, self.size[token[at]])
            live = at > start[owner]
            owner, at = owner[live], at[live]
        rows, places = np.concatenate(rows[::-1]), np.concatenate(places[::-1])
        order = np.argsort(rows, kind="stable")
        rows, ids, places = rows[order], token[places[order]], places[order]
        strange = np.flatnonzero(ids < 0)  # characters outside the vocabulary
        count = np.ones(len(ids), dtype=np.int64)
        if strange.size:
            parts = [self._bytes_of(joined[p - 1]) for p in places[strange].tolist()]
            count[strange] = [len(p) for p in parts]
            ids = np.repeat(ids, count)
            ids[ids < 0] = np.concatenate(parts)
        flat = ids.astype("<u4").tobytes()
        stop = (4 * np.cumsum(np.bincount(rows, weights=count, minlength=len(units)).astype(np.int64))).tolist()
        return [flat[a:b] for a, b in zip([0, *stop], stop, strict=False)]

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """The text that the ids stand for; an id outside the vocabulary raises.  Bytes
        that are no UTF-8 become U+FFFD, one each; the space before the first piece goes."""
        numbers = np.frombuffer(ids, dtype="<u4")
        if not numbers.size:
            return ""
        if self.plain[numbers].all():
            text = "".join(map(self.surface.__getitem__, numbers.tolist()))
            return text[1:] if self.prefixed and text.startswith(" ") else text
        parts: list[str] = []
        raw, at_start = bytearray(), True
        for i in numbers.tolist():
            if self.kinds[i] == _BYTE:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                parts.append(_utf8(bytes(raw)))
                raw, at_start = bytearray(), False
            piece = self.surface[i]
            if at_start and self.prefixed and self.kinds[i] == _NORMAL and piece.startswith(" "):
                piece, at_start = piece[1:], False
            at_start = at_start and not piece
            parts.append(piece)
        return "".join(parts) + _utf8(bytes(raw))


def _utf8(raw: bytes) -> str:
    """Text of ``raw``, with U+FFFD for each byte that begins no valid character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as wrong:
            out.append(raw[at : at + wrong.start].decode("utf-8") + "�")
            at += wrong.start + 1
    return "".join(out)


def codec(model: bytes) -> PieceCodec:
    """The process's codec for a model."""
    return held(("pieces", hash(model)), lambda: PieceCodec(model))


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: Sequence[str] = ("doc_id",), into: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``keep`` columns of every row of ``docs`` plus its ids (array of int) and, where
    ``decoded`` names a column, the text decoded from these ids by the same worker.

    Null and empty texts get no ids.  Null or repeated ids and repeated rows are
    encoded row by row; an empty table gives an empty table; other columns of
    ``docs`` don't matter.  ``model`` (a vocabulary file, bounded by its own size)
    travels to the tasks as one broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    column = fresh(kept, "text_")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(text).alias(column))
    names = [*keep, into, *([decoded] if decoded else [])]
    types = [T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, t) for c, t in zip(names[len(keep) :], types, strict=False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(shared.value)
        for part in slices(batches, len(keep), 2 << 20):
            ids = pieces.encode_all(part.column(len(keep)).to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            out = [pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))]
            if decoded:
                out.append(pa.array([pieces.decode(x) for x in ids], type=pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *out], names=names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: bytes, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """Add the decoded text to a table of :func:`encode`.  Null ids decode to an empty
    text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    names, at = encoded.columns, encoded.columns.index(ids)
    schema = T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(shared.value)
        for batch in batches:
            out = pa.array([pieces.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(at).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*names, into])

    return encoded.mapInArrow(run, schema)

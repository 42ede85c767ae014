"""Chat formatting with typed content parts (operator 3).

A turn's content is a list of typed parts: text, image, audio, document.  A visitor
flattens them in order into one string: texts are escaped, the others leave a
placeholder and are recorded as attachments with their reference, the place of the
placeholder and the number of tokens that it will expand to.  The turns of a
conversation make one formatted string with a mask of what is learnt from (the
assistant's texts).

Escaping is reversible: in texts, references and role names a ``\\`` goes before
each ``\\``, ``[``, ``]`` and ``<``.  Every control string of the template begins with a
bare ``[`` or ``<``, or a blank and then one, so no text can pass for one.  :func:`parse` reads turns, attachments and mask back.

Conversations are hash-partitioned and sorted by turn, then formatted as a stream:
a task holds one conversation, which is one row of the result, at a time.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import slices

#: Control strings: what opens and closes a turn of each role.  Fixed values.
TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER_OPEN, OTHER_MIDDLE, OTHER_CLOSE = "[ROLE ", "] ", " [/ROLE]"
LEARNT = "assistant"
#: Tokens of an image patch's side, of a second of sound, of a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256

PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # text, image, audio or document
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.IntegerType()),
    ]
)
ATTACHMENT = T.StructType([T.StructField(c, t) for c, t in (("turn_index", T.LongType()), ("kind", T.StringType()), ("ref", T.StringType()), ("start", T.LongType()), ("n_tokens", T.LongType()))])
MASK = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ATTACHMENT_ARROW = pa.list_(pa.struct([("turn_index", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
_MASK_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

_BODY = r"(?:[^\\\[\]<]++|\\.)*+"
_CONTENT = re.compile(r"(?P<text>(?:[^\\\[\]<]++|\\.)++)|\[(?P<kind>IMAGE|AUDIO|DOCUMENT) (?P<ref>%s)\]" % _BODY, re.S)
_INSIDE = r"(?:[^\\\[\]<]++|\\.|\[(?:IMAGE|AUDIO|DOCUMENT) %s\])*+" % _BODY
_ANY_TURN = re.compile(
    "|".join(f"{re.escape(a)}(?P<{role}>{_INSIDE}){re.escape(b)}" if not b.startswith(" ") else f"{re.escape(a)}(?P<{role}>{_INSIDE})(?<= ){re.escape(b.lstrip())}" for role, (a, b) in TURNS.items())
    + rf"|{re.escape(OTHER_OPEN)}(?P<name>{_BODY})\] (?P<other>{_INSIDE})(?<= )\[/ROLE\]",
    re.S,
)


def escape(text: str) -> str:
    return re.sub(r"([\\\[\]<])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


@dataclass
class Formatted:
    """A formatted conversation while it grows."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    mask: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    n_turns: int = 0

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)


class Visitor:
    """Writes one turn's parts, a method for each kind."""

    def __init__(self, into: Formatted, learnt: bool):
        self.into, self.learnt = into, learnt

    def visit(self, part: dict) -> None:
        kind = (part.get("kind") or "text").lower()
        getattr(self, f"visit_{kind}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        start = self.into.length
        self.into.put(escape(part.get("text") or ""))
        if self.learnt and self.into.length > start:
            self.into.mask.append({"start": start, "end": self.into.length})

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil(max(0, part.get(side) or 0) / PATCH) for side in ("width", "height"))
        self._attach("image", part, across * down + down)  # a token for each patch and each row's end

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(max(0.0, part.get("seconds") or 0.0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(0, part.get("pages") or 0) * PAGE_TOKENS)

    def _attach(self, kind: str, part: dict, n_tokens: int) -> None:
        ref = part.get("ref") or ""
        self.into.attachments.append({"turn_index": self.into.n_turns, "kind": kind, "ref": ref, "start": self.into.length, "n_tokens": n_tokens})
        self.into.put(f"[{kind.upper()} {escape(ref)}]")


def add_turn(into: Formatted, role: str, parts: Sequence[dict]) -> None:
    opening, closing = TURNS.get(role) or (OTHER_OPEN + escape(role) + OTHER_MIDDLE, OTHER_CLOSE)
    into.put(opening)
    visitor = Visitor(into, role == LEARNT)
    for part in parts:
        visitor.visit(part)
    into.put(closing)
    into.n_turns += 1


@dataclass
class Parsed:
    role: str
    parts: list[dict]  # kind and text, or kind and ref
    raw: tuple[int, int]  # of the content in the formatted string

    @property
    def text(self) -> str:
        return "".join(p["text"] for p in self.parts if p["kind"] == "text")


def parse(formatted: str) -> Iterator[Parsed]:
    """The turns of a formatted string; raises where it isn't one."""
    at = 0
    while at < len(formatted):
        m = _ANY_TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        role = next(k for k in (*TURNS, "other") if m[k] is not None)
        start, end = m.span(role)
        if role not in TURNS or TURNS[role][1].startswith(" "):
            end -= 1  # the blank before the closing string
        parts = [{"kind": "text", "text": unescape(p["text"])} if p["text"] else {"kind": p["kind"].lower(), "ref": unescape(p["ref"])} for p in _CONTENT.finditer(formatted, start, end)]
        yield Parsed(unescape(m["name"]) if role == "other" else role, parts, (start, end))
        at = m.end()


# -- Spark ------------------------------------------------------------------------


def as_parts(text: str = "text") -> F.Column:
    """A plain text column as a list of one text part."""
    null = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[null(f) for f in PART.fields[2:]]))


def format_conversations(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per conv_id of ``turns(conv_id, turn, role, <parts>)``: ``formatted``,
    ``n_turns``, ``mask`` (character ranges of learnt text in it), ``attachments``,
    ``n_attached_tokens``.

    ``parts`` is an array of :data:`PART` structs.  Turns go by number (null first),
    equal numbers by role and content, repeated rows stay.  Null contents and parts
    are empty, a null role is an empty one, unknown kinds count as text; rows of a
    null conv_id form one conversation.  An empty table gives an empty result; other
    columns don't matter.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col(f"`{parts}`"), F.array().cast(T.ArrayType(PART))).alias("parts"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    schema = T.StructType([rows.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("n_turns", T.LongType()), T.StructField("mask", MASK), T.StructField("attachments", T.ArrayType(ATTACHMENT)), T.StructField("n_attached_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for k in range(0, batch.num_rows, 256) for row in batch.slice(k, 256).to_pylist())
        for conv_id, own in groupby(stream, key=lambda row: row["conv_id"]):
            into = Formatted()
            for row in own:
                add_turn(into, row["role"], [p for p in row["parts"] if p])
            tokens = sum(a["n_tokens"] for a in into.attachments)
            values = ([conv_id], ["".join(into.pieces)], [into.n_turns], [into.mask], [into.attachments], [tokens])
            types = (pa.int64(), pa.string(), pa.int64(), _MASK_ARROW, _ATTACHMENT_ARROW, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(values, types, strict=True)], names=schema.names)

    return ordered.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """What a table of :func:`format_conversations` says when it is read again:
    ``conv_id``, ``n_turns``, ``turns_sha256`` (role, line end, text, line end of each
    turn), ``loss_chars``, ``loss_sha256`` (unescaped text under the mask, each piece
    by itself), ``formatted_chars``."""
    schema = T.StructType([formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = []
            for row in batch.to_pylist():
                turns, loss, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for turn in parse(row["formatted"]):
                    turns.update(f"{turn.role}\n{turn.text}\n".encode())
                    n += 1
                for span in row["mask"]:
                    text = unescape(row["formatted"][span["start"] : span["end"]])
                    loss.update(text.encode())
                    chars += len(text)
                out.append({"conv_id": row["conv_id"], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": len(row["formatted"])})
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], type=t) for c, t in zip(schema.names, types, strict=True)], names=schema.names)

    return formatted.select("conv_id", "formatted", "mask").mapInArrow(run, schema)

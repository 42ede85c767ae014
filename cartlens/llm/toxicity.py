"""Toxicity scores from a bidirectional gated recurrent network (operator 5).

A text is lower-cased and cut into words; each word enters as its embedding (if
the training words know it) beside the mean embeddings of its runs of 3 and of 5 characters.
One GRU reads a window of words forwards and one backwards, attention pools their
states, and a logistic unit gives the window's score.  Windows overlap and cover
the whole text; a text's score is that of its worst window.

Training is plain numpy (back-propagation through time, Adam) on the driver over a
bounded sample of labelled texts: at most ``TRAIN_DOCS`` of each class, those with
the smallest hash of their id, of at most ``TRAIN_CHARS`` characters.  The label
says only that some window of a text is toxic, so after two passes the best
window of each toxic text stands for it and its other windows are left out; a
quarter of the clean windows that look it stand for all of them in a pass.

Scoring needs no shuffle: the network (bounded by ``MAX_WORDS`` embeddings) is
broadcast, and every row of every size is scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import fresh, held, slices, text_of

TRAIN_DOCS = (6000, 2000)  # of clean and of toxic ones
TRAIN_CHARS = 6000
MAX_WORDS = 20_000
#: Training texts that must hold a word before it gets an embedding.
MIN_DOCS = 5
WINDOW, STRIDE = 32, 24
WORD_CHARS = 24
#: Character runs: their lengths, and the buckets they are hashed into.
ORDERS, BUCKETS = (3, 5), 8192
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
MEMO_WORDS = 200_000
#: Updates that training makes about, at least (a sample's windows allow some in each pass).
STEPS = 120
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W_]{1,%d}" % WORD_CHARS)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> Iterator[list[str]]:
    """All words of a text, in lists of bounded length."""
    text = text.lower()
    if len(text) <= 1 << 20:
        yield _WORD.findall(text)
        return
    found = (m.group() for m in _WORD.finditer(text))
    while chunk := list(islice(found, 200_000)):
        yield chunk


def char_grams(words: Sequence[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the run of ``order`` characters around each character of each word
    (blanks beyond its ends), and the weight of each in the word's mean."""
    flat = "".join(w.ljust(WORD_CHARS) for w in words).encode("utf-32-le", "replace")
    side = order // 2
    chars = np.full((len(words), WORD_CHARS + 2 * side), 32, dtype=np.uint32)
    chars[:, side : side + WORD_CHARS] = np.frombuffer(flat, dtype="<u4").reshape(len(words), WORD_CHARS)
    mixed = np.zeros((len(words), WORD_CHARS), dtype=np.uint32)
    for k in range(order):
        mixed = (mixed ^ chars[:, k : k + WORD_CHARS]) * np.uint32(0x01000193)
        mixed ^= mixed >> np.uint32(15)
    real = (chars[:, side : side + WORD_CHARS] != 32).astype(np.float32)
    return mixed % np.uint32(BUCKETS), real / np.maximum(1, real.sum(axis=1, keepdims=True))


def window_spans(n: int) -> list[tuple[int, int]]:
    """Start and length of every window over ``n`` words (one empty window for none)."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW + 1, STRIDE))
    return [(s, WINDOW) for s in starts] + ([(n - WINDOW, WINDOW)] if starts[-1] + WINDOW < n else [])


@dataclass
class Network:
    """Parameters; ``params`` are float32 arrays by name."""

    vocabulary: dict[str, int]  # word to row of "words"; row 0 is for unknown words and stays zero
    params: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, vocabulary: dict[str, int], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        init = lambda *shape, scale=0.3: rng.normal(0, scale, shape).astype(np.float32)
        p = {"words": init(len(vocabulary) + 1, WORD_DIM, scale=0.1)} | {f"chars_{n}": init(BUCKETS, CHAR_DIM, scale=0.1) for n in ORDERS}
        p["words"][0] = 0
        for d in ("f", "b"):
            p["in_" + d], p["bias_" + d] = init(WORD_DIM + CHAR_DIM * len(ORDERS), 3 * HIDDEN, scale=0.5), np.zeros(3 * HIDDEN, np.float32)
            p["rec_" + d] = init(3 * HIDDEN, HIDDEN)
        p["att"], p["att_v"] = init(ATTENTION, 2 * HIDDEN), init(ATTENTION)
        p["out"], p["out_bias"] = init(2 * HIDDEN), np.full(1, -2, np.float32)
        return cls(vocabulary, p)

    # -- one word at a time: what it feeds into the gates ------------------

    def inputs(self, words: Sequence[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Word rows, character runs with their weights, and the joined input of each word."""
        rows = np.fromiter((self.vocabulary.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        grams = [char_grams(words, n) for n in ORDERS]
        chars = [np.einsum("nk,nkd->nd", weight, self.params[f"chars_{n}"][buckets]) for n, (buckets, weight) in zip(ORDERS, grams, strict=True)]
        return rows, grams, np.concatenate([self.params["words"][rows], *chars], axis=1)

    def gates(self, words: Sequence[str]) -> np.ndarray:
        """Forward and backward gate inputs of each word, ``(words, 2 * 3 * HIDDEN)``."""
        out = np.empty((len(words), 6 * HIDDEN), dtype=np.float32)
        for at in range(0, len(words), 20_000):
            x = self.inputs(words[at : at + 20_000])[2]
            out[at : at + 20_000] = np.concatenate([x @ self.params["in_f"] + self.params["bias_f"], x @ self.params["in_b"] + self.params["bias_b"]], axis=1)
        return out

    # -- windows -----------------------------------------------------------

    def forward(self, gates: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores of windows from their gate inputs ``(WINDOW, 6 * HIDDEN, windows)``.
        ``keep`` collects what :meth:`backward` needs."""
        steps, n = gates.shape[0], gates.shape[2]
        states = np.zeros((steps, 2 * HIDDEN, n), dtype=np.float32)
        mask = None if (length == steps).all() else (np.arange(steps)[:, None] < length).astype(np.float32)
        for d, order, lo in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), HIDDEN)):
            u, h = self.params["rec_" + d], np.zeros((HIDDEN, n), dtype=np.float32)
            for t in order:
                x = gates[t, 3 * lo : 3 * lo + 3 * HIDDEN]
                a = u @ h
                zr = np.tanh((x[: 2 * HIDDEN] + a[: 2 * HIDDEN]) * np.float32(0.5))
                zr += 1
                zr *= np.float32(0.5)
                z, r = zr[:HIDDEN], zr[HIDDEN:]
                new = np.tanh(x[2 * HIDDEN :] + r * a[2 * HIDDEN :])
                after = new + z * (h - new)
                if mask is not None:
                    after = h + mask[t] * (after - h)
                if keep is not None:
                    keep[d, t] = (h, z, r, new, a[2 * HIDDEN :])
                h = states[t, lo : lo + HIDDEN] = after
        inner = np.tanh(np.matmul(self.params["att"], states))
        score = np.einsum("a,tan->tn", self.params["att_v"], inner)
        if mask is not None:
            score = np.where(mask > 0, score, np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        if mask is not None:
            weight *= mask
        weight /= np.maximum(weight.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("tn,thn->hn", weight, states)
        if keep is not None:
            keep["rest"] = (states, mask, inner, weight, pooled)
        return 1 / (1 + np.exp(-np.clip(self.params["out"] @ pooled + self.params["out_bias"], -30, 30)))

    def backward(self, keep: dict, error: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        """Gradient with respect to the gate inputs; adds the rest to ``grads``.
        ``error`` is d loss / d logit of each window."""
        p = self.params
        states, mask, inner, weight, pooled = keep["rest"]
        steps, n = states.shape[0], states.shape[2]
        grads["out"] += pooled @ error
        grads["out_bias"] += error.sum()
        d_pooled = p["out"][:, None] * error
        d_states = weight[:, None] * d_pooled
        d_weight = np.einsum("hn,thn->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grads["att_v"] += np.einsum("tn,tan->a", d_score, inner)
        d_inner = d_score[:, None] * p["att_v"][:, None] * (1 - inner * inner)
        grads["att"] += np.einsum("tan,thn->ah", d_inner, states)
        d_states += np.matmul(p["att"].T, d_inner)
        d_gates = np.zeros((steps, 6 * HIDDEN, n), dtype=np.float32)
        for d, order, lo in (("f", range(steps - 1, -1, -1), 0), ("b", range(steps), HIDDEN)):
            u, flow = p["rec_" + d], np.zeros((HIDDEN, n), dtype=np.float32)
            for t in order:
                h, z, r, new, an = keep[d, t]
                flow = flow + d_states[t, lo : lo + HIDDEN]
                live = flow if mask is None else flow * mask[t]
                d_new = live * (1 - z) * (1 - new * new)
                d_z = live * (h - new) * z * (1 - z)
                d_r = d_new * an * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_new * r])
                d_gates[t, 3 * lo : 3 * lo + 3 * HIDDEN] = np.concatenate([d_z, d_r, d_new])
                grads["rec_" + d] += d_a @ h.T
                flow = (flow - live) + live * z + u.T @ d_a
        return d_gates


def train(texts: Sequence[str], labels: Sequence[int], seed: int = 5, epochs: int = 8, batch: int = 256, rate: float = 0.01) -> Network:
    """Fit a network to whole texts with 0/1 labels (both must occur)."""
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for part in words_of(t) for w in part], dtype=np.int32) for t in texts]
    distinct = list(number)
    seen = np.zeros(len(distinct), dtype=np.int64)
    for codes in docs:
        seen[np.unique(codes)] += 1
    common = sorted(np.flatnonzero(seen >= MIN_DOCS).tolist(), key=lambda i: (-seen[i], distinct[i]))[:MAX_WORDS]
    net = Network.fresh({distinct[i]: row for row, i in enumerate(common, 1)}, seed)
    windows = [(d, s, n) for d, codes in enumerate(docs) for s, n in window_spans(len(codes)) if n]
    if not windows:
        return net
    rng, p = np.random.default_rng(seed), net.params
    owner = np.array([d for d, _, _ in windows])
    target = np.asarray(labels, dtype=np.float32)[owner]
    tokens = np.zeros((len(windows), WINDOW), dtype=np.int32)
    length = np.array([n for _, _, n in windows])
    for i, (d, s, n) in enumerate(windows):
        tokens[i, :n] = docs[d][s : s + n]
    per_doc = np.bincount(owner)[owner]
    mean, square, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    passes = min(8 * epochs, max(epochs, STEPS * batch * 4 // len(windows)))  # small samples are seen more often
    for epoch in range(passes):
        easy = np.where(rng.random(len(windows)) < 0.25, 4, 0)  # a quarter of the clean windows stand for all of them
        if epoch < 2:  # any window of a toxic text may be meant
            weight = np.where(target > 0, 1 / per_doc, easy).astype(np.float32)
        else:
            score = np.empty(len(windows), dtype=np.float32)
            table = net.gates(distinct)
            for at in range(0, len(windows), 2048):
                g = table[tokens[at : at + 2048]].transpose(1, 2, 0)
                score[at : at + 2048] = net.forward(np.ascontiguousarray(g), length[at : at + 2048])
            best = np.zeros(len(docs), dtype=np.float32)
            np.maximum.at(best, owner, score)
            weight = np.where(target > 0, (score == best[owner]) | (score > 0.5), np.where(score > 0.02, 1, easy)).astype(np.float32)
        order = rng.permutation(np.flatnonzero(weight > 0))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            used, place = np.unique(tokens[pick], return_inverse=True)
            place = place.reshape(len(pick), WINDOW)
            rows, grams, x = net.inputs([distinct[i] for i in used])
            seen = np.ones((len(used), 1), np.float32)
            seen[rng.random(len(used)) < 0.3] = 0  # word dropout: the characters must do as well
            x[:, :WORD_DIM] *= seen
            gates = np.concatenate([x @ p["in_f"] + p["bias_f"], x @ p["in_b"] + p["bias_b"]], axis=1)
            keep: dict = {}
            out = net.forward(np.ascontiguousarray(gates[place].transpose(1, 2, 0)), length[pick], keep)
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            d_gates = net.backward(keep, ((out - target[pick]) * weight[pick] / len(pick)).astype(np.float32), grads)
            flat = np.zeros((len(used), 6 * HIDDEN), dtype=np.float32)
            np.add.at(flat, place.T.reshape(-1), d_gates.transpose(0, 2, 1).reshape(-1, 6 * HIDDEN))
            d_x = np.zeros_like(x)
            for d, part in (("f", flat[:, : 3 * HIDDEN]), ("b", flat[:, 3 * HIDDEN :])):
                grads["in_" + d] += x.T @ part
                grads["bias_" + d] += part.sum(axis=0)
                d_x += part @ p["in_" + d].T
            np.add.at(grads["words"], rows, d_x[:, :WORD_DIM] * seen)
            grads["words"][0] = 0
            for k, (n, (buckets, share)) in enumerate(zip(ORDERS, grams, strict=True)):
                lo, held = WORD_DIM + k * CHAR_DIM, share > 0
                np.add.at(grads[f"chars_{n}"], buckets[held], (share[:, :, None] * d_x[:, None, lo : lo + CHAR_DIM])[held])
            step += 1
            for k, g in grads.items():
                g += np.float32(1e-5) * p[k]
                mean[k] += np.float32(0.1) * (g - mean[k])
                square[k] += np.float32(0.01) * (g * g - square[k])
                p[k] -= np.float32(rate) * (mean[k] / (1 - 0.9**step)).astype(np.float32) / (np.sqrt(square[k] / (1 - 0.99**step)).astype(np.float32) + np.float32(1e-6))
    return net


class Scorer:
    """Scores texts with one network; remembers the gate inputs of words it has seen."""

    def __init__(self, net: Network):
        self.net, self.memo = net, {"": 0}
        self.table = np.zeros((1, 6 * HIDDEN), dtype=np.float32)

    def _codes(self, words: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.int32, count=len(words))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.memo]
        if new:
            self.table = np.concatenate([self.table, self.net.gates(new)])
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))

    def score(self, texts: Sequence[str]) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.table = {"": 0}, self.table[:1]
        parts: list[list[np.ndarray]] = []
        found = [list(words_of(t)) if len(t) <= 1 << 20 else None for t in texts]
        self._learn(set().union(*(part for chunks in found if chunks for part in chunks)))
        for text, chunks in zip(texts, found, strict=True):
            codes = []
            for chunk in chunks if chunks is not None else words_of(text):
                if chunks is None:
                    self._learn(set(chunk))
                codes.append(self._codes(chunk))
            parts.append(codes)
        best = np.zeros(len(texts))
        spans, owner, base = [], [], 0
        for i, codes in enumerate(parts):
            n = sum(map(len, codes))
            own = window_spans(n)
            spans += [(base + s, k) for s, k in own]
            owner += [i] * len(own)
            base += n
        codes = np.concatenate([np.zeros(0, np.int32), *(c for part in parts for c in part), np.zeros(WINDOW, np.int32)])
        span, who = np.array(spans, dtype=np.int64).reshape(-1, 2), np.array(owner, dtype=np.int64)
        full = span[:, 1] == WINDOW
        for index in (np.flatnonzero(full), np.flatnonzero(~full)):
            for at in range(0, len(index), 2048):
                pick = index[at : at + 2048]
                tokens = codes[span[pick, 0] + np.arange(WINDOW)[:, None]]
                gates = np.ascontiguousarray(self.table[tokens].transpose(0, 2, 1))
                np.maximum.at(best, who[pick], self.net.forward(gates, span[pick, 1]))
        return best


# -- Spark ----------------------------------------------------------------------


def training_sample(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[list[str], list[int]]:
    """At most ``TRAIN_DOCS`` texts of each class, of rows that may be learnt from; so
    many, where that many texts of the class have a label and a fitting length.
    Labels that are null or neither 0 nor 1, and labels of null ids, are left out."""
    body = docs.select("doc_id", text_of(text).alias("body")).where(F.char_length("body").between(1, TRAIN_CHARS))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & ~held_out())
    known = known.join(body.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    texts, classes = [], []
    for label in (0, 1):
        chosen = known.where(F.col("toxic") == label).select("doc_id", "h").distinct().orderBy("h", "doc_id").limit(TRAIN_DOCS[label])
        sample = body.join(F.broadcast(chosen), "doc_id").orderBy("h", "doc_id", "body").limit(TRAIN_DOCS[label]).select("body").collect()
        texts += [r.body for r in sample]
        classes += [label] * len(sample)
    return texts, classes


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Network | float:
    """A network; or, where the sample lacks one of the classes, the constant
    score that is left to give: the share of toxic texts in it (1 if all are, 0 if none
    is or there is no sample)."""
    texts, classes = training_sample(docs, labels, text)
    if len(set(classes)) < 2:
        return float(max(classes, default=0))
    return train(texts, classes)


def score(docs: DataFrame, model: Network | float, keep: Sequence[str] = ("doc_id",), text: str = "text", into: str = "score") -> DataFrame:
    """``keep`` columns of every row of ``docs`` and the text's score (0 to 1).
    Null texts count as empty; an empty text gets the score of an empty window.
    Repeated rows and ids are scored row by row; an empty table gives an empty one."""
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    if isinstance(model, float):
        return kept.withColumn(into, F.lit(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text) if text in keep else len(keep)  # a text that is kept travels once
    source = kept if text in keep else docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(fresh(kept, "text_")))
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.DoubleType())])
    key = xxhash.xxh64_intdigest(b"".join(model.params[k].tobytes() for k in sorted(model.params)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("toxicity", key), lambda: Scorer(shared.value))
        for part in slices(batches, at, 2 << 20):
            values = scorer.score([t or "" for t in part.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(values, type=pa.float64())], names=[*keep, into])

    return source.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` (1 from a score of
    ``THRESHOLD``) of every row."""
    scored = score(docs, fit(docs, labels, text), ["doc_id"], text)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all their columns; all rows
    where the sample lacks a class, so that nothing tells them apart."""
    mark, model = fresh(docs, "score_"), fit(docs, labels, text)
    if isinstance(model, float):
        return docs
    scored = score(docs, model, docs.columns, text, into=mark)
    return scored.where(F.col(mark) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])

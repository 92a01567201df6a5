"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The pairwise term costs one pass over a text's features and ``rank``.  Words of the whole text are hashed with
damped counts; structure statistics (shares of character classes, word and line lengths, repetition) and numeric
metadata columns enter as binned indicators, so pairs of them interact too.

Fitting takes at most ``max_train_docs`` labelled rows, those with the smallest hash of the id: a bounded sample.
Scoring takes every row.

Defined cases: null text is the empty text and gets a score like any other; null metadata has a bin of its own;
null labels are not learnt from, and of contradicting labels of one id the mean counts; with no label at all every
score is 0.5; repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pixelwell.llm import blocks  # functions here travel by value

WORD_BITS, BINS, RANK = 16, 16, 8
MAX_TRAIN_DOCS = 4_000
ACCEPT = 0.7

#: Classes of bytes: lower, upper, digit, space, newline, sentence marks, other ASCII marks, non-ASCII, control.
_CLASS = np.full(256, 8, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[10] = 0, 1, 2, 3, 4
for _b in range(33, 127):
    if _CLASS[_b] == 8:
        _CLASS[_b] = 5 if chr(_b) in ".,;:'\"?-()" else 6
_CLASS[128:] = 7

STATS = ("length", "lower", "upper", "digit", "marks", "symbols", "foreign", "control", "word_len", "line_len", "lines", "distinct", "line_repeat", "bang", "bar", "top_word")


def statistics(text: str, raw: bytes, words: Counter, n_words: int) -> list[float]:
    """Each in 0..1."""
    c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9)
    n = max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    squash = lambda x, top: min(1.0, np.log1p(x) / np.log1p(top))
    return [
        squash(len(raw), 1e6), c[0] / n, min(1, 4 * c[1] / n), min(1, 4 * c[2] / n), min(1, 8 * c[5] / n), min(1, 8 * c[6] / n), min(1, 3 * c[7] / n), min(1, 20 * c[8] / n),
        squash(n / max(1, n_words), 60), squash(n / max(1, len(lines)), 1e4), squash(len(lines), 1e4), len(words) / max(1, n_words), 1 - len(set(lines)) / max(1, len(lines)),
        min(1, 10 * raw.count(b"!") / n), min(1, 10 * raw.count(b"|") / n), max(words.values(), default=0) / max(1, n_words),
    ]


def features(text: str | None, meta: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words first (unit length), then statistics and metadata bins."""
    raw = (text or "").encode()
    tokens = raw.lower().split()
    words = Counter(tokens)
    at: dict[int, float] = {}
    mask = (1 << WORD_BITS) - 1
    for w, times in words.items():
        i = zlib.crc32(w) & mask
        at[i] = at.get(i, 0) + times
    x = np.log1p(np.fromiter(at.values(), np.float32, len(at)))
    if len(x):
        x /= np.sqrt((x * x).sum())
    base = 1 << WORD_BITS
    dense = [int(min(BINS - 1, s * BINS)) for s in statistics(text or "", raw, words, len(tokens))]
    dense += [BINS - 1 if m is None or m != m else int(min(BINS - 2, np.log1p(max(0.0, float(m))))) for m in meta]
    own = [base + k * BINS + b for k, b in enumerate(dense)]
    idx = np.concatenate((np.fromiter(at.keys(), np.int64, len(at)), np.array(own, np.int64)))
    return idx, np.concatenate((x, np.full(len(own), 0.5, np.float32))).astype(np.float32)


class Machine:
    """w0, w, v and the linear-time score."""

    def __init__(self, size: int, rank: int = RANK, seed: int = 7) -> None:
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank)).astype(np.float32)

    def raw(self, idx: np.ndarray, x: np.ndarray, starts: np.ndarray):
        """Scores before the sigmoid, and sum_i v_if x_i, of rows that begin at ``starts`` (none empty)."""
        vx = self.v[idx] * x[:, None]
        s = np.add.reduceat(vx, starts)
        pair = 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
        return self.w0 + np.add.reduceat(self.w[idx] * x, starts) + pair, s

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, epochs: int = 6, batch: int = 128, rate: float = 0.08, decay: float = 1e-4) -> Machine:
        """Logistic loss, AdaGrad over mini-batches in a fixed order."""
        rng = np.random.default_rng(11)
        gw, gv, g0 = np.full(len(self.w), 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32), 1e-3
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.w0 = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                sizes = np.array([len(rows[i][0]) for i in pick])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                idx, x = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
                raw, s = self.raw(idx, x, starts)
                e = (1 / (1 + np.exp(-raw)) - y[pick]).astype(np.float32) / len(pick)
                row = np.repeat(np.arange(len(pick)), sizes)
                ex = e[row] * x
                by = np.argsort(idx, kind="stable")
                own = idx[by]
                cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                own = own[cut]
                dw = np.add.reduceat(ex[by], cut) + decay * self.w[own]
                dv = np.add.reduceat((ex[:, None] * (s[row] - self.v[idx] * x[:, None]))[by], cut) + decay * self.v[own]
                gw[own] += dw * dw
                gv[own] += dv * dv
                self.w[own] -= rate * dw / np.sqrt(gw[own])
                self.v[own] -= rate * dv / np.sqrt(gv[own])
                d0 = float(e.sum())
                g0 += d0 * d0
                self.w0 -= rate * d0 / np.sqrt(g0)
        return self

    def score(self, idx: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(idx, x, np.zeros(1, np.int64))[0][0], -40, 40))))


def _inputs(docs: DataFrame, metadata: tuple[str, ...]) -> list[Column]:
    return [F.col("doc_id"), F.col("text"), F.array(*[F.col(blocks.quoted(c)).cast("double") for c in metadata]).cast("array<double>").alias("meta")]


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "quality", metadata: tuple[str, ...] = (), max_train_docs: int = MAX_TRAIN_DOCS) -> Machine:
    """Fits on at most ``max_train_docs`` labelled rows for which ``learn`` (over doc_id) holds."""
    blocks.bound_batches(docs.sparkSession)
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).select("doc_id", F.col(label).cast("double").alias("label"))
    chosen = chosen.groupBy("doc_id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs)
    rows = docs.select(*_inputs(docs, metadata)).join(F.broadcast(chosen), "doc_id")  # broadcast: max_train_docs rows at most
    # One row of each id, that with the smallest text hash, so that what reaches the driver stays bounded.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "meta", "text", "label")).alias("one")).select("doc_id", "one.text", "one.meta", "one.label")

    def run(batches):
        for b in batches:
            got = [features(t, m) for t, m in zip(b.column("text").to_pylist(), b.column("meta").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32())), b.column("doc_id").cast(pa.string()), b.column("label")], ["idx", "x", "doc_id", "label"])

    sample = rows.mapInArrow(run, "idx array<int>, x array<float>, doc_id string, label double").toArrow().sort_by("doc_id")
    machine = Machine((1 << WORD_BITS) + (len(STATS) + len(metadata)) * BINS)
    if len(sample):
        pairs = [(i.values.to_numpy().astype(np.int64), x.values.to_numpy()) for i, x in zip(sample["idx"], sample["x"], strict=True)]
        machine.fit(pairs, sample["label"].to_numpy())
    return machine


def score_quality(docs: DataFrame, machine: Machine, *, metadata: tuple[str, ...] = (), accept: float = ACCEPT) -> DataFrame:
    """doc_id, score, predicted for every row."""

    def run(batches):
        for b in batches:
            scores = [machine.score(*features(t, m)) for t, m in zip(b.column("text").to_pylist(), b.column("meta").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= accept) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(*_inputs(docs, metadata)).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, machine: Machine, *, metadata: tuple[str, ...] = (), accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score at least ``accept``, all columns as they are."""
    names, schema = docs.columns, docs.schema
    # Columns go by number, whatever their names.
    numbered = [f"c{i}" for i in range(len(names))]
    wide = docs.select(*[F.col(blocks.quoted(c)).alias(n) for c, n in zip(names, numbered, strict=True)], F.struct(*_inputs(docs, metadata)[1:]).alias("inputs"))

    def run(batches):
        for b in batches:
            text, meta = (b.column(len(names)).field(x).to_pylist() for x in ("text", "meta"))
            yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names=numbered).filter(pa.array([machine.score(*features(x, m)) >= accept for x, m in zip(text, meta, strict=True)], pa.bool_()))

    kept = wide.mapInArrow(run, StructType([StructField(n, f.dataType) for n, f in zip(numbered, schema.fields, strict=True)]))
    return kept.toDF(*names)

"""Language identification as mixture inference.

A text is a bag of letter trigrams drawn from a mixture of languages.  Expectation-maximisation estimates the
proportions under the learnt trigram likelihoods; the language set is the one whose likelihood less a penalty of
``penalty * log(trigrams)`` for each language beyond the first is largest, among the nested sets of the languages
in order of their proportions.  A bound on what the full mixture can reach bounds every set, so most texts are settled at once.

Counts come from every training text.  Defined cases: null text, or text without a letter, is ``und`` with score 0;
rows without lang aren't learnt from; if nothing was learnt all rows are ``und``; repeated rows are predicted each;
an empty table gives an empty result; columns other than doc_id, text and (in fitting) lang are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelwell.llm import blocks  # functions here travel by value

BITS, PENALTY, ROUNDS, ALPHA = 15, 2.0, 200, 0.5
#: Bytes of a long text that are worked on at once.
PART = 1 << 20
#: EM stops when a round gains less than this in log-likelihood.
GAIN = 1e-3
#: Word characters; a letter is one of them that str.isalpha knows.
WORD = re.compile(r"[^\W\d_]")

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123], _FOLD[65:91], _FOLD[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def counted_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed trigrams of the UTF-8 bytes of the lowered text, and their counts; all ASCII but letters counts as one blank.

    A long text has its trigrams counted in parts.
    """
    b = _FOLD[np.frombuffer((" " + text.lower() + " ").encode(), np.uint8)]
    keep = b != 32
    keep[1:] |= b[:-1] != 32
    keep[0] = True
    b = b[keep]

    def hashed(s: int) -> np.ndarray:
        part = b[s : s + PART + 2].astype(np.uint64)
        code = part[:-2] << np.uint64(16) | part[1:-1] << np.uint64(8) | part[2:]
        return (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)

    if len(b) <= PART + 2:
        g, times = np.unique(hashed(0), return_counts=True)
    else:
        total = np.zeros(1 << BITS, np.int64)
        for s in range(0, len(b) - 2, PART):
            total += np.bincount(hashed(s), minlength=1 << BITS)
        g = np.flatnonzero(total)
        times = total[g]
    return (g, times) if len(g) else (np.zeros(1, np.int64), np.ones(1, np.int64))


def fit_languages(docs: DataFrame, learn: Column) -> tuple[list[str], np.ndarray]:
    """Languages and log P(trigram | language).  What reaches the driver is languages x 2^BITS counts."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                counts = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                g, times = counted_grams(text) if text else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                counts[g] += times
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "gram", "n"])

    blocks.bound_batches(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & learn).select("lang", "text")
    got = rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    counts = np.full((len(langs), 1 << BITS), ALPHA)
    if langs:
        where = {x: i for i, x in enumerate(langs)}
        counts[[where[x] for x in got["lang"].to_pylist()], got["gram"].to_numpy()] += got["n"].to_numpy()
    return langs, np.log(counts / counts.sum(1, keepdims=True)) if langs else counts


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in WORD.finditer(text))


def mixture(like: np.ndarray, times: np.ndarray, below: float = -np.inf, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float]:
    """Proportions by EM, the log-likelihood, and the most that it can be at any proportions.

    like: trigrams x languages, up to a factor per trigram.  With g_j the factor by which a round changes the j-th proportion,
    no proportions reach more than n log max g_j beyond the present ones (the logarithm is concave).  EM ends when that is
    less than ``GAIN``, or when it shows that nothing reaches beyond ``below``.
    """
    n, pi = times.sum(), np.full(like.shape[1], 1 / like.shape[1])
    for left in range(rounds, -1, -1):
        at = like @ pi
        factor = ((times / at) @ like) / n
        reached, room = float(times @ np.log(at)), float(n * np.log(max(1.0, factor.max())))
        if room < GAIN or reached + room <= below or not left:
            break
        pi = pi * factor
    return pi, reached, reached + room


def infer(text: str | None, langs: list[str], logp: np.ndarray, penalty: float = PENALTY) -> tuple[str, float, int]:
    """Main language, its proportion, and the number of languages in the chosen set."""
    if not text or not langs or not has_letter(text):
        return "und", 0.0, 0
    g, times = counted_grams(text)
    log = logp[:, g].T
    log = log - log.max(1, keepdims=True)
    single = times @ log
    best = int(single.argmax())
    fine = penalty * float(np.log1p(times.sum()))
    chosen, share, size, worth = best, 1.0, 1, float(single[best])
    if len(langs) > 1:
        like = np.exp(np.maximum(log, -60))
        pi, _, full = mixture(like, times, worth + fine)
        if full - worth > fine:
            order = np.argsort(-pi, kind="stable")
            for k in range(2, len(langs) + 1):
                if full - (k - 1) * fine <= worth:
                    break
                part, reached, _ = mixture(like[:, order[:k]], times)
                if reached - (k - 1) * fine > worth:
                    worth, size, share, chosen = reached - (k - 1) * fine, k, float(part.max()), int(order[part.argmax()])
    return langs[chosen], min(1.0, share), size


def predict_languages(docs: DataFrame, langs: list[str], logp: np.ndarray, *, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score, n_langs for every row."""
    table = logp.astype(np.float32)

    def run(batches):
        for b in batches:
            got = [infer(t, langs, table, penalty) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.int32())], ["doc_id", "lang_pred", "score", "n_langs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, n_langs int")

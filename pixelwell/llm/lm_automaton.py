"""Language-model scoring with a weighted backoff automaton.

Every n-gram of up to ``order - 1`` words that was counted in training is a state; the root is the empty context.  A
state has an arc for each word that followed it, weighted with the smoothed log-probability, to the longest counted
suffix of its context and that word; and a failure arc, weighted with the log of its backoff mass, to the state of the
context without its oldest word.  The root has an arc for every word.  Smoothing is Dirichlet: with c the training
counts, w a word and h a context,

    P(w|h) = (c(hw) + beta P(w|h')) / (c(h) + beta),      P(w) = (c(w) + 1) / (N + V + 1)

so a missing arc costs exactly log10(beta / (c(h) + beta)) and the distribution sums to one.

Counting covers all training texts.  Each block of documents (see ``blocks``) sends its distinct n-grams, as
64-bit hashes with training counts, to buckets; the buckets answer the totals in the same order; the block then
holds the part of the automaton that its texts can reach and traverses them from left to right.  A state is fixed by
at most ``order - 1`` words, so a long sequence is traversed as strips side by side: each starts at the root
``order - 1`` words early and reaches its first own word in the state that one long traversal would carry there.

Defined cases: null or empty text is the end token alone; repeated rows count and are scored each; an empty table
gives an empty result; with no training text the only probability left is that of an unknown word, 1.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelwell.llm import blocks as B

END = np.uint64(0x45ED5E0F1A2B3C4D)
ORDER, BETA = 3, 200.0
#: Tokens of a strip.
STRIP = 256
#: Raw text whose n-grams, of one length, a bucket takes.
BUCKET_BYTES = 32 << 20
#: Raw text of a block: the larger, the fewer n-grams are sent by several blocks.
BLOCK_BYTES = 12 << 20


@dataclass
class Grams:
    """The distinct n-grams of one length in a block: hashes, ascending, and which of them ends at each token (-1: none)."""

    keys: np.ndarray
    at: np.ndarray


def grams_of(seq: np.ndarray, place: np.ndarray, order: int) -> list[Grams]:
    """``seq``: token hashes of all texts; ``place``: each token's place in its text.

    The end token stands before every text too, so the n-gram at place p has at most p + 2 words; longer ones, which
    would reach into another text, don't exist.
    """
    out, code = [], seq
    for k in range(1, order + 1):
        if k > 1:
            before = np.concatenate((np.array([END], np.uint64), code[:-1]))
            if k == 2:
                before = np.where(place == 0, END, before)
            code = B.mix64(before * np.uint64(0x9E3779B97F4A7C15) + B.mix64(seq + np.uint64(k)))
        ok = place >= k - 2
        keys, inverse = np.unique(code[ok], return_inverse=True)
        at = np.full(len(seq), -1, np.int32)
        at[ok] = inverse
        out.append(Grams(keys, at))
    return out


class BackoffAutomaton:
    """The part of the automaton that one block can reach.

    States are numbered: the root 0, then the counted n-grams of one word, of two, and so on.  An arc is a counted
    n-gram, or a word at the root: ``arc[k]`` holds, for n-grams of k + 1 words, its weight and its state.
    """

    def __init__(self, counts: list[np.ndarray], before: list[np.ndarray], shorter: list[np.ndarray], n: int, v: int, beta: float) -> None:
        """counts[k]: training counts of the (k+1)-grams; before[k], shorter[k]: index of the first and of the last k words of each."""
        order = len(counts)
        seen = [c > 0 for c in counts]
        p = (counts[0] + 1) / (n + v + 1)
        self.depth, self.fail, self.fail_weight = [np.zeros(1, np.int8)], [np.zeros(1, np.int64)], [np.zeros(1)]
        self.arc_weight, self.arc_state, self.seen = [], [], seen
        first, state = 1, np.zeros(len(counts[0]), np.int32)
        for k in range(order):
            if k:
                context = counts[k - 1][before[k]]
                p = (counts[k] + beta * p[shorter[k]]) / (context + beta)
            self.arc_weight.append(np.log10(p))
            # The longest counted suffix that may be a context: the n-gram itself, or the state of its last words.
            up = state[shorter[k]] if k else np.zeros(len(p), np.int32)
            if k < order - 1:
                own = np.flatnonzero(seen[k])
                state = up.copy()
                state[own] = first + np.arange(len(own))
                first += len(own)
                self.depth.append(np.full(len(own), k + 1, np.int8))
                self.fail.append(up[own])
                self.fail_weight.append(np.log10(beta / (counts[k][own] + beta)))
                self.arc_state.append(state)
            else:
                self.arc_state.append(up)
        self.depth, self.fail, self.fail_weight = map(np.concatenate, (self.depth, self.fail, self.fail_weight))

    def traverse(self, at: list[np.ndarray], start: np.ndarray, begin: np.ndarray, own: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Weight collected at each token, over strips of tokens that run from left to right side by side.

        ``at[k][i]``: the (k+1)-gram that ends at token i; ``start[i]``: the state into which a text that begins at token i
        is read, or -1 within a text.  Strip s runs over tokens begin[s]..end[s]-1 and keeps the weights from own[s] on.
        """
        total = np.zeros(len(at[0]))
        arcs = [np.where((x >= 0) & (s[np.maximum(x, 0)] if len(s) else False), x, -1) for x, s in zip(at, self.seen, strict=True)]
        arcs[0] = at[0]  # the root has an arc for every word
        state, i = np.zeros(len(begin), np.int64), begin.copy()
        live = np.flatnonzero(i < end)
        while len(live):
            here, s = i[live], state[live]
            fresh = start[here] >= 0
            s[fresh] = start[here[fresh]]
            weight, arc, depth = np.zeros(len(live)), np.full(len(live), -1, np.int64), self.depth[s]
            open_ = np.arange(len(live))
            while len(open_):
                for k in range(len(arcs)):
                    on = open_[depth[open_] == k]
                    arc[on] = arcs[k][here[on]]
                missed = open_[arc[open_] < 0]
                weight[missed] += self.fail_weight[s[missed]]
                s[missed] = self.fail[s[missed]]
                # Only arcs that were missed are looked for again, one failure arc further.
                depth[missed] = self.depth[s[missed]]
                open_ = missed
            for k in range(len(arcs)):
                on = np.flatnonzero(depth == k)
                weight[on] += self.arc_weight[k][arc[on]]
                s[on] = self.arc_state[k][arc[on]]
            keep = here >= own[live]
            total[here[keep]] = weight[keep]
            state[live] = s
            i[live] += 1
            live = live[i[live] < end[live]]
        return total


def strips(length: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where strips begin, which token is their first own one, and where they end."""
    own = np.arange(0, length, STRIP)
    return np.maximum(0, own - (order - 1)), own, np.minimum(own + STRIP, length)


def score_block(length: np.ndarray, grams: list[Grams], counts: list[np.ndarray], n: int, v: int, beta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens, base score and score of each text of a block.  Of ``grams``, only the keys of single words are used."""
    order, tokens = len(grams), int(length.sum())
    begins = np.cumsum(length) - length
    before, shorter = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    end_token = int(np.searchsorted(grams[0].keys, END))
    for k in range(1, order):
        at, lower = grams[k].at, grams[k - 1].at
        prev = np.concatenate((np.array([-1], np.int32), lower))[:-1]
        if k == 1:
            prev[begins] = end_token
        has = at >= 0
        first, last = np.zeros(len(counts[k]), np.int32), np.zeros(len(counts[k]), np.int32)
        first[at[has]], last[at[has]] = prev[has], lower[has]
        before.append(first)
        shorter.append(last)
    automaton = BackoffAutomaton(counts, before, shorter, n, v, beta)
    start = np.full(tokens, -1, np.int32)
    start[begins] = automaton.arc_state[0][end_token] if order > 1 else 0
    weight = automaton.traverse([g.at for g in grams], start, *strips(tokens, order))
    add = lambda x: np.add.reduceat(x, begins) if len(begins) else np.zeros(0)
    word = grams[0].at
    return add((counts[0] > 0)[word].astype(np.int64)), add(automaton.arc_weight[0][word]), add(weight)


def _block_tokens(texts, hasher: B.WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts with their end tokens, and each text's length in tokens."""
    words, n = hasher(*B.text_buffers(texts))
    seq = np.full(len(words) + len(n), END, np.uint64)
    seq[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
    return seq, n + 1


def _places(length: np.ndarray) -> np.ndarray:
    return np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)


def score_texts(docs: DataFrame, held_out: Column, *, order: int = ORDER, beta: float = BETA) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``held_out``: boolean column over doc_id; where it is true a text is scored but not learnt.  ``order``: words of the
    longest n-gram, 1 at least.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    plan = B.layout(docs, BUCKET_BYTES // order, BLOCK_BYTES)
    n = plan.buckets
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))

    def ask(part: pa.Table):
        seq, length = _block_tokens(part["text"], B.WordHasher())
        train = np.repeat(~part["held_out"].to_numpy(), length)
        grams, out = grams_of(seq, _places(length), order), []
        for k, g in enumerate(grams):
            count = np.bincount(g.at[train & (g.at >= 0)], minlength=len(g.keys)).astype(np.uint32)
            cuts = {b: (s, e) for b, s, e in B.runs(B.bucket_of(g.keys, n))}
            # Every bucket hears from every block once at least, and so replies its share of the corpus sizes.
            for b in cuts if k else range(n):
                s, e = cuts.get(b, (0, 0))
                out.append((b, k, B.frame([B.pack_sorted(g.keys[s:e]), B.pack_ints(count[s:e])])))
        head = B.pack_table(pa.table([part["doc_id"], part["held_out"], pa.array(length)], ["doc_id", "held_out", "length"]))
        return B.frame([head, B.pack_sorted(grams[0].keys), *B.pack_ranked(grams[0].at, len(grams[0].keys))]), out

    def answer(asked: list) -> list[bytes]:
        out: list[bytes] = [b""] * len(asked)
        for k in range(order):
            mine = [i for i, x in enumerate(asked) if x[0] == k]
            blobs = [B.unframe(asked[i][1]) for i in mine]
            keys = [B.unpack_sorted(x[0]) for x in blobs]
            if not keys:
                continue
            counts = np.concatenate([B.unpack_ints(x[1], np.uint32) for x in blobs])
            cuts = np.cumsum([len(x) for x in keys])
            keys = np.concatenate(keys)
            by = np.argsort(keys, kind="stable")
            new = np.ones(len(by), bool)
            new[1:] = keys[by[1:]] != keys[by[:-1]]
            starts = np.flatnonzero(new)
            total = np.add.reduceat(counts[by].astype(np.uint64), starts) if len(by) else np.zeros(0, np.uint64)
            each = np.empty(len(by), np.uint64)
            each[by] = np.repeat(total, np.diff(starts, append=len(by)))
            own = np.array([total.sum(), (total > 0).sum()], np.uint64).tobytes()
            for i, part in zip(mine, np.split(each, cuts[:-1]), strict=True):
                out[i] = B.frame([B.pack_ints(part), own])
        return out

    def finish(kept: bytes, replies: list) -> pa.Table:
        head, keys, *at = B.unframe(kept)
        head = B.unpack_table(head)
        length = head["length"].to_numpy()
        seq = B.unpack_sorted(keys)[B.unpack_ranked(at)]
        grams = grams_of(seq, _places(length), order)
        del seq
        for g in grams[1:]:
            g.keys = g.keys[:0].copy()
        counts: list[list] = [[np.zeros(0)] for _ in grams]
        sizes = np.zeros(2, np.int64)
        for k, blob in replies:
            part, own = B.unframe(blob)
            counts[k].append(B.unpack_ints(part, np.uint64).astype(np.float64))
            if not k:
                sizes += np.frombuffer(own, np.int64)
        big_n, big_v = sizes.tolist()
        known, base, score = score_block(length, grams, list(map(np.concatenate, counts)), big_n, big_v, beta)
        return pa.table(
            [head["doc_id"], head["held_out"], pa.array(length, pa.int64()), pa.array(known, pa.int64()), pa.array([big_n] * len(length), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return B.exchange(rows, plan, ask, answer, finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

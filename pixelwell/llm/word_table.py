"""A table of the distinct words of a corpus, each worked on once, and its way back to the documents by position.

Every text is split once.  A block (see ``blocks``) numbers its distinct words, keeps its documents as sequences of
those numbers, and sends each distinct word to a hash bucket.  A bucket works once on each of its words, whatever
number of blocks ask for it, and answers in the order of asking; answers and word numbers meet again in the block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelwell.llm import blocks as B
from pixelwell.llm.tokens import Splitter


#: Raw text of a block here: its distinct words are Python strings.
BLOCK_BYTES = 4 << 20


@dataclass
class Block:
    """A block's documents: ids, raw bytes, and entries (word numbers, and how often if counted) of each in turn."""

    ids: pa.ChunkedArray
    n_bytes: np.ndarray
    entries: np.ndarray
    words: np.ndarray
    times: np.ndarray | None
    answers: list[bytes]  # by word number

    def ends(self) -> np.ndarray:
        return np.cumsum(self.entries)


def _numbered(texts: pa.ChunkedArray, split: Callable, counted: bool):
    """Words in the order of their numbers, and the entries of all texts."""
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    words, times, entries = [], [], []
    for text in texts:
        found = split(text.as_py() or "")
        if counted:
            found = Counter(found)
            times.append(np.fromiter(found.values(), np.uint32, len(found)))
        words.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
        entries.append(len(found))
    none = [np.zeros(0, np.uint32)]
    return list(number), np.array(entries, np.int64), np.concatenate(words or none), np.concatenate(times or none) if counted else None


def per_distinct_word(docs: DataFrame, spec: str, work: Callable, finish: Callable, schema: str, *, counted: bool = False) -> DataFrame:
    """Calls ``work(splitter)(word) -> bytes`` once per distinct word, then ``finish(splitter, block) -> table`` per block.

    ``counted``: a document is its distinct words with their frequencies, in place of its words in order.
    """
    plan = B.layout(docs, block_bytes=BLOCK_BYTES)
    n = plan.buckets
    made: list[Splitter] = []

    def splitter() -> Splitter:
        """One for each task."""
        if not made:
            made.append(Splitter(spec))
        return made[0]

    def ask(part: pa.Table):
        found, entries, numbers, times = _numbered(part["text"], splitter().words, counted)
        raw = [w.encode() for w in found]
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % n for w in raw), np.int64, len(raw))
        order = np.argsort(bucket, kind="stable")
        head = pa.table([part["doc_id"], pa.array(np.diff(B.text_buffers(part["text"])[1])), pa.array(entries)], ["doc_id", "n_bytes", "entries"])
        # A word's number is its place among the words sent.
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        kept = [B.pack_table(head), *B.pack_ranked(place[numbers], len(order)), *([B.pack_ints(times)] if counted else [])]
        return B.frame(kept), [(k, 0, B.pack_strings([raw[i] for i in order[s:e].tolist()])) for k, s, e in B.runs(bucket[order])]

    def answer(asked: list) -> list[bytes]:
        one, known, out = work(splitter()), {}, []
        for _, blob in asked:
            words = B.unpack_strings(blob)
            for w in words:
                if w not in known:
                    known[w] = one(w.decode())
            out.append(B.pack_strings([known[w] for w in words]))
        return out

    def close(kept: bytes, replies: list) -> pa.Table:
        head, ranks, order, *times = B.unframe(kept)
        head = B.unpack_table(head)
        answers = [x for _, blob in replies for x in B.unpack_strings(blob)]
        times = B.unpack_ints(times[0], np.uint32) if counted else None
        return finish(splitter(), Block(head["doc_id"], head["n_bytes"].to_numpy(), head["entries"].to_numpy(), B.unpack_ranked([ranks, order]), times, answers))

    return B.exchange(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), plan, ask, answer, close, schema)

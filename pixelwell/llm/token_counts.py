"""Token counts from piece counts of distinct pre-tokens.

The pieces of every distinct pre-token of the corpus are counted once; a document's count is the sum over its
pre-token frequencies of those counts.  No ids are kept or sent.

Defined cases: null text is the empty text with no tokens; repeated rows are counted each; an empty table gives an
empty result; special strings are one token; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelwell.llm.tokens import Splitter, read_spec
from pixelwell.llm.word_table import Block, per_distinct_word


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spec = read_spec(tokenizer)

    def work(split: Splitter):
        return lambda word: np.uint32(len(split.encode(word))).tobytes()

    def finish(split: Splitter, block: Block) -> pa.Table:
        pieces = np.frombuffer(b"".join(block.answers), "<u4").astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(pieces[block.words] * block.times)))
        ends = block.ends()
        n = upto[ends] - upto[ends - block.entries]
        return pa.table([block.ids, pa.array(block.n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_distinct_word(docs, spec, work, finish, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", counted=True)

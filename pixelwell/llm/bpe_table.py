"""BPE encoding and decoding through a table of distinct words.

Texts are split into words once, every distinct word of the corpus is encoded once and its ids are joined with the
id-to-piece table, and ids and pieces are joined back to the words' positions.  The id-to-piece table is as
large as the vocabulary file and no larger.

Defined cases: null text is the empty text, with no ids; repeated rows are encoded each; an empty table gives an
empty result; special strings inside a text become their special ids; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelwell.llm import blocks as B
from pixelwell.llm.tokens import Splitter, read_spec
from pixelwell.llm.word_table import Block, per_distinct_word


def gather(flat: np.ndarray, ends: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``pick`` of a list column (values and ends), one after the other, and the length of each."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    size = (ends - starts)[pick]
    before = np.cumsum(size) - size
    at = np.repeat(starts[pick] - before, size) + np.arange(int(size.sum()))
    return flat[at], size


def encode_decode(docs: DataFrame, tokenizer: str, *, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids and the decoded text on demand.

    ``tokenizer``: path of a tokenizers file with byte-level BPE.
    """
    spec = read_spec(tokenizer)

    def work(split: Splitter):
        """word -> its ids and, where pieces are simply joined with blanks, the text that they decode to."""
        pieces, joined = split.pieces(), split.tokenizer.decoder is None

        def one(word: str) -> bytes:
            ids = split.encode(word)
            text = " ".join(pieces[i] for i in ids).encode() if joined else b""
            return np.array([len(ids), *ids], "<u4").tobytes() + text

        return one

    def finish(split: Splitter, block: Block) -> pa.Table:
        rule = split.tokenizer.decoder
        pieces = split.pieces() if rule is not None else {}
        n_of = [int.from_bytes(x[:4], "little") for x in block.answers]
        flat = np.frombuffer(b"".join(x[4 : 4 + 4 * n] for x, n in zip(block.answers, n_of, strict=True)), "<u4")
        decoded_of = [x[4 + 4 * n :].decode() for x, n in zip(block.answers, n_of, strict=True)]
        ids, size = gather(flat, np.cumsum(n_of, dtype=np.int64), block.words)
        upto = np.concatenate(([0], np.cumsum(size)))
        cuts, words = np.concatenate(([0], block.ends())).tolist(), block.words.tolist()
        n, digest, back, texts = [], [], [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            own = ids[upto[s] : upto[e]]
            text = " ".join(map(decoded_of.__getitem__, words[s:e])) if rule is None else rule.decode([pieces[i] for i in own.tolist()])
            n.append(len(own))
            digest.append(hashlib.sha256(own.tobytes()).hexdigest())
            back.append(hashlib.sha256(text.encode()).hexdigest())
            if keep_text:
                texts.append(text)
        cols = [block.ids, pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
        if keep_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids.astype(np.int32))))
        cols += [pa.array(texts, pa.string())] * keep_text
        return pa.table(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids, *["decoded"] * keep_text])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return per_distinct_word(docs, spec, work, finish, schema)


def piece_table(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """id, piece of a tokenizers file, as a table."""
    pieces = Splitter(read_spec(tokenizer)).pieces()
    return encoded.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"id": i, "piece": p} for i, p in sorted(pieces.items())])), "array<struct<id:int,piece:string>>")).alias("p")).select("p.id", "p.piece")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``decoded`` to rows with ``ids array<int>``, in place of such a column; null ids give null, ids outside the vocabulary are skipped.

    Distinct id lists are joined with the id-to-piece table by id and put together again by position.
    """
    rule = json.loads(read_spec(tokenizer))["decoder"]
    if rule is not None and rule["type"] != "ByteLevel":
        raise ValueError("pieces of this file aren't joined simply")
    kept = encoded.drop("decoded")
    ids = F.col("ids")
    lists = kept.where(ids.isNotNull()).select("ids").distinct().withColumn("key", F.sha2(F.to_json("ids"), 256))
    placed = lists.select("key", F.posexplode("ids").alias("at", "id"))
    table = piece_table(encoded, tokenizer)  # as large as the vocabulary file
    pieces = placed.join(F.broadcast(table), "id").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "" if rule else " ").alias("decoded"))
    if rule:
        shown = Splitter(read_spec(tokenizer)).bytes

        @F.pandas_udf("string")
        def plain(x):
            return x.map(lambda t: bytes(map(shown.__getitem__, t)).decode(errors="replace"))

        pieces = pieces.withColumn("decoded", plain("decoded"))
    name = B.unused(kept, "__key")
    keyed = kept.withColumn(name, F.sha2(F.to_json("ids"), 256))
    pieces = pieces.withColumnRenamed("key", name)
    return keyed.join(pieces, name, "left").withColumn("decoded", F.when(ids.isNotNull(), F.coalesce("decoded", F.lit("")))).drop(name)

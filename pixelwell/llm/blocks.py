"""Shared plumbing for the operators that work on whole texts.

*Blocks and buckets.*  Several operators must look up a corpus-wide value (a count, an encoding) for every
token of every document.  Shuffling token positions would move many times the input.  Instead the rows that a task
reads are cut into **blocks** of some MB of raw text; each block sends its *distinct* keys to hash **buckets** as packed,
compressed runs, the bucket answers each block, and the block finishes its documents.  A key reaches a bucket
once per block however frequent it is, so no key is hot; the block size bounds the memory of a task.

*Sizes* follow from the raw UTF-8 bytes of all texts and the session's parallelism (``layout``).  Blocks hold
``BLOCK_BYTES``; buckets number four for each core until each has the keys of ``BUCKET_BYTES``.  Both grow with the root of
the input where a run would otherwise hold fewer than ``RUN_KEYS`` keys, so the number of runs stays in proportion
to the input at any size.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.cloudpickle as cloudpickle
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

# Functions of this package travel to the executors by value: no files need to be shipped with them.
cloudpickle.register_pickle_by_value(sys.modules["pixelwell.llm"])

#: Raw bytes of text in a block, and whose keys a bucket takes; a distinct key stands for about KEY_BYTES of text.
BLOCK_BYTES, BUCKET_BYTES, RUN_KEYS, KEY_BYTES = 8 << 20, 64 << 20, 64, 8


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Layout:
    rows: int
    raw_bytes: int
    block_bytes: int
    blocks: int
    buckets: int
    deal: int  # partitions to deal the rows to first, or 0


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES: 10,000 rows of long texts would be hundreds of MB in both processes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def layout(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, block_bytes: int = BLOCK_BYTES) -> Layout:
    """Sizes from one pass over the texts' lengths.  ``bucket_bytes``: raw text whose keys a bucket takes.

    Rows are dealt anew only where one partition of the input holds more than two cores' share.
    """
    bound_batches(docs.sparkSession)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    parts = docs.select(size.alias("b"), F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    r = parts.agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("b").alias("most")).first()
    rows, raw, cores = int(r["n"] or 0), int(r["b"] or 0), docs.sparkSession.sparkContext.defaultParallelism
    wide = math.isqrt(KEY_BYTES * RUN_KEYS * raw)
    block = max(block_bytes, wide)
    buckets = max(1, min(4 * cores, math.ceil(raw / (1 << 20))), math.ceil(raw / max(bucket_bytes, wide)))
    blocks = max(1, math.ceil(raw / block))
    uneven = int(r["most"] or 0) > max(1 << 20, 2 * raw / cores)
    return Layout(rows, raw, block, blocks, buckets, max(cores, blocks) if uneven else 0)


def dealt(rows: DataFrame, plan: Layout) -> DataFrame:
    """``rows`` (with doc_id and text) in the partitions that ``plan`` asks for, in an order that a lost task finds again."""
    if not plan.deal:
        return rows
    return rows.repartition(plan.deal).sortWithinPartitions(F.xxhash64("doc_id", "text"))


def cut(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """The task's rows as (number, block) of about ``block_bytes`` of text each, a row at least.

    A block's number tells the task and its place there; it is the same when a lost task is run again.
    """
    task = TaskContext.get()
    first = (task.partitionId() if task else 0) << 32
    held: list[pa.RecordBatch] = []
    room, at_block = block_bytes, 0
    for b in batches:
        _, offsets = text_buffers(b.column("text"))
        at = 0
        while at < len(b):
            to = int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1
            if to <= at and held:
                yield first + at_block, pa.Table.from_batches(held)
                held, room, at_block = [], block_bytes, at_block + 1
                continue
            to = min(len(b), max(at + 1, to))
            held.append(b.slice(at, to - at))
            room -= int(offsets[to] - offsets[at])
            at = to
            if room <= 0:
                yield first + at_block, pa.Table.from_batches(held)
                held, room, at_block = [], block_bytes, at_block + 1
    if held:
        yield first + at_block, pa.Table.from_batches(held)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one's own where Spark runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return str(have.get())
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get())


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def columns(df: DataFrame) -> list:
    """The columns of ``df``, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def content(column) -> int:
    """A checksum of an Arrow string column."""
    data, offsets = text_buffers(column)
    h = xxhash.xxh3_64(offsets.tobytes() if not len(offsets) else (offsets - offsets[0]).tobytes())
    h.update(data[int(offsets[0]) : int(offsets[-1])].tobytes())
    return h.intdigest() >> 1


ASKED = "home int, block long, content long, bucket int, k int, ask binary, docs binary"
ANSWERED = "home int, block long, content long, bucket int, k int, answer binary"


def exchange(rows: DataFrame, plan: Layout, ask: Callable, answer: Callable, finish: Callable, schema: str) -> DataFrame:
    """Blocks of ``rows`` (with doc_id and text) ask buckets and finish with the answers.

    ``ask(block) -> (kept, [(bucket, k, request)])``: what the block keeps of its documents, and its requests;
    ``answer([(k, request)]) -> [reply]``: all requests that one bucket gets;
    ``finish(kept, [(k, reply)]) -> table``: the replies in the order of k and bucket.

    One shuffle takes requests to their buckets and what blocks keep to homes of their own; a second one takes the
    replies to those homes.  A task that is run again cuts the same blocks from the same rows; a checksum tells if
    the rows themselves came in another order (they don't from a table), and the job ends with an error.
    """
    n = plan.buckets
    homes = max(plan.blocks, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    out_schema = to_arrow_schema(_parse_datatype_string(schema))
    # Tasks' blocks go to homes in turn, so that few blocks spread evenly too.
    home_of = lambda block: n + ((block >> 32) + 7919 * (block & 0xFFFFFFFF)) % homes

    def send(batches):
        for block, part in cut(batches, plan.block_bytes):
            check = content(part["text"])
            kept, asked = ask(part)
            m = len(asked)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*(x[0] for x in asked), home_of(block)], pa.int32()),
                    pa.array([block] * (m + 1), pa.int64()),
                    pa.array([check] * (m + 1), pa.int64()),
                    pa.array([*(x[0] for x in asked), None], pa.int32()),
                    pa.array([*(x[1] for x in asked), None], pa.int32()),
                    pa.array([*(x[2] for x in asked), None], pa.binary()),
                    pa.array([None] * m + [kept], pa.binary()),
                ],
                ["home", "block", "content", "bucket", "k", "ask", "docs"],
            )
            del kept, asked, part
            give_back()

    def meet(table: pa.Table) -> pa.Table:
        replies = answer(list(zip(table["k"].to_pylist(), table["ask"].to_pylist(), strict=True)))
        give_back()
        return pa.table([pa.array(map(home_of, table["block"].to_pylist()), pa.int32()), table["block"], table["content"], table["bucket"], table["k"], pa.array(replies, pa.binary())], ["home", "block", "content", "bucket", "k", "answer"])

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        asked_by: dict[int, list[int]] = {}
        order = np.lexsort((right["bucket"].to_numpy(), right["k"].to_numpy())) if len(right) else []
        for i, b in zip(order, right["block"].take(pa.array(order, pa.int64())).to_pylist(), strict=True):
            asked_by.setdefault(b, []).append(int(i))
        done = [out_schema.empty_table()]
        for block, check, kept in zip(*(left[c].to_pylist() for c in ("block", "content", "docs")), strict=True):
            mine = asked_by.get(block, [])
            if any(right["content"][i].as_py() != check for i in mine):
                raise RuntimeError("the rows of a block changed between two runs of a task: write the documents to a table first")
            done.append(finish(kept, [(right["k"][i].as_py(), right["answer"][i].as_py()) for i in mine]).cast(out_schema))
        give_back()
        return pa.concat_tables(done)

    def only(sent: DataFrame, condition: Column) -> DataFrame:
        # With floor(rand()), which is 0, the condition stays above the exchange, and both uses share that one.
        return sent.where(condition.cast("int") + F.floor(F.rand()) == 1)

    sent = dealt(rows, plan).mapInArrow(send, ASKED).repartitionById(n + homes, "home")
    back = only(sent, F.col("docs").isNull()).groupBy("home").applyInArrow(meet, ANSWERED).repartitionById(n + homes, "home")
    return only(sent, F.col("docs").isNotNull()).groupBy("home").cogroup(back.groupBy("home")).applyInArrow(close, schema)


def give_back() -> None:
    """Returns what this worker has freed to the system: workers are kept, and stages of one job share an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def id_crc(col: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------- packed runs


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def pack_ints(a: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane, so that leading zero bytes vanish."""
    a = np.ascontiguousarray(a)
    return squeeze(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())


def unpack_ints(blob: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(unsqueeze(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending uint64 as differences."""
    return pack_ints(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(blob, np.uint64), dtype=np.uint64)


def pack_coded(a: np.ndarray) -> bytes:
    """uint64 with repeats: the distinct values, ascending, and their numbers."""
    values, number = np.unique(a, return_inverse=True)
    known = pack_sorted(values)
    return np.uint32(len(known)).tobytes() + known + pack_ints(number.astype(np.uint32))


def unpack_coded(blob: bytes) -> np.ndarray:
    end = 4 + int(np.frombuffer(blob, np.uint32, 1)[0])
    return unpack_sorted(blob[4:end])[unpack_ints(blob[end:], np.uint32)]


def frame(blobs: list[bytes]) -> bytes:
    """Byte strings as one, not compressed."""
    return np.array([len(blobs), *map(len, blobs)], "<u4").tobytes() + b"".join(blobs)


def unframe(raw: bytes) -> list[bytes]:
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    return [raw[s:e] for s, e in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def pack_ranked(a: np.ndarray, kinds: int) -> list[bytes]:
    """Numbers below ``kinds``, coded by how frequent they are: the ranks, and the number of each rank."""
    order = np.argsort(-np.bincount(a, minlength=kinds), kind="stable").astype(np.uint32)
    rank = np.empty(kinds, np.uint32)
    rank[order] = np.arange(kinds, dtype=np.uint32)
    return [pack_ints(rank[a]), pack_ints(order)]


def unpack_ranked(blobs: list[bytes]) -> np.ndarray:
    return unpack_ints(blobs[1], np.uint32)[unpack_ints(blobs[0], np.uint32)]


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return squeeze(sink.getvalue().to_pybytes())


def unpack_table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(unsqueeze(blob)).read_all()


def pack_strings(words: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, words), np.uint32, len(words))
    return squeeze(np.uint32(len(words)).tobytes() + lens.tobytes() + b"".join(words))


def unpack_strings(blob: bytes) -> list[bytes]:
    raw = unsqueeze(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    out, at = [], 4 + 4 * n
    for end in ends.tolist():
        out.append(raw[at:end])
        at = end
    return out


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Range of the hash space that a key falls in: ascending keys have ascending buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def runs(buckets: np.ndarray):
    """(bucket, start, end) of an ascending array."""
    if not len(buckets):
        return
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    starts = np.concatenate(([0], cuts))
    for s, e in zip(starts.tolist(), np.concatenate((cuts, [len(buckets)])).tolist(), strict=True):
        yield int(buckets[s]), s, e


# ---------------------------------------------------------------- words as numbers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes that are hashed at once.
PART_BYTES = 1 << 20


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts, A-Z lowered, without making strings.

    A word's hash is the sum of random byte values times powers of an odd base, modulo 2^64, scrambled with
    its length; sums over a range come from one running sum.
    """

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(20240607))
        values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        values[65:91] = values[97:123]
        self.values = values
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << (n - 1).bit_length()
            for name, b in (("powers", self.base), ("inverses", self.inverse)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the number of words of each text.  A long text is worked through in parts cut between words."""
        hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
        at, n = 0, len(offsets) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, "right")) - 1)
            to = min(to, n)
            for s, e in self.parts(data, int(offsets[at]), int(offsets[to])):
                # Texts that end within the part; a text that goes on has its edge at the part's.
                off = np.clip(offsets[at : to + 1] - s, 0, e - s).astype(np.int64)
                h, k = self.part(data[s:e], off)
                hashes.append(h)
                counts[at:to] += k
            at = to
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts

    def parts(self, data: np.ndarray, start: int, end: int) -> Iterator[tuple[int, int]]:
        """Ranges of about PART_BYTES that end before a blank, where there is one."""
        while end - start > 2 * PART_BYTES:
            stop, look = start + PART_BYTES, 4096
            while True:
                blank = self.space[data[stop : min(end, stop + look)]]
                if blank.any():
                    stop += int(blank.argmax())
                    break
                if stop + look >= end:
                    stop = end
                    break
                look *= 16
            yield start, stop
            start = stop
        if start < end:
            yield start, end

    def part(self, part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.reach(len(part) + 1)
        word = ~self.space[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[off] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(self.values[part] * self.powers[: len(part)], dtype=np.uint64, out=run[1:])
        h = (run[ends] - run[starts]) * self.inverses[starts]
        return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40))), np.diff(np.searchsorted(starts, off))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.large_string())
    a = pc.fill_null(a.cast(pa.large_string()), "")
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets



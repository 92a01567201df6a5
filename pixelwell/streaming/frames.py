"""The frame loop: gating, carrying the last output, rates, and running statistics, as batch and as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelwell.operators.stats import stats_maker


def gated_frames(df: DataFrame, by: str, order: list[str], request: Column, found: Column) -> DataFrame:
    """df with processed: a frame is processed if something was found and a request is open since the last processed one.

    Between two requests the first found frame is processed, so the gate is a running count and needs no state.
    """
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumns({"__epoch": F.sum(F.when(request, 1).otherwise(0)).over(w), "__found": found})
    first = F.sum(F.when(F.col("__found"), 1).otherwise(0)).over(W.partitionBy(by, "__epoch").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("processed", (F.col("__epoch") > 0) & F.col("__found") & (first == 1)).drop("__epoch", "__found")


def last_output(by: str, order: list[str], output: Column) -> Column:
    return F.last(output, ignorenulls=True).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def frame_rate(by: str, order: list[str], ts: str) -> Column:
    """Frames per second from the gap to the frame before; null for the first and for equal times."""
    us = F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    return F.try_divide(F.lit(1e6), us - F.lag(us).over(W.partitionBy(by).orderBy(*order)))


def stream_stats(stream: DataFrame, value: str, *by: str) -> DataFrame:
    """Running statistics of a stream; the same aggregates as in batch, kept up to date."""
    return stats_maker(stream, value, *by)


def windowed_stats(stream: DataFrame, ts: str, value: str, window: str, late: str) -> DataFrame:
    return stats_maker(stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).withColumn("window", F.window("__ts", window)), value, "window")


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Works off what has arrived and returns the result table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def carry_last(stream: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """key, at, value: per key and micro-batch the last value, by order, that isn't null so far.

    The state is that value and its place in the order (whole numbers, or microseconds of a timestamp); of equal places
    the larger value counts, so the result depends neither on the rows' arrival nor on the micro-batches.
    """
    kind = stream.schema[by].dataType.simpleString()
    place = F.unix_micros(F.col(order).cast("timestamp")) if "timestamp" in stream.schema[order].dataType.simpleString() else F.col(order).cast("bigint")

    def step(key, batches, state):
        last = tuple(state.get) if state.exists else None
        for pdf in batches:
            seen = pdf.dropna(subset=["at", "value"])
            if len(seen):
                at = int(seen["at"].max())
                found = (at, float(seen.loc[seen["at"] == at, "value"].max()))
                last = found if last is None else max(last, found)
        if last is not None:
            state.update(last)
            yield pd.DataFrame({"key": [key[0]], "at": [last[0]], "value": [last[1]]})

    rows = stream.select(F.col(by).alias("key"), place.alias("at"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, at bigint, value double", "at bigint, value double", "update", "NoTimeout")


def gate_stream(stream: DataFrame, by: str, order: str, request: Column, found: Column) -> DataFrame:
    """key, at, processed: ``gated_frames`` for a stream; the state of a key is whether its gate is open.

    A key's rows of one micro-batch are sorted in memory, so the trigger's size bounds them; rows of a later micro-batch
    count as later.  Null requests and null finds count as none.
    """
    kinds = [stream.schema[c].dataType.simpleString() for c in (by, order)]
    flag = lambda c: F.coalesce(c, F.lit(False))

    def step(key, batches, state):
        is_open = bool(state.get[0]) if state.exists else False
        rows, done = pd.concat(list(batches)).sort_values("at", kind="stable"), []
        for asked, seen in zip(rows["asked"], rows["seen"], strict=True):
            hit = (is_open or asked) and seen
            is_open = (is_open or asked) and not hit
            done.append(bool(hit))
        state.update((bool(is_open),))
        yield pd.DataFrame({"key": [key[0]] * len(rows), "at": rows["at"].to_numpy(), "processed": done})

    rows = stream.select(F.col(by).alias("key"), F.col(order).alias("at"), flag(request).alias("asked"), flag(found).alias("seen"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kinds[0]}, at {kinds[1]}, processed boolean", "is_open boolean", "append", "NoTimeout")

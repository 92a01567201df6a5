"""Sinks: descriptor texts, image tables, and the latest row of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelwell.functions.text import serialize_vec, to_data_url


def descriptor_text(df: DataFrame) -> DataFrame:
    """filename, value: ``#filename``, then ``block,label, v0, v1, ...`` in block order."""
    line = F.concat(F.col("block").cast("string"), F.lit(","), F.col("label").cast("string"), F.lit(", "), serialize_vec("vec"))
    per = df.select("filename", F.struct("block", line.alias("line")).alias("l")).groupBy("filename").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    return per.select("filename", F.concat(F.lit("#"), "filename", F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("value"))


def write_descriptors(df: DataFrame, path: str) -> None:
    """Appends; earlier output is never overwritten."""
    descriptor_text(df).select("value").write.mode("append").text(path)


def write_images(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def data_urls(df: DataFrame, data: str = "data", kind: str = "png") -> DataFrame:
    return df.withColumn("url", to_data_url(F.col(data), kind))


def write_latest(stream: DataFrame, path: str, order: str, checkpoint: str):
    """A query that keeps only the newest row of each micro-batch that has any."""

    def save(batch: DataFrame, _: int) -> None:
        batch.orderBy(F.desc(order)).limit(1).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

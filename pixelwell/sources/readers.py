"""Readers: image folders, annotation and size/lane texts, CSV, frame streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelwell.functions.text import is_comment, parse_annotation, parse_size_lane, stem

IMAGE = r"(?i)\.(png|jpe?g)$"


def require_columns(df: DataFrame, expected: dict[str, type[T.DataType]]) -> DataFrame:
    """df itself; a TypeError when the plan is built if a column is missing or of another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for name, kind in expected.items():
        if name not in have or not isinstance(have[name], kind):
            raise TypeError(f"column {name} is {have.get(name, 'missing')}. Expected {kind.__name__}")
    return df


def list_files(spark: SparkSession, root: str, *, images_only: bool = True, skip_folder: str | None = None, skip_stem: str | None = None) -> DataFrame:
    """path, modificationTime, length of all files below root.

    ``skip_folder``: files directly in folders that end so are left out; ``skip_stem``: likewise by stem.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    if images_only:
        df = df.where(F.col("path").rlike(IMAGE))
    if skip_folder:
        df = df.where(~F.element_at(F.split("path", "/"), -2).endswith(skip_folder))
    if skip_stem:
        df = df.where(~stem(F.col("path")).endswith(skip_stem))
    return df


def read_images(spark: SparkSession, root: str, *, keep_invalid: bool = False) -> DataFrame:
    """path, width, height, channels, valid and data (BGR, row-major) of decodable images below root."""
    df = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", str(not keep_invalid).lower()).load(root)
    return df.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), (F.col("image.height") > 0).alias("valid"), "image.data")


def bytes_to_ints(data: Column, n: Column) -> Column:
    """The first n unsigned bytes of a binary column as an array; null without data."""

    @F.pandas_udf("array<int>")
    def run(raw: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.frombuffer(x, np.uint8)[: int(c)].astype(np.int32) for x, c in zip(raw, count, strict=True)])

    return run(data, n)


def channel(data: Column, pixels: Column, channels: int, k: int) -> Column:
    """Every ``channels``-th byte from the k-th on, one for each pixel."""

    @F.pandas_udf("array<int>")
    def run(raw: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.frombuffer(x, np.uint8)[k::channels][: int(c)].astype(np.int32) for x, c in zip(raw, count, strict=True)])

    return run(data, pixels)


def read_annotations(spark: SparkSession, root: str) -> DataFrame:
    """stem and the first matching ``left, top, width, height`` line of every text below root."""
    lines = spark.read.text(root, wholetext=True).select(stem(F.input_file_name()).alias("stem"), F.posexplode(F.split("value", "\n")).alias("no", "line"))
    got = lines.where(~is_comment(F.col("line"))).withColumn("a", parse_annotation(F.col("line"))).where("a.l is not null and a.h is not null")
    return got.groupBy("stem").agg(F.min_by("a", "no").alias("a")).select("stem", "a.*")


def read_size_lane(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where((F.col("line") != "") & ~is_comment(F.col("line")))
    return lines.select(parse_size_lane(F.col("line")).alias("s")).select("s.*").where("size is not null")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header row; ``#DIV/0!`` is null.  Types are inferred only without a schema."""
    r = spark.read.option("header", "true").option("nullValue", "#DIV/0!")
    return (r.schema(schema) if schema else r.option("inferSchema", "true")).csv(path)


def image_mask_pairs(images: DataFrame, masks: DataFrame, prefix: str) -> DataFrame:
    """Images with the mask whose stem is the image's with a prefix."""
    a = images.withColumn("stem", stem(F.col("path")))
    b = masks.where(stem(F.col("path")).startswith(prefix)).select(F.substr(stem(F.col("path")), F.lit(len(prefix) + 1)).alias("stem"), F.struct("width", "height", "data").alias("mask"))
    return a.join(b, "stem")


def frames(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the image files that arrive in a folder."""
    return spark.readStream.format("binaryFile").load(root)


def labelled(parts: dict[int, DataFrame]) -> DataFrame:
    """Rows of several folders with the label of each (1 good, 0 bad, -1 to validate)."""
    out = None
    for label, df in parts.items():
        rows = df.withColumn("label", F.lit(label))
        out = rows if out is None else out.unionByName(rows)
    return out


def last_written(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")

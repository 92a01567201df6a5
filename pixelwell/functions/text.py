"""Text records: patterns, paths, data URLs and vector serialisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SIZE_LANE = r"^\s*(\d+)\s*,\s*(\d+)"
FOUR = r"^\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
DATA_URL = r"data:image/(png|jpeg);base64,(.*)$"


def is_comment(line: Column) -> Column:
    return line.rlike(r"^\s*#")


def _group(line: Column, pattern: str, k: int) -> Column:
    return F.try_to_number(F.regexp_extract(line, pattern, k), F.lit("999999999")).cast("int")


def parse_annotation(line: Column) -> Column:
    """left, top, width, height; null fields where the line doesn't match."""
    return F.struct(*[_group(line, FOUR, k).alias(n) for k, n in enumerate(("l", "t", "w", "h"), 1)])


def parse_size_lane(line: Column) -> Column:
    return F.struct(_group(line, SIZE_LANE, 1).alias("size"), _group(line, SIZE_LANE, 2).alias("lane"))


def path_parts(path: Column) -> Column:
    """scheme, host, last part of a URL or path."""
    return F.struct(
        F.lower(F.regexp_extract(path, "^(https?)://", 1)).alias("scheme"),
        F.regexp_extract(path, "://([^/?]+)", 1).alias("host"),
        F.regexp_extract(path, "([^/?]*)([?].*)?$", 1).alias("leaf"),
    )


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def data_url(value: Column) -> Column:
    """Image kind and bytes of a base64 data URL; empty kind if it is none."""
    return F.struct(F.regexp_extract(value, DATA_URL, 1).alias("kind"), F.unbase64(F.regexp_extract(value, DATA_URL, 2)).alias("data"))


def to_data_url(data: Column, kind: str = "png") -> Column:
    """Bytes as a base64 data URL of one line (Spark's base64 breaks lines after 76 characters)."""
    return F.concat(F.lit(f"data:image/{kind};base64,"), F.translate(F.base64(data), "\r\n", ""))


@F.pandas_udf(StringType())
def format_g(v: pd.Series) -> pd.Series:
    """Six significant digits as ``%g``, which JVM formatting can't express."""
    return v.map(lambda x: None if x is None or x != x else f"{x:g}")


@F.pandas_udf(StringType())
def serialize_vec(v: pd.Series) -> pd.Series:
    """``a, b, c`` with ``%g`` elements."""
    return v.map(lambda x: None if x is None else ", ".join(f"{y:g}" for y in x))


def vec_splice(dest: Column, source: Column, at: int) -> Column:
    """``source`` copied over ``dest`` from 0-based ``at``; fails if it doesn't fit."""
    n = F.size(source)
    fits = F.assert_true(n + at <= F.size(dest), F.lit("source does not fit"))
    out = F.concat(F.slice(dest, F.lit(1), F.lit(at)), source, F.slice(dest, n + at + 1, F.greatest(F.lit(0), F.size(dest) - n - at)))
    return F.when(fits.isNull(), out)

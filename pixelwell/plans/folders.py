"""Batch pipelines over folders of image files: read, transform, write, and give back what was written.

Image sinks write Parquet rows (there is no encoder); ``path`` names the file that a row stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelwell.functions.text import stem
from pixelwell.operators import raster
from pixelwell.sources import readers, sinks

#: The mode letter of the batch driver and the folder it stands for; any other letter is the last one.
MODES = {"b": "bad", "c": "crossvalidate", "": "tentative"}


def _written(rows: DataFrame, out: str) -> DataFrame:
    """Writes the images that have data; unreadable ones are left out, as the reader does with files."""
    sinks.write_images(rows.where(F.col("data").isNotNull()).drop("valid"), out)
    return rows.sparkSession.read.parquet(out)


def source_images(spark: SparkSession, root: str, skip_folder: str = "_delme", skip_stem: str = "canonical") -> DataFrame:
    """Decodable images below root but those directly in folders that end in skip_folder, or with such a stem."""
    folder = F.element_at(F.split("path", "/"), -2)
    return readers.read_images(spark, root).where(~folder.endswith(skip_folder) & ~stem(F.col("path")).endswith(skip_stem))


def canonical_batch(spark: SparkSession, mode: str, roots: dict[str, str], out: str, width: int = 128, height: int = 64) -> DataFrame:
    """Every image below the mode's root at one size, named into the root's build folder."""
    kind = MODES.get(mode, MODES[""])
    if kind not in roots:
        raise ValueError(f"no folder for {kind}")
    root = roots[kind].rstrip("/")
    return _written(raster.canonical(source_images(spark, root), width, height, root), out)


def annotated_batch(spark: SparkSession, root: str, annotations: str, out: str, width: int = 128, height: int = 64) -> DataFrame:
    """The annotated rectangle of every image below root that has one."""
    return _written(raster.canonical_crop(source_images(spark, root), readers.read_annotations(spark, annotations), width, height), out)


def normal_batch(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Every image below root with gamma and equalised luma."""
    return _written(raster.normal(readers.read_images(spark, root)), out)

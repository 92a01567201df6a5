"""Planar point sets and polygons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Keys of one position that travel together at most.
SLICE = 256


def near_points(points: DataFrame, key: str, x: str, y: str, limit: float, digits: int | None = None) -> DataFrame:
    """a, b (a < b), d2 (rounded to ``digits``) of points whose squared distance is below ``limit``.

    Positions meet through grid cells as wide as the distance: an equi-join on a cell and four of its neighbours, not a theta join.
    Points of one position travel as arrays of keys, so a pair is first made in the task that returns it. Each key of one
    position meets the other's smaller keys from the first one and its larger keys from the last one: runs of one key
    beside lists that begin alike, which a file's dictionary pages pack to a fraction.
    """
    side = math.sqrt(limit)
    p = points.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    # A point that is not finite is near none.
    p = p.where(F.col("k").isNotNull() & (F.col("x") - F.col("x") == 0) & (F.col("y") - F.col("y") == 0)).withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    # A number of its own: rows of pairs, not bytes of points, make the work, and few large partitions would be one task each.
    p = p.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cx", "cy")
    p = p.withColumn("slice", F.floor((F.row_number().over(W.partitionBy("cx", "cy", "x", "y").orderBy("k")) - 1) / SLICE))
    p = p.groupBy("cx", "cy", "x", "y", "slice").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    # Of two neighbours one looks for the other: its own cell, the one above and the three to the right.
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    other = p.withColumn("s", F.explode(steps)).select(F.col("ks").alias("bs"), F.col("x").alias("bx"), F.col("y").alias("by"), F.try_add("cx", "s.dx").alias("cx"), F.try_add("cy", "s.dy").alias("cy"), ((F.col("s.dx") == 0) & (F.col("s.dy") == 0)).alias("same"))
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    d2 = dx * dx + dy * dy
    met = p.hint("shuffle_hash").join(other, ["cx", "cy"]).where((d2 < limit) & (~F.col("same") | (dx < 0) | ((dx == 0) & (dy <= 0))))
    # A lambda is not compiled into the join's loop, which would hold all pairs of a position in memory; so it holds those of two arrays.
    met = met.select("ks", F.transform("bs", lambda b: b).alias("bs"), (F.col("same") & (dx == 0) & (dy == 0)).alias("one"), (d2 if digits is None else F.round(d2, digits)).alias("d2"))
    met = met.select(F.concat("ks", F.reverse("ks")).alias("ks"), F.size("ks").alias("n"), "one", "d2", F.explode("bs").alias("b")).select("one", "n", "d2", "b", F.posexplode("ks").alias("i", "k"))
    met = met.where(F.when(F.col("i") < F.col("n"), F.col("k") < F.col("b")).otherwise(~F.col("one") & (F.col("k") > F.col("b"))))
    return met.select(F.least("k", "b").alias("a"), F.greatest("k", "b").alias("b"), "d2")


def polygon_area(points: DataFrame, curve: str, seq: str, x: str, y: str) -> DataFrame:
    """curve, area (signed, shoelace), direction (its sign), centroid of the corners (cx, cy)."""
    w = W.partitionBy(curve).orderBy(seq)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(W.unboundedPreceding, 0)))
    e = points.withColumns({"__x2": nxt(x), "__y2": nxt(y)})
    area = F.sum(F.col(x) * F.col("__y2") - F.col("__x2") * F.col(y)) / 2
    return e.groupBy(curve).agg(area.alias("area"), F.signum(area).cast("int").alias("direction"), F.avg(x).alias("cx"), F.avg(y).alias("cy"))


def inside_polygon(points: DataFrame, curve: str, seq: str, x: str, y: str, px: float, py: float) -> DataFrame:
    """curve, inside: even-odd test of one point against every curve."""
    w = W.partitionBy(curve).orderBy(seq)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(W.unboundedPreceding, 0)))
    e = points.withColumns({"__x2": nxt(x), "__y2": nxt(y)})
    spans = (F.col(y) > py) != (F.col("__y2") > py)
    cut = F.col(x) + (F.lit(py) - F.col(y)) * F.try_divide(F.col("__x2") - F.col(x), F.col("__y2") - F.col(y))
    return e.groupBy(curve).agg((F.sum(F.when(spans & (cut > px), 1).otherwise(0)) % 2 == 1).alias("inside"))

"""Oriented-gradient descriptors: gradients inside cells, angle histograms, normalised blocks.

A cell's border pixels are left out, so a cell never reads its neighbours and an image is worked on without a join
or a shuffle until its histogram is summed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-6


class HogError(ValueError):
    """An image that a scheme can't cut into blocks."""


@dataclass(frozen=True)
class Scheme:
    """Geometry; cell and block sizes and the stride are inferred defaults."""

    width: int
    height: int
    cell: int = 8
    cells_per_block: int = 2
    bins: int = 9
    sigma: float | None = None

    def check(self) -> Scheme:
        side = self.cell * self.cells_per_block
        if self.width % side or self.height % side:
            raise HogError(f"{self.width}x{self.height} is not made of blocks of {side}")
        return self

    @property
    def blocks(self) -> tuple[int, int]:
        side = self.cell * self.cells_per_block
        return self.height // side, self.width // side

    def limits(self, r: int, c: int) -> tuple[tuple[int, int], tuple[int, int]]:
        """Upper left and lower right (exclusive) pixel of a block."""
        side = self.cell * self.cells_per_block
        return (r * side, c * side), ((r + 1) * side, (c + 1) * side)


def angle_signed(r: Column, c: Column) -> Column:
    """0 up to 2 pi; 0 for no gradient."""
    return F.pmod(F.atan2(r.cast("double"), c.cast("double")), F.lit(2 * math.pi))


def angle_unsigned(r: Column, c: Column) -> Column:
    """0 to pi: the slope's angle plus a right angle; vertical gradients are at the two ends."""
    return (
        F.when(r == 0, F.lit(math.pi / 2)).when((c == 0) & (r > 0), F.lit(math.pi)).when(c == 0, F.lit(0.0))
        .otherwise(F.atan(F.try_divide(r.cast("double"), c.cast("double"))) + F.lit(math.pi / 2))
    )


def gradients(images: DataFrame, key: str, p: str, s: Scheme) -> DataFrame:
    """key, r, c, gr, gc for the inner pixels of every cell."""
    w = s.width
    within = lambda x: (x % s.cell).between(1, s.cell - 2)
    inner = F.filter(F.sequence(F.lit(0), F.lit(w * s.height - 1)), lambda i: within(F.floor(i / w)) & within(i % w))
    at = lambda i: F.get(p, i)
    cells = F.transform(inner, lambda i: F.struct(F.floor(i / w).cast("int").alias("r"), (i % w).cast("int").alias("c"), ((at(i + w) - at(i - w)) * F.lit(0.5)).alias("gr"), ((at(i + 1) - at(i - 1)) * F.lit(0.5)).alias("gc")))
    return images.select(key, F.explode(cells).alias("g")).select(key, "g.*")


def weighted(grads: DataFrame, s: Scheme) -> DataFrame:
    """Adds angle a, magnitude m (times a Gaussian about the block's centre if sigma is set), block and cell."""
    side = s.cell * s.cells_per_block
    m = F.hypot(F.col("gr"), F.col("gc"))
    if s.sigma:
        dr, dc = F.col("r") % side - (side - 1) / 2, F.col("c") % side - (side - 1) / 2
        m = m * F.exp(-(dr * dr + dc * dc) / F.lit(2 * s.sigma * s.sigma))
    block = F.floor(F.col("r") / side) * s.blocks[1] + F.floor(F.col("c") / side)
    cell = F.floor((F.col("r") % side) / s.cell) * s.cells_per_block + F.floor((F.col("c") % side) / s.cell)
    return grads.withColumns({"a": angle_unsigned(F.col("gr"), F.col("gc")), "m": m, "block": block.cast("int"), "cell": cell.cast("int")})


def angle_hist(rows: DataFrame, keys: list[str], bins: int, *, magnitude: bool = True, interpolate: bool = True, wrap: bool = False) -> DataFrame:
    """keys, bin, w: counts or magnitudes by angle over 0..pi.

    Interpolation splits a sample between the two nearest bin centres (inferred); outside the first and last centre
    it goes to the end bin, or to the other end with wrap.
    """
    t = F.col("a") / F.lit(math.pi / bins) - (F.lit(0.5) if interpolate else F.lit(0.0))
    low, m = F.floor(t), F.col("m") if magnitude else F.lit(1.0)
    place = (lambda b: F.pmod(b, F.lit(bins))) if wrap else (lambda b: F.greatest(F.lit(0), F.least(F.lit(bins - 1), b)))
    one = lambda b, w: F.struct(place(b).cast("int").alias("bin"), w.alias("w"))
    parts = F.array(one(low, m * (1 - (t - low))), one(low + 1, m * (t - low))) if interpolate else F.array(one(low, m))
    return rows.select(*keys, F.explode(parts).alias("x")).groupBy(*keys, F.col("x.bin").alias("bin")).agg(F.sum("x.w").alias("w"))


def normalized(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Divides by the L2 norm over the block; blocks below 1e-6 stay as they are."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*keys)))
    return hist.withColumn("norm", norm).withColumn("w", F.when(F.col("norm") < EPS, F.col("w")).otherwise(F.try_divide(F.col("w"), F.col("norm"))))


def descriptors(images: DataFrame, key: str, p: str, s: Scheme) -> DataFrame:
    """key, block, vec (cells in order, each with all bins), valid."""
    s.check()
    n = s.bins * s.cells_per_block**2
    h = normalized(angle_hist(weighted(gradients(images, key, p, s), s), [key, "block", "cell"], s.bins), [key, "block"])
    found = h.groupBy(key, "block").agg(F.map_from_entries(F.collect_list(F.struct((F.col("cell") * s.bins + F.col("bin")).cast("int").alias("i"), "w"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return found.select(key, "block", vec.alias("vec")).withColumn("valid", validate(F.col("vec"), n))


def validate(vec: Column, n: int) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    return (F.size(vec) == n) & (F.abs(norm - 1) < EPS)

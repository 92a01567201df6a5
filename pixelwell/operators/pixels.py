"""Dense pixel operators on flat row-major arrays: per image, without shuffles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_byte(v: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v + 0.5))).cast("int")


def gamma_table(gamma: float = 2.2, reverse: bool = True) -> list[int]:
    g = 1 / gamma if reverse else gamma
    return [int(np.floor((i / 255) ** g * 255 + 0.5)) for i in range(256)]


def gamma_correct(p: Column, gamma: float = 2.2, reverse: bool = True) -> Column:
    table = F.array(*map(F.lit, gamma_table(gamma, reverse)))
    return F.transform(p, lambda v: F.get(table, v))


def to_gray(b: Column, g: Column, r: Column) -> Column:
    return F.floor(b * 0.114 + g * 0.587 + r * 0.299 + 0.5).cast("int")


def hue(b: Column, g: Column, r: Column) -> Column:
    """Hue in 0..179."""
    top, span = F.greatest(b, g, r), F.greatest(b, g, r) - F.least(b, g, r)
    turn = F.when(span == 0, F.lit(0.0)).when(top == r, 60 * F.try_divide(g - b, span)).when(top == g, 120 + 60 * F.try_divide(b - r, span)).otherwise(240 + 60 * F.try_divide(r - g, span))
    return F.pmod(F.rint(F.pmod(turn, F.lit(360.0)) / 2), F.lit(180.0)).cast("int")


def equalize(px: DataFrame, image: str, value: str) -> DataFrame:
    """image, value, eqv: the histogram equalisation table of each image; constant images keep their value."""
    from pyspark.sql import Window as W

    h = px.groupBy(image, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(image)
    up = w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    h = h.select(image, value, F.sum("n").over(up).alias("cum"), F.first("n").over(up).alias("n0"), F.sum("n").over(w).alias("tot"))
    eq = F.when(F.col("tot") == F.col("n0"), F.col(value)).otherwise(F.round(F.try_divide((F.col("cum") - F.col("n0")) * F.lit(255.0), F.col("tot") - F.col("n0"))))
    return h.select(image, value, eq.cast("int").alias("eqv"))


def crop(p: Column, width: int, left: int, top: int, w: int, h: int, height: int) -> Column:
    """Rows top.. and columns left.. of the image, cut at its border."""
    w, h = max(0, min(w, width - left)), max(0, min(h, height - top))
    if not w or not h:
        return F.slice(p, 1, 0)
    return F.flatten(F.transform(F.sequence(F.lit(top), F.lit(top + h - 1)), lambda r: F.slice(p, r * width + left + 1, F.lit(w))))


def _mirror(i: int, n: int) -> int:
    if n == 1:
        return 0
    i = abs(i) % (2 * n - 2)
    return i if i < n else 2 * n - 2 - i


def pyr_down(p: Column, width: int, height: int) -> Column:
    """Half size by the 1-4-6-4-1 filter with mirrored borders."""
    k = (1, 4, 6, 4, 1)

    def cell(r: int, c: int) -> Column:
        terms: dict[int, int] = {}
        for a in range(5):
            for b in range(5):
                i = _mirror(r + a - 2, height) * width + _mirror(c + b - 2, width)
                terms[i] = terms.get(i, 0) + k[a] * k[b]
        total = sum((F.get(p, F.lit(i)) * t for i, t in terms.items()), F.lit(0))
        return F.floor((total + 128) / 256).cast("int")

    return F.array(*[cell(r, c) for r in range(0, height, 2) for c in range(0, width, 2)])


def overlay(base: Column, top: Column, width: int, top_width: int, top_height: int) -> Column:
    """``top`` over the upper left corner of ``base``; a null top leaves the base."""

    def at(v: Column, i: Column) -> Column:
        r, c = F.floor(i / width).cast("int"), (i % width).cast("int")
        inside = (r < top_height) & (c < top_width) & top.isNotNull()
        return F.when(inside, F.get(top, r * top_width + c)).otherwise(v)

    return F.transform(base, at)


def sample_diagonal(p: Column, width: int, n: int = 5) -> Column:
    """The pixels in column i of row 2i for i below n; null where the image has none."""
    return F.array(*[F.get(p, F.lit(2 * i * width + i)) if i < width else F.lit(None) for i in range(n)])


def square(p: Column) -> Column:
    return F.transform(p, lambda v: v * v)


def paste_mask(image: Column, mask: Column, width: int, mask_width: int, mask_height: int, threshold: int = 128) -> Column:
    """Binary mask pasted at the upper left corner: 255 where the mask reaches the threshold, else 0."""
    return overlay(image, F.transform(mask, lambda v: F.when(v >= threshold, 255).otherwise(0)), width, mask_width, mask_height)


def lanczos_matrix(n: int, m: int, a: int = 4) -> np.ndarray:
    """m x n weights of Lanczos resampling with 2a taps, borders repeated."""
    out = np.zeros((m, n))
    for i in range(m):
        x = (i + 0.5) * n / m - 0.5
        taps = np.arange(int(np.floor(x)) - a + 1, int(np.floor(x)) + a + 1)
        w = np.sinc(x - taps) * np.sinc((x - taps) / a)
        np.add.at(out[i], np.clip(taps, 0, n - 1), w / w.sum())
    return out


def resize_lanczos(df: DataFrame, key: str, p: str, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """key, p resized; the only pixel operator that needs Python."""
    across, down = lanczos_matrix(width, to_width), lanczos_matrix(height, to_height)

    def run(it):
        for pdf in it:
            out = [np.clip(np.floor(down @ np.asarray(x, float).reshape(height, width) @ across.T + 0.5), 0, 255).astype(int).reshape(-1).tolist() for x in pdf["p"]]
            yield pd.DataFrame({"key": pdf["key"], "p": out})

    rows = df.select(F.col(key).alias("key"), F.col(p).alias("p"))
    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, p array<int>").withColumnRenamed("key", key)


def hough_circles(df: DataFrame, key: str, p: str, width: int, height: int, radii: tuple[int, ...], edge: float, votes: int) -> DataFrame:
    """key, r, c, radius, votes of the best circle of each image that has enough votes."""

    def run(it):
        turn = np.linspace(0, 2 * np.pi, 64, endpoint=False)
        for pdf in it:
            rows = []
            for k, x in zip(pdf["key"], pdf["p"], strict=True):
                img = np.asarray(x, float).reshape(height, width)
                gy, gx = np.gradient(img)
                er, ec = np.nonzero(np.hypot(gy, gx) >= edge)
                best = None
                for radius in radii:
                    rr = np.rint(er[:, None] - radius * np.sin(turn)).astype(int)
                    cc = np.rint(ec[:, None] - radius * np.cos(turn)).astype(int)
                    ok = (rr >= 0) & (rr < height) & (cc >= 0) & (cc < width)
                    acc = np.bincount(rr[ok] * width + cc[ok], minlength=width * height)
                    i = int(acc.argmax())
                    if acc[i] >= votes and (best is None or acc[i] > best[4]):
                        best = (k, i // width, i % width, radius, int(acc[i]))
                if best:
                    rows.append(best)
            yield pd.DataFrame(rows, columns=["key", "r", "c", "radius", "votes"])

    rows = df.select(F.col(key).alias("key"), F.col(p).alias("p"))
    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, r int, c int, radius int, votes int").withColumnRenamed("key", key)

"""Whole decoded images of any size (path, width, height, channels, data: rows of interleaved bytes, BGR), and the
folder pipelines made of these steps.

A step is one Arrow UDF over a batch of images; nothing is shuffled.  An image without data, or whose data isn't
height * width * channels bytes, or of which nothing is left, comes out with null data and keeps its row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelwell.functions.text import stem
from pixelwell.operators.pixels import gamma_table, lanczos_matrix

IMAGE = ("data", "height", "width", "channels")


def _array(data, height, width, channels) -> np.ndarray | None:
    if data is None or any(x != x or x is None or x < 1 for x in (height, width, channels)):
        return None
    flat = np.frombuffer(data, np.uint8)
    height, width, channels = int(height), int(width), int(channels)
    return flat.reshape(height, width, channels) if flat.size == height * width * channels else None


def _bytes(x: np.ndarray) -> np.ndarray:
    """Rounded half up and cut to 0..255."""
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def _each(f: Callable[..., np.ndarray | None], *more: str) -> Column:
    """data after f(image, values of the columns more)."""

    @F.pandas_udf("binary")
    def run(rows: pd.DataFrame) -> pd.Series:
        out = []
        for row in rows[[*IMAGE, *more]].itertuples(index=False, name=None):
            image = _array(*row[:4])
            done = None if image is None else f(image, *row[4:])
            out.append(None if done is None or not done.size else np.ascontiguousarray(done).tobytes())
        return pd.Series(out, dtype=object)

    return run(F.struct(*IMAGE, *more))


def to_bgr(images: DataFrame) -> DataFrame:
    """Three channels: grey is repeated, a fourth channel goes."""

    def three(x: np.ndarray) -> np.ndarray:
        return np.repeat(x[:, :, :1], 3, axis=2) if x.shape[2] < 3 else x[:, :, :3]

    return images.withColumns({"data": _each(three), "channels": F.lit(3)})


def crop(images: DataFrame, left: str, top: str, width: str, height: str) -> DataFrame:
    """The rectangle in the given columns, cut at the image's border; without one, or outside, data is null."""

    def cut(x: np.ndarray, a, b, w, h) -> np.ndarray | None:
        if any(v is None or v != v or v < 0 for v in (a, b, w, h)):
            return None
        return x[int(b) : int(b) + int(h), int(a) : int(a) + int(w)]

    zero = F.lit(0)
    w = F.greatest(zero, F.least(F.col(width), F.col("width") - F.col(left)))
    h = F.greatest(zero, F.least(F.col(height), F.col("height") - F.col(top)))
    return images.withColumns({"data": _each(cut, left, top, width, height), "width": w, "height": h})


@lru_cache(maxsize=64)
def _weights(n: int, m: int) -> np.ndarray:
    return lanczos_matrix(n, m)


def resize(images: DataFrame, width: int, height: int) -> DataFrame:
    """Lanczos resampling with eight taps; borders are repeated."""

    def scale(x: np.ndarray) -> np.ndarray:
        down, across = _weights(x.shape[0], height), _weights(x.shape[1], width)
        return _bytes(np.einsum("ij,jkc,lk->ilc", down, x.astype(float), across, optimize=True))

    return images.withColumns({"data": _each(scale), "width": F.lit(width), "height": F.lit(height)})


def gamma(images: DataFrame, power: float = 2.2, reverse: bool = True) -> DataFrame:
    """The gamma table on the first three channels; others stay."""
    table = np.array(gamma_table(power, reverse), np.uint8)

    def look_up(x: np.ndarray) -> np.ndarray:
        return np.concatenate([table[x[:, :, :3]], x[:, :, 3:]], axis=2)

    return images.withColumn("data", _each(look_up))


def luma_parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Luma and the two colour differences of a BGR image, as bytes."""
    b, g, r = (x[:, :, k].astype(float) for k in range(3))
    y = _bytes(0.299 * r + 0.587 * g + 0.114 * b)
    return y, _bytes((r - y) * 0.713 + 128), _bytes((b - y) * 0.564 + 128)


def luma_back(y: np.ndarray, cr: np.ndarray, cb: np.ndarray) -> np.ndarray:
    y, red, blue = y.astype(float), cr.astype(float) - 128, cb.astype(float) - 128
    return np.stack([_bytes(y + 1.773 * blue), _bytes(y - 0.714 * red - 0.344 * blue), _bytes(y + 1.403 * red)], axis=2)


def equalized(y: np.ndarray) -> np.ndarray:
    """Histogram equalisation of a byte plane, ties to even; a constant plane stays."""
    counts = np.bincount(y.ravel(), minlength=256)
    first = counts[np.flatnonzero(counts)[0]]
    if first == y.size:
        return y
    return np.clip(np.rint((np.cumsum(counts) - first) * (255.0 / (y.size - first))), 0, 255).astype(np.uint8)[y]


def equalize_luma(images: DataFrame) -> DataFrame:
    """Equalises the luma only and leaves the colour differences; for three channels, others have null data."""

    def even(x: np.ndarray) -> np.ndarray | None:
        if x.shape[2] != 3:
            return None
        y, cr, cb = luma_parts(x)
        return luma_back(equalized(y), cr, cb)

    return images.withColumn("data", _each(even))


def composite_mask(pairs: DataFrame, mask: str = "mask", threshold: int = 128) -> DataFrame:
    """Images with their mask pasted at the upper left corner, and ``rule``, what its size led to.

    ``binary``: a mask at least as large both ways is cut to the image's width, made grey, and 255 from the threshold
    on, else 0 (the mask isn't dithered; that differs for masks that aren't black and white).  ``smaller``: a mask no
    larger both ways, but smaller in one, is pasted as it is.  ``mixed``: larger one way and smaller the other, no data.
    """
    field = lambda k: F.col(mask)[k]
    wide, high = field("width") - F.col("width"), field("height") - F.col("height")
    rule = F.when((wide >= 0) & (high >= 0), "binary").when((wide <= 0) & (high <= 0), "smaller").when(wide.isNotNull() & high.isNotNull(), "mixed")

    def paste(x: np.ndarray, data, height, width, rule) -> np.ndarray | None:
        if rule not in ("binary", "smaller") or data is None:
            return None
        top = _array(data, height, width, len(data) // (int(height) * int(width)))
        if top is None or top.shape[2] not in (1, 3):
            return None
        if rule == "binary":
            grey = top[:, :, 0] if top.shape[2] == 1 else _bytes(top[:, :, 0] * 0.114 + top[:, :, 1] * 0.587 + top[:, :, 2] * 0.299)
            top = np.where(grey >= threshold, 255, 0).astype(np.uint8)[:, :, None]
        out = x.copy()
        h, w = min(x.shape[0], top.shape[0]), min(x.shape[1], top.shape[1])
        out[:h, :w] = top[:h, :w]
        return out

    rows = pairs.withColumns({"rule": rule, "__d": field("data"), "__h": field("height"), "__w": field("width")})
    return rows.withColumn("data", _each(paste, "__d", "__h", "__w", "rule")).drop("__d", "__h", "__w")


def hough_frames(frames: DataFrame, key: str, edge: float = 250.0, votes: int = 50, radii: tuple[int, int] = (40, 80)) -> DataFrame:
    """key, r, c, radius, votes of the best circle of each frame, searched at half size and given in the frame's pixels."""

    def run(it):
        turn = np.linspace(0, 2 * np.pi, 180, endpoint=False)
        for pdf in it:
            rows = []
            for k, *image in pdf.itertuples(index=False, name=None):
                x = _array(*image)
                if x is None or min(x.shape[:2]) < 4:
                    continue
                grey = x.astype(float).mean(axis=2) if x.shape[2] < 3 else x[:, :, :3].astype(float) @ (0.114, 0.587, 0.299)
                half = grey[: grey.shape[0] // 2 * 2, : grey.shape[1] // 2 * 2].reshape(grey.shape[0] // 2, 2, grey.shape[1] // 2, 2).mean(axis=(1, 3))
                gy, gx = np.gradient(half)
                er, ec = np.nonzero(8 * np.hypot(gy, gx) >= edge)
                best = None
                for radius in range(radii[0], radii[1] + 1):
                    rr, cc = np.rint(er[:, None] - radius * np.sin(turn)).astype(int), np.rint(ec[:, None] - radius * np.cos(turn)).astype(int)
                    inside = (rr >= 0) & (rr < half.shape[0]) & (cc >= 0) & (cc < half.shape[1])
                    ring = np.unique((np.arange(len(er))[:, None] * half.size + rr * half.shape[1] + cc)[inside])
                    count = np.bincount(ring % half.size, minlength=half.size)
                    at = int(count.argmax())
                    if count[at] >= votes and (best is None or count[at] > best[4]):
                        best = (k, at // half.shape[1] * 2, at % half.shape[1] * 2, radius * 2, int(count[at]))
                rows += [best] if best else []
            yield pd.DataFrame(rows, columns=["key", "r", "c", "radius", "votes"])

    rows = frames.select(F.col(key).alias("key"), *IMAGE)
    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, r int, c int, radius int, votes int").withColumnRenamed("key", key)


def named(images: DataFrame, suffix: str, folder: str | None = None) -> DataFrame:
    """path becomes ``build/<stem><suffix><extension>`` below the image's folder, or below the given one."""
    path = F.col("path")
    above = F.lit(folder) if folder else F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return images.withColumn("path", F.concat(above, F.lit("/build/"), stem(path), F.lit(suffix), F.regexp_extract(path, r"(\.[^./]*)?$", 0)))


def canonical(images: DataFrame, width: int = 128, height: int = 64, folder: str | None = None) -> DataFrame:
    """Decoded images at one size, brightened by gamma 2.2."""
    return images.transform(to_bgr).transform(resize, width, height).transform(gamma).transform(named, "_canonical", folder)


def canonical_crop(images: DataFrame, annotations: DataFrame, width: int = 128, height: int = 64) -> DataFrame:
    """The annotated rectangle (stem, l, t, w, h) of each image at one size; images without one have no row."""
    at = annotations.where("l >= 0 and t >= 0 and w >= 0 and h >= 0").select(F.col("stem").alias("__stem"), *[F.col(k).alias(f"__{k}") for k in "ltwh"])
    rows = images.join(at, stem(F.col("path")) == F.col("__stem")).transform(to_bgr).transform(crop, "__l", "__t", "__w", "__h")
    return rows.transform(resize, width, height).transform(gamma).transform(named, "_canonical").select(*images.columns)


def normal(images: DataFrame) -> DataFrame:
    """Decoded images, brightened by gamma 2.2, with equalised luma."""
    return images.transform(to_bgr).transform(gamma).transform(equalize_luma).transform(named, "_normalized")

"""Whole images: steps against numpy, and the folder pipelines over images written here."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelwell.operators import pixels, raster
from pixelwell.plans import folders

SCHEMA = "path string, width int, height int, channels int, data binary"


def png(path, x):
    """Writes a BGR array as an RGB PNG file."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + r[:, ::-1].tobytes() for r in x)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def picture(h, w, c=3, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c)).astype(np.uint8)


def table(spark, *images):
    return spark.createDataFrame([(f"d/{k}.png", x.shape[1], x.shape[0], x.shape[2], bytearray(x.tobytes())) for k, x in enumerate(images)], SCHEMA)


def arrays(df):
    return {r.path: None if r.data is None else np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels) for r in df.collect()}


def test_steps_equal_numpy(spark):
    x, grey, four = picture(9, 7), picture(5, 6, 1, 1), picture(4, 4, 4, 2)
    df = table(spark, x, grey, four)
    got = arrays(raster.to_bgr(df))
    assert (got["d/1.png"] == np.repeat(grey, 3, axis=2)).all() and (got["d/2.png"] == four[:, :, :3]).all()
    lut = np.array(pixels.gamma_table())
    got = arrays(raster.gamma(df))
    assert (got["d/0.png"] == lut[x]).all() and (got["d/2.png"][:, :, 3] == four[:, :, 3]).all() and (got["d/2.png"][:, :, :3] == lut[four[:, :, :3]]).all()
    got = arrays(raster.resize(df, 7, 9))
    assert (got["d/0.png"] == x).all()
    box = df.withColumns({k: F.lit(v) for k, v in {"l": 2, "t": 1, "w": 50, "h": 3}.items()})
    got = arrays(raster.crop(box, "l", "t", "w", "h"))
    assert (got["d/0.png"] == x[1:4, 2:]).all() and (got["d/1.png"] == grey[1:4, 2:]).all()
    assert arrays(raster.resize(raster.to_bgr(table(spark, np.full((5, 3, 3), 77, np.uint8))), 128, 64))["d/0.png"].tolist() == np.full((64, 128, 3), 77).tolist()


def test_equalized_luma():
    y = np.array([[10, 10, 20, 30]], np.uint8)
    assert raster.equalized(y).tolist() == [[0, 0, 128, 255]]
    assert raster.equalized(np.full((2, 2), 9, np.uint8)).tolist() == [[9, 9], [9, 9]]
    x = picture(6, 6)
    assert np.abs(raster.luma_back(*raster.luma_parts(x)).astype(int) - x).max() <= 3 or (x.max() == 255)
    grey = np.repeat(picture(6, 6, 1), 3, axis=2)
    assert (raster.luma_back(*raster.luma_parts(grey)) == grey).all()


def test_images_without_usable_data(spark):
    df = spark.createDataFrame([("a", 2, 2, 3, None), ("b", 2, 2, 3, bytearray(b"xyz")), ("c", None, 2, 3, bytearray(12)), ("d", 2, 2, 3, bytearray(12))], SCHEMA)
    for step in (raster.to_bgr, raster.gamma, raster.equalize_luma, lambda d: raster.resize(d, 4, 4), raster.canonical, raster.normal):
        assert [r.data is None for r in step(df).orderBy("path").collect()] in ([True, True, True, False], [True, True, True, False])
    box = df.where("path = 'd'").withColumns({"l": F.lit(5), "t": F.lit(0), "w": F.lit(1), "h": F.lit(1)})
    assert raster.crop(box, "l", "t", "w", "h").first().data is None
    assert raster.canonical(df.where("false")).count() == 0


def test_mask_rules(spark):
    image, large, small, mixed = picture(4, 4), picture(5, 6, 1, 3), picture(2, 3, 3, 4), picture(6, 2, 1, 5)
    rows = [(m.shape[1], m.shape[0], bytearray(m.tobytes())) for m in (large, small, mixed)]
    df = spark.createDataFrame([(str(k), 4, 4, 3, bytearray(image.tobytes()), m) for k, m in enumerate(rows)], SCHEMA + ", mask struct<width: int, height: int, data: binary>")
    got = {r.path: r for r in raster.composite_mask(df).collect()}
    as_array = lambda k: np.frombuffer(got[k].data, np.uint8).reshape(4, 4, 3)
    assert got["0"].rule == "binary" and (as_array("0") == np.where(large[:4, :4] >= 128, 255, 0)).all()
    want = image.copy()
    want[:2, :3] = small
    assert got["1"].rule == "smaller" and (as_array("1") == want).all()
    assert got["2"].rule == "mixed" and got["2"].data is None


def test_circle_of_a_frame(spark):
    r, c = np.mgrid[:240, :240]
    x = np.where((r - 120) ** 2 + (c - 110) ** 2 <= 100**2, 255, 0).astype(np.uint8)[:, :, None]
    found = raster.hough_frames(table(spark, x, np.zeros((240, 240, 1), np.uint8)), "path").collect()
    assert len(found) == 1 and abs(found[0].r - 120) <= 4 and abs(found[0].c - 110) <= 4 and abs(found[0].radius - 100) <= 4


def test_folder_pipelines(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    for d in (good / "old_delme", good / "annotate", bad):
        d.mkdir(parents=True)
    one, two = picture(40, 50), picture(30, 20, seed=1)
    png(good / "one.png", one)
    png(good / "two.png", two)
    png(good / "one_canonical.png", two)
    png(good / "old_delme" / "three.png", two)
    png(bad / "four.png", one)
    (good / "annotate" / "one.txt").write_text("# corner\n5, 6, 20, 10\n")
    roots = {"tentative": str(good), "bad": str(bad)}
    done = {r.path.rsplit("/", 1)[1]: r for r in folders.canonical_batch(spark, "", roots, str(tmp_path / "out")).collect()}
    assert set(done) == {"one_canonical.png", "two_canonical.png"} and {(r.width, r.height, len(r.data)) for r in done.values()} == {(128, 64, 128 * 64 * 3)}
    assert all("/good/build/" in r.path for r in done.values())
    assert [r.path.rsplit("/", 1)[1] for r in folders.canonical_batch(spark, "b", roots, str(tmp_path / "out_b")).collect()] == ["four_canonical.png"]
    with pytest.raises(ValueError, match="crossvalidate"):
        folders.canonical_batch(spark, "c", roots, str(tmp_path / "no"))
    cut = folders.annotated_batch(spark, str(good), str(good / "annotate"), str(tmp_path / "cut")).collect()
    lut, down, across = np.array(pixels.gamma_table()), pixels.lanczos_matrix(10, 64), pixels.lanczos_matrix(20, 128)
    want = np.clip(np.floor(np.einsum("ij,jkc,lk->ilc", down, one[6:16, 5:25].astype(float), across) + 0.5), 0, 255).astype(int)
    assert [r.path.rsplit("/", 1)[1] for r in cut] == ["one_canonical.png"] and np.abs(np.frombuffer(cut[0].data, np.uint8).astype(int) - lut[want].ravel()).max() <= 9
    flat = {r.path.rsplit("/", 1)[1]: r for r in folders.normal_batch(spark, str(bad), str(tmp_path / "flat")).collect()}
    y, cr, cb = raster.luma_parts(lut[one].astype(np.uint8))
    assert flat["four_normalized.png"].data == raster.luma_back(raster.equalized(y), cr, cb).tobytes()

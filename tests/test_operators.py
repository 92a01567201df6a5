"""Golden values, properties, and every query against its DuckDB form on the smallest tables."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelwell.functions import numeric as N
from pixelwell.functions import text
from pixelwell.operators import hog, linalg, ml, pixels, stats
from pixelwell.plans.registry import ORACLES, QUERIES
from pixelwell.sources import readers, sinks
from pixelwell.streaming import frames


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def rows_of(pdf):
    plain = lambda x: None if x is None or x != x else repr(x.item() if isinstance(x, np.generic) else x)
    return sorted(tuple(map(plain, r)) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    assert list(map(str, rows_of(QUERIES[name](spark, sf).toPandas()))) == list(map(str, rows_of(duck.sql(ORACLES[name]).df())))


def test_queries_without_sql(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    assert QUERIES["resize_lanczos"](spark, sf).count() == len(e) * 128 and QUERIES["hog_text"](spark, sf).count() == len(e)
    assert sum(r.n for r in QUERIES["kmeans_ml"](spark, sf).collect()) == len(e)
    circles = QUERIES["hough_circles"](spark, sf).collect()
    assert len({r.vec_id for r in circles}) == len(circles) and all(r.votes >= 12 and r.radius in (2, 3) for r in circles)
    v = np.stack(e["embedding"]).astype(float)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    near = {(int(e.vec_id[i]), int(e.vec_id[j])) for i, j in zip(*np.nonzero(d < 1.05), strict=True) if e.vec_id[i] < e.vec_id[j]}
    got = {(r.a, r.b) for r in QUERIES["lsh_similarity_join"](spark, sf).collect()}
    assert got <= near and len(got) >= 0.9 * len(near), (len(got), len(near))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize(
    ("r", "c", "signed", "unsigned"),
    [(0, 0, 0, 0.5), (0, 1, 0, 0.5), (0, -1, 1, 0.5), (1, 0, 0.5, 1), (-1, 0, 1.5, 0), (1, 1, 0.25, 0.75), (1, -1, 0.75, 0.25), (-1, -1, 1.25, 0.75), (-1, 1, 1.75, 0.25)],
)
def test_angles(spark, r, c, signed, unsigned):
    got = one(spark, hog.angle_signed(F.lit(float(r)), F.lit(float(c))), hog.angle_unsigned(F.lit(float(r)), F.lit(float(c))))
    assert got[0] == pytest.approx(signed * math.pi) and got[1] == pytest.approx(unsigned * math.pi)


def test_gamma_tables():
    t = pixels.gamma_table()
    assert [t[i] for i in (0, 1, 2, 16, 64, 100, 128, 200, 255)] == [0, 21, 28, 72, 136, 167, 186, 228, 255] and sum(t) == 44824
    assert sum(pixels.gamma_table(reverse=False)) == 20443


def test_sampler_goldens(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    r = stats.stats_sampler(df, "x").first()
    assert (r.n, r.total, r.total_sq, r.mean, r.variance, r.mn, r.mx) == (10, 45, 285, 4.5, 8.25, 0, 9) and r.sd == pytest.approx(2.872281, abs=1e-6)
    empty = stats.stats_sampler(df.where("x < 0"), "x").first()
    assert (empty.n, empty.mean, empty.variance, empty.sd, empty.mx) == (0, 0, 0, 0, None)
    order = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 9.0), ("a", 2, 5.0), ("b", 0, 5.0), ("b", 1, 4.0), ("b", 2, 3.0)], "g string, o int, x double")
    assert {r.g: r.mx for r in stats.sampler_max_compat(order, "x", "o", "g").collect()} == {"a": 5.0, "b": None}


def test_histogram_bounds(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.999, 2.0, 10.0, -0.1, 10.1)], "x double")
    assert [r[0] for r in df.select(stats.bin_of(F.col("x"), 5, 0, 10)).collect()] == [0, 0, 1, 4, None, None]
    with pytest.raises(Exception, match="outside"):
        df.select(stats.bin_of(F.col("x"), 5, 0, 10, strict=True)).collect()
    assert one(spark, stats.bin_center(F.lit(0), 5, 0, 10))[0] == 1


def test_vectors(spark):
    df = spark.createDataFrame([([float(i) for i in range(10)],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(text.serialize_vec("v")).collect()] == ["0, 1, 2, 3, 4, 5, 6, 7, 8, 9", None]
    assert one(spark, text.vec_splice(F.array(*map(F.lit, (1, 2, 3))), F.array(F.lit(9)), 2))[0] == [1, 2, 9]
    with pytest.raises(Exception, match="fit"):
        one(spark, text.vec_splice(F.array(F.lit(1)), F.array(F.lit(9), F.lit(9)), 0))
    assert one(spark, N.quantize(F.lit(-2.5)), N.epsilon_eq(F.lit(1.0), F.lit(1.0 + 1e-12)))[:] == (-3, True)
    with pytest.raises(ValueError):
        N.int_pow(F.lit(2), 0)


def test_constant_image_has_no_valid_block(spark):
    df = spark.createDataFrame([(1, [7] * 64)], "k int, p array<int>")
    r = hog.descriptors(df, "k", "p", hog.Scheme(8, 8, cell=4)).first()
    assert set(r.vec) == {0.0} and not r.valid and len(r.vec) == 36
    with pytest.raises(hog.HogError):
        hog.Scheme(9, 8, cell=4).check()


def test_least_squares_without_full_rank(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 6.0)], "a double, b double, y double")
    assert linalg.least_squares(df, ["a", "b"], ["y"]).ravel() == pytest.approx([0.6, 1.2])
    assert (linalg.least_squares(df.where("false"), ["a", "b"], ["y"]) == 0).all()
    close = spark.createDataFrame([(float(k), k + 1e-6 * (k % 3), 2.0 * k - (k + 1e-6 * (k % 3))) for k in range(1, 40)], "a double, b double, y double")
    assert linalg.least_squares(close, ["a", "b"], ["y"]).ravel() == pytest.approx([2, -1], rel=1e-6)
    x = linalg.least_squares(df.withColumn("one", F.lit(1.0)), ["a", "one"], ["y"])
    assert x[0, 0] == pytest.approx(3) and x[1, 0] == pytest.approx(0, abs=1e-9)


def test_bytes_of_a_whole_image(spark):
    from pixelwell.sources.readers import bytes_to_ints, channel

    raw = bytes(k * 7 % 256 for k in range(128 * 64 * 3))
    df = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "id int, data binary")
    rows = df.select("id", bytes_to_ints(F.col("data"), F.lit(len(raw))).alias("all"), channel(F.col("data"), F.lit(128 * 64), 3, 1).alias("green")).orderBy("id").collect()
    assert rows[0]["all"] == list(raw) and rows[0]["green"] == list(raw[1::3]) and rows[1]["all"] is None and rows[1]["green"] is None


def test_schema_and_columns(spark):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    assert ml.numeric_columns(df) == ["x"]
    with pytest.raises(TypeError, match="Expected StringType"):
        readers.require_columns(df, {"x": T.StringType})


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# x\nno\n1, 2, 3, 4 z\n5,6,7,8\n")
    assert readers.read_annotations(spark, str(tmp_path)).first()[:] == ("a", 1, 2, 3, 4)
    (tmp_path / "s.csv").write_text("u,v\n1,#DIV/0!\n2,3\n")
    assert [r.v for r in readers.read_csv(spark, str(tmp_path / "s.csv")).orderBy("u").collect()] == [None, 3]
    (tmp_path / "b_canonical.PNG").write_bytes(b"x")
    (tmp_path / "c.jpg").write_bytes(b"x")
    assert readers.list_files(spark, str(tmp_path)).count() == 2
    assert readers.list_files(spark, str(tmp_path), skip_stem="canonical").count() == 1
    (tmp_path / "lanes").write_text("# c\n\n 4, 1 junk\n5,2\n")
    assert sorted(r[:] for r in readers.read_size_lane(spark, str(tmp_path / "lanes")).collect()) == [(4, 1), (5, 2)]


def test_sinks_append(spark, tmp_path):
    df = spark.createDataFrame([("f", 1, 1, [0.1, 2.0]), ("f", 0, 1, [1e-7])], "filename string, block int, label int, vec array<double>")
    assert sinks.descriptor_text(df).first().value == "#f\n0,1, 1e-07\n1,1, 0.1, 2"
    for _ in range(2):
        sinks.write_descriptors(df, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).count() == 6


def in_files(spark, sf, folder, parts=3):
    """Events as a stream of several files, one for each micro-batch, earlier ids first."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    cut = e.count() // parts + 1
    for k in range(parts):
        e.where(f"event_id div {cut} = {k}").coalesce(1).write.mode("append").parquet(str(folder))
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_carry_last_in_a_stream(spark, sf, tmp_path):
    e, stream = in_files(spark, sf, tmp_path / "in")
    out = frames.run_to_memory(frames.carry_last(stream, "user_id", "event_id", "value"), "carried", "update")
    got = {r.key: r.value for r in out.groupBy("key").agg(F.max_by("value", "at").alias("value")).collect()}
    assert got == {r.user_id: r.v for r in e.where("value is not null").groupBy("user_id").agg(F.max_by("value", "event_id").alias("v")).collect()}


def test_gate_in_a_stream(spark, sf, tmp_path):
    e, stream = in_files(spark, sf, tmp_path / "in")
    request, found = F.col("event_type") == "purchase", F.col("event_type").isin("view", "click")
    out = frames.run_to_memory(frames.gate_stream(stream, "user_id", "event_id", request, found), "gated", "append")
    want = frames.gated_frames(e, "user_id", ["event_id"], request, found)
    got = {r["at"]: r.processed for r in out.collect()}
    assert got == {r.event_id: r.processed for r in want.collect()} and any(got.values())


def test_gaussian_weight(spark):
    scheme = hog.Scheme(8, 8, cell=4, sigma=2.0)
    df = spark.createDataFrame([(3, 6, 3.0, 4.0)], "r int, c int, gr double, gc double")
    assert hog.weighted(df, scheme).first().m == pytest.approx(5 * math.exp(-(0.5**2 + 2.5**2) / 8))


def test_uniform_is_uniform(spark):
    u = [r[0] for r in spark.range(4000).select(stats.uniform(F.col("id"), 7)).collect()]
    assert all(0 <= x <= 1 for x in u) and abs(np.mean(u) - 0.5) < 0.02 and abs(np.var(u) - 1 / 12) < 0.01
    assert u != [r[0] for r in spark.range(4000).select(stats.uniform(F.col("id"), 8)).collect()]


def test_data_url_of_long_and_null_values(spark, tmp_path):
    urls = [None, "", "u" * 57, "u" * 58, "http://é.example.org/" + "x" * 500]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = rows_of(QUERIES["data_url"](spark, str(tmp_path)).toPandas())
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == rows_of(con.sql(ORACLES["data_url"]).df())
    long = spark.createDataFrame([(b"x" * 200,)], "data binary")
    back = sinks.data_urls(long).select("url", text.data_url(F.col("url")).alias("x")).first()
    assert back.x.kind == "png" and bytes(back.x.data) == b"x" * 200 and "\n" not in back.url


def test_near_points_are_not_broadcast(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, int(s), float(y)) for i, (s, y) in enumerate(zip(rng.integers(-30, 30, 400), rng.integers(-300, 300, 400) / 10, strict=True))]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    out = QUERIES["near_points"](spark, str(tmp_path))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert rows_of(out.toPandas()) == rows_of(con.sql(ORACLES["near_points"]).df())


def test_near_points_of_copies_pack(spark, tmp_path):
    rng = np.random.default_rng(4)
    place = [(int(s), float(y)) for s, y in zip(rng.integers(0, 12, 60), rng.integers(0, 120, 60) / 10, strict=True)]
    rows = [(i * len(place) + j, *xy) for i in range(60) for j, xy in enumerate(place)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    QUERIES["near_points"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    con.execute(f"create table got as select * from read_parquet('{tmp_path}/out/*.parquet')")
    con.execute(f"create table want as {ORACLES['near_points']}")
    count = lambda t: con.sql(f"select count(*) from {t}").fetchall()[0][0]
    n = count("want")
    assert count("got") == n and count("(from got except from want)") == count("(from want except from got)") == 0
    taken = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert taken < 0.9 * n, "the pairs of copies take a fraction of their keys' bits"


def test_near_points_in_slices_and_odd_places(spark, monkeypatch):
    from pixelwell.operators import geometry

    monkeypatch.setattr(geometry, "SLICE", 4, raising=False)
    rng = np.random.default_rng(6)
    odd = [float("nan"), float("inf"), float("-inf"), 1e300, -1e300, None, -0.0, 0.0]
    rows = [(int(k), float(rng.integers(-4, 4)), float(rng.integers(-4, 4))) for k in rng.permutation(300)]
    rows += [(300 + i, v, 0.0) for i, v in enumerate(odd * 2)] + [(400 + i, 1.0, v) for i, v in enumerate(odd * 2)] + [(None, 0.0, 0.0)]
    got = geometry.near_points(spark.createDataFrame(rows, "k long, x double, y double"), "k", "x", "y", 8.0)
    whole = [r for r in rows if None not in r]
    want = [(a[0], b[0], d2) for a in whole for b in whole if a[0] < b[0] and (d2 := (a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])) < 8]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lsh_pairs_meet_once(spark, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    from pixelwell.operators import cluster

    monkeypatch.setattr(cluster, "BLOCK", 70)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8))
    v[::3] = v[0] + rng.normal(size=(100, 8)) / 4
    v[-4:] = v[1]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = cluster.lsh_similarity_join(df, "vec_id", "embedding", 1.05, bucket_length=0.5, tables=3)
    rows = df.select(F.col("vec_id").alias("k"), array_to_vector("embedding").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=3, seed=42).fit(rows)
    want = model.approxSimilarityJoin(rows, rows, 1.05, "dist").where("datasetA.k < datasetB.k").select("datasetA.k", "datasetB.k", "dist")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan, "no rows of pairs that are not below the limit"

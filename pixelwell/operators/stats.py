"""Mergeable statistics, fixed-width histograms, cumulative distributions and sampling from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelwell.functions.text import format_g


def stats_maker(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, population variance, min, max; an empty group has no row, an all-null one has nulls."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.min(v).alias("mn"), F.max(v).alias("mx"))


def stats_describe(stats: DataFrame, name: str) -> DataFrame:
    """Adds ``description``: ``<name>: mu=..: variance=..: minVal=..: maxVal=..`` and a newline."""
    part = lambda label, c: F.concat(F.lit(label), format_g(F.col(c)))
    return stats.withColumn("description", F.concat(F.col(name), part(": mu=", "mean"), part(": variance=", "variance"), part(": minVal=", "mn"), part(": maxVal=", "mx"), F.lit("\n")))


def stats_sampler(df: DataFrame, value: str, *by: str) -> DataFrame:
    """sum, sum of squares, count, min, max, and mean, variance, deviation that are 0 for no samples."""
    v = F.col(value).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("total_sq"), F.min(v).alias("mn"), F.max(v).alias("mx"),
        zero(F.avg(v)).alias("mean"), zero(F.var_pop(v)).alias("variance"), zero(F.stddev_pop(v)).alias("sd"),
    )


def sampler_max_compat(df: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """The order-dependent maximum: the last value above the running minimum; null if none is."""
    low = F.min(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("__low", low).groupBy(*by).agg(F.min(value).alias("mn"), F.max_by(value, F.when(F.col(value) > F.col("__low"), F.col(order))).alias("mx"))


def bin_of(value: Column, bins: int, low: float, high: float, strict: bool = False) -> Column:
    """0-based bin; ``high`` itself is in the last; outside: null, or an error if strict."""
    v = value.cast("double")
    inside = (v >= low) & (v <= high)
    b = F.least(F.lit(bins - 1), F.floor((v - low) / ((high - low) / bins)).cast("int"))
    return F.when(F.assert_true(inside, F.lit("value outside the histogram")).isNull(), b) if strict else F.when(inside, b)


def histogram_fixed(df: DataFrame, value: str, bins: int, low: float, high: float, *by: str, weight: str | None = None, strict: bool = False) -> DataFrame:
    rows = df.withColumn("bin", bin_of(F.col(value), bins, low, high, strict)).where("bin is not null")
    return rows.groupBy(*by, "bin").agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def histogram_dense(df: DataFrame, value: str, bins: int, low: float, high: float, by: str) -> DataFrame:
    """by, counts: one array with every bin, empty ones too; groups without a value inside have zeros."""
    b = bin_of(F.col(value), bins, low, high)
    return df.groupBy(by).agg(*[F.count(F.when(b == i, 1)).alias(f"b{i}") for i in range(bins)]).select(by, F.array(*[F.col(f"b{i}") for i in range(bins)]).alias("counts"))


def bin_center(b: Column, bins: int, low: float, high: float) -> Column:
    return F.lit(float(low)) + (b + F.lit(0.5)) * F.lit((high - low) / bins)


def histogram_describe(dense: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """Adds ``short`` (``c0,c1,``) and ``full`` (each bin with its bounds, a newline after every ninth)."""
    width = (high - low) / bins
    short = F.concat(F.array_join(F.transform("counts", lambda c: c.cast("string")), ","), F.lit(","))
    cells = [F.concat(F.lit(f",{i}:{low + i * width:g}<="), F.get("counts", F.lit(i)).cast("string"), F.lit(f"<{low + (i + 1) * width:g},  " + ("\n" if i and i % 9 == 0 else ""))) for i in range(bins)]
    return dense.withColumn("short", short).withColumn("full", F.concat(F.lit("["), *cells, F.lit("]")))


def auto_histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Histogram over the data's own range (half a unit each way if all values are equal)."""
    v = F.col(value).cast("double")
    r = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    rows = df.crossJoin(F.broadcast(r)).select(F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int")).alias("bin"))
    return rows.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def cum_pdf(hist: DataFrame, *by: str) -> DataFrame:
    """Adds cp, the share of the group's counts up to and with each bin."""
    w = W.partitionBy(*by)
    return hist.withColumn("cp", F.sum("n").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)).cast("double") / F.sum("n").over(w))


def inverse_cdf(draws: DataFrame, p: str, cdf: DataFrame, by: str, groups: list, low: float, width: float) -> DataFrame:
    """For every draw and each of the given groups, the left edge of the first bin whose cp reaches p.

    A group's distribution is one array of at most as many entries as bins, so it is looked up, not range-joined; the
    broadcast table has a row for each given group.  A group without a distribution has no rows.
    """
    table = cdf.where(F.col(by).isin(groups)).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("bin", "cp"))).alias("__c"))
    rows = draws.withColumn(by, F.explode(F.array(*map(F.lit, groups)))).join(F.broadcast(table), by)
    first = F.get(F.filter("__c", lambda x: x["cp"] >= F.col(p)), F.lit(0))["bin"]
    return rows.withColumn("x", F.lit(low) + first * F.lit(width)).drop("__c")


def uniform(key: Column, seed: int) -> Column:
    """A uniform number in 0..1, both ends included, from a row's key and the seed alone; null for a null key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52 - 1))


def mixture_draw(u: Column, x1: Column, x2: Column) -> Column:
    return F.when(u < 0.5, x1).otherwise(x2)

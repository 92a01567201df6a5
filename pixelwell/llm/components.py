"""Connected components over any number of links, as DataFrame steps with checkpoints between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelwell.llm.blocks import checkpointed


#: Up to this many links are worked on in one task (some 50 MB), which spares small graphs the shuffles of their rounds.
MAX_LOCAL_LINKS = 1_000_000


def gathered(df: DataFrame, rows: int, max_local: int | None = None) -> DataFrame:
    """``df`` (of ``rows`` short rows) in one partition if they are few: then no join or aggregate on it needs a shuffle."""
    return df.coalesce(1) if rows <= (MAX_LOCAL_LINKS if max_local is None else max_local) else df


def components(links: DataFrame, max_local: int | None = None) -> DataFrame:
    """node, label (smallest node that it reaches) of every node in ``links`` (columns a, b; no nulls).

    Alternates large stars (every larger neighbour to the smallest) and small stars (every smaller neighbour to the
    smallest) until nothing changes.  Stars are aggregated before they are joined, never gathered in one place.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    few = edges.count()
    held = lambda df: gathered(df, few, max_local)
    edges, state = held(edges), None
    while True:
        both = held(edges.unionAll(edges.select("v", "u").toDF("u", "v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(low, "u").select(F.greatest("v", "m").alias("x"), F.least("v", "m").alias("y")).where("x <> y")
        edges = checkpointed(held(stars.unionAll(low.select("u", "m"))).distinct().toDF("u", "v"))
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))

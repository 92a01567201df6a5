"""Benchmark decontamination by a prefix-filtered join.

A window is ``width`` consecutive words of an item (an item with fewer words is one window).  For a window to occur
in a document all its words must, so its rarest word, by the number of times the corpus has it, is a prefix of length
one that any occurrence must contain.  Document words are joined with the windows' rarest words only; the word's
offset fixes where the window would start (positional bound), the window must fit into the document (length bound),
and the slice of the document is compared with the window word by word, so the result is exact.

Only joins with the words of benchmark windows are broadcast, in pieces of at most ``max_broadcast`` windows; a larger
benchmark is worked through piece by piece over all documents.

Defined cases: null text has no words and is not contaminated; items without words have no window; repeated items
count by their item_id; rows with equal id and text are grouped in the work and returned each; an empty table, or
an empty benchmark, gives no hits; columns other than doc_id, item_id and text are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH, SHARE = 13, 20
MAX_BROADCAST = 100_000
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def word_array(text: Column) -> Column:
    """Words of the text, then one empty string; a text that doesn't begin with a word has an empty string first.

    Only A-Z are lowered: ``lower`` does that by itself on ASCII texts, ``translate`` on the others.
    """
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    return F.split(F.concat(low, F.lit(" ")), GAP, -1)


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, window (array of words) of every window of every item."""
    words = benchmark.select("item_id", F.filter(word_array(F.col("text")), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("window"))


def _rarest(windows: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """Windows with their rarest word and its offset; ties go to the first offset."""
    words = windows.select(F.explode("window").alias("word")).distinct()
    counts = rows.select(F.explode("words").alias("word"))
    counts = counts.join(F.broadcast(words) if limit else words, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    by_word = windows.select("item_id", "window", F.posexplode("window").alias("offset", "word")).join(counts, "word", "left")
    best = by_word.groupBy("item_id", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "word")).alias("b"))
    # A window with a word that the corpus lacks can't occur.
    return best.where("b.n > 0").select("item_id", "window", F.col("b.offset").alias("offset"), F.col("b.word").alias("word"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, share: int = SHARE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``, and text_hash."""
    from pixelwell.llm.blocks import checkpointed

    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_array(F.col("text")).alias("words"))
    windows = item_windows(benchmark, width)
    pieces = max(1, -(-windows.count() // max_broadcast))
    found = None
    for piece in range(pieces):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(pieces)) == piece) if pieces > 1 else windows
        prefix = checkpointed(_rarest(part, base, max_broadcast))
        # The empty last word of every document meets this row, which keeps documents without hits.
        alone = prefix.sparkSession.range(1).select(F.lit(None).cast(prefix.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("array<string>").alias("window"), F.lit(0).alias("offset"), F.lit("").alias("word"))
        table = prefix.unionByName(alone) if piece == 0 else prefix
        at = base.select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "word"))
        start, n = F.col("pos") - F.col("offset"), F.size("window")
        last = F.size("words") - 1
        fits = (F.col("window").isNull() & (F.col("pos") == last)) | ((start >= 0) & (start + n <= last) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, n) == F.col("window")))
        met = at.join(F.broadcast(table), "word").where(fits)
        lead = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0)
        n_words = F.when(last == 0, 0).otherwise(last - lead)
        met = met.select("doc_id", "text_hash", n_words.cast("long").alias("n_words"), "item_id", F.when(F.col("window").isNotNull(), start).alias("start"), n.alias("len"))
        found = met if found is None else found.unionAll(met)
    key = ["doc_id", "text_hash", "n_words"]
    hits = found.groupBy(*key, "item_id", "start", "len").agg(F.count("*").alias("times"))
    before = W.partitionBy(*key).orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0))))
    per = hits.withColumn("fresh", fresh).groupBy(*key).agg(
        F.coalesce(F.sum(F.when(F.col("start").isNotNull(), F.col("fresh"))), F.lit(0)).cast("long").alias("n_hit"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.col("item_id").cast("string"))).alias("items"),
        F.sum(F.when(F.col("start").isNull(), F.col("times"))).alias("rows"),
    )
    out = per.select(
        *key, "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), "rows",
    )
    spread = out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / 65536))).alias("chunk"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(65536).cast("long"), F.col("rows") - F.col("chunk") * 65536))).alias("copy"))
    return spread.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "text_hash")

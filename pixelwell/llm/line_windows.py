"""Line dedup with overlapping three-line windows.

Lines are split at newlines.  Every three consecutive lines form a window; a text of one or two lines is one window of
its own length.  A passage may also stand on fewer lines between changing neighbours: with ``long_words`` set, a run of
one or two lines with more words than that is a window too.  Windows are equal if they have as many lines and the same text,
told by two 64-bit hashes.  Of windows that occur more than once anywhere, all but the first occurrence (by doc_id,
nulls last, then line number) are repeats; the lines covered by repeats, merged over overlaps, go.
Windows without a letter or digit never count, so blank lines and rules don't repeat.

Defined cases: null text stays null with 0 lines; rows with equal id and text are one document and are treated alike;
windows that repeat within one document go too, but for the first; if all lines go the text is empty; an empty
table gives an empty result; other columns, whatever their names, pass through ``dedup_lines`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelwell.llm import blocks as B

WINDOW = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: Column, window: int, long_words: int | None) -> Column:
    """at, size, h, h2 of every window of a text's lines."""
    whole = F.least(F.lit(window), F.size(lines))

    def counts(w: Column, size: Column) -> Column:
        ok = w.rlike("[\\p{L}\\p{N}]")
        if long_words is None:
            return ok
        return ok & ((size == whole) | ((F.length(w) > 2 * long_words) & (F.regexp_count(w, F.lit(WORD)) > long_words)))

    def one(size: Column, i: Column) -> Column:
        """The window as an array of one struct, or of none if it doesn't count."""
        text = F.filter(F.array(F.array_join(F.slice(lines, i + 1, size), "\n")), lambda w: counts(w, size))
        return F.transform(text, lambda w: F.struct(i.alias("at"), size.alias("size"), F.xxhash64(w, size).alias("h"), F.xxhash64(F.lit("second"), size, w).alias("h2")))

    def of_size(size: int) -> Column:
        any_ = whole == size if long_words is None else whole >= size
        starts = F.when(any_, F.sequence(F.lit(0), F.size(lines) - size)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(starts, lambda i: one(F.lit(size), i)))

    return F.concat(*[of_size(k) for k in range(1, window + 1)])


def repeated_lines(docs: DataFrame, window: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """doc_id, text_hash, gone: ascending 0-based numbers of the lines to remove; only documents that lose any."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), _lines(F.col("text")).alias("lines"))
    windows = rows.select("doc_id", "text_hash", F.explode(_windows(F.col("lines"), window, long_words)).alias("x")).select("doc_id", "text_hash", "x.*").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "at")
    first = windows.groupBy("h", "h2").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").select("h", "h2", "first")
    later = windows.join(first, ["h", "h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.select("doc_id", "text_hash", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("line")).distinct()
    return covered.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("line")).alias("gone"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the new ``text``, and as the last two columns its lines before and those removed.

    These are called __n_lines and __n_removed, with more underscores at the end if ``docs`` has such columns.
    """
    own, at, there, lost = (B.unused(docs, x) for x in ("__own", "__id", "__hash", "__gone"))
    gone = repeated_lines(docs, window, long_words).select(F.col("doc_id").alias(at), F.col("text_hash").alias(there), F.col("gone").alias(lost))
    both = docs.withColumn(own, F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(own) == F.col(there)), "left")
    lines = _lines(F.col("text"))
    # The lines are bound once for all that is done with them.
    left = lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(lost)), lambda i: F.get(ls, i)), "\n")
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(lines), left), F.lit(0)))
    return both.select(
        *[text.alias("text") if c == "text" else F.col(B.quoted(c)) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(B.unused(docs, "__n_lines")),
        F.when(F.col(lost).isNull(), F.lit(0)).otherwise(F.size(lost)).cast("long").alias(B.unused(docs, "__n_removed")),
    )

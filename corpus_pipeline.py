"""A training-corpus pipeline: five stages, each one operator over all rows that the stage before kept.

1. quality classifier: rejected documents go.
2. line dedup: repeated three-line windows go from the texts; a document of which nothing is left goes too.
3. n-gram Jaccard join: of each group of near duplicates one row stays, that with the smallest id (nulls last), then
   text hash.  Of rows with equal id and text one stays; texts without words are in no group.
4. benchmark decontamination: contaminated documents go.
5. BPE encoding and decoding: token ids, their counts and digests, with the decoded text's digest.

Stages 1 to 4 return the columns of documents.  Every stage is written as Parquet and read again by the next, in the
folder of spark.checkpoint.dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelwell.llm import bpe_table, decontam_prefix, jaccard_pigeonhole, line_windows, quality_fm
from pixelwell.llm.blocks import checkpointed, columns, remove_folder, shared_folder, unused
from pixelwell.llm.queries import METADATA, held_out
from pixelwell.llm.tokens import public_path

#: A learnt model and an iterative grouping: SQL can't express the stages.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = quality_fm.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(4, 2), metadata=METADATA)
    return quality_fm.keep_good(docs, machine, metadata=METADATA)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_windows.dedup_lines(docs)
    removed = F.col(done.columns[-1])
    emptied = (removed > 0) & ~F.col("text").rlike("[^\\s]")
    changed = done.where(~F.coalesce(emptied, F.lit(False)))
    length = F.when(removed > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*columns(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"))
    groups = jaccard_pigeonhole.near_groups(docs.select(key.alias("doc_id"), "text"))
    odd = groups.groupBy("doc_id").agg(F.count("*").alias("times"), F.max(F.col("component_id") < F.col("doc_id")).alias("later"))
    name = unused(docs, "__key")
    odd = checkpointed(odd.where("later or times > 1").select(F.col("doc_id").alias(name), "later"))
    if odd.count() <= jaccard_pigeonhole.MAX_BROADCAST_IDS:
        odd = F.broadcast(odd)  # else all texts are shuffled
    keyed = docs.withColumn(name, key)
    again = keyed.join(odd.where("not later").select(name), name, "left_semi").dropDuplicates([name])
    return keyed.join(odd.select(name), name, "left_anti").unionByName(again).select(*columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam_prefix.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    own, at, there = (unused(docs, x) for x in ("__own", "__id", "__hash"))
    bad = found.where("contaminated").select(F.col("doc_id").alias(at), F.col("text_hash").alias(there)).distinct()
    keyed = docs.withColumn(own, F.xxhash64("text"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(own) == F.col(there)), "left_anti").select(*columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_table.encode_decode(docs, public_path("word_bpe_49k.json"), keep_ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("decontaminate", decontaminate), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's table is removed once the next one is written; the last one stays."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs

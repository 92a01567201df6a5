"""Queries opN_<name> over the whole tables, with production parameters, and their DuckDB forms where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelwell.llm import bpe_table, decontam_prefix, jaccard_pigeonhole, langid_em, line_windows, lm_automaton, media_sequences, quality_fm, ring_shards, token_counts
from pixelwell.llm.blocks import id_crc
from pixelwell.llm.tokens import public_path

METADATA = ("n_chars",)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(parts: int, part: int) -> Column:
    return F.pmod(id_crc(), F.lit(parts)) == part


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    machine = quality_fm.fit_quality(docs, _read(spark, sf_dir, "labels"), ~held_out(4, 2), metadata=METADATA)
    return quality_fm.score_quality(docs, machine, metadata=METADATA).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op2_langid_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    langs, logp = langid_em.fit_languages(docs, ~held_out(5, 0))
    return langid_em.predict_languages(docs, langs, logp).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "n_langs")


def op3_lm_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_automaton.score_texts(_read(spark, sf_dir, "documents"), held_out(7, 2))


def op4_bpe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_table.encode_decode(_read(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards.assign_shards(_read(spark, sf_dir, "documents"), n_shards=24)


def op7_jaccard_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_pigeonhole.near_groups(_read(spark, sf_dir, "documents"), width=3, part=90, whole=100)


def op8_decontam_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam_prefix.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op9_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a page of its paragraphs and a greymap of its whole text, found by digest, with a caption."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.sha2(media_sequences.payload_of(F.col("text")), 256)
    key = F.struct("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    caption = F.concat(F.lit("text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")))
    items = media_sequences.sequences(docs.select(key.alias("page"), media_sequences.page_of(F.col("text"), digest, caption).alias("html")), "page")
    media = media_sequences.measure(media_sequences.media_table(docs))
    found = media_sequences.resolve(items.withColumn("items", F.filter("items", lambda i: i["kind"] == "media")), "page", media)
    return found.select("page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_windows.dedup_lines(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


#: The pipeline's stages work on rows like those of documents.
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_fm": op1_quality_fm,
    "op2_langid_em": op2_langid_em,
    "op3_lm_automaton": op3_lm_automaton,
    "op4_bpe_table": op4_bpe_table,
    "op5_token_counts": op5_token_counts,
    "op6_ring_shards": op6_ring_shards,
    "op7_jaccard_pigeonhole": op7_jaccard_pigeonhole,
    "op8_decontam_prefix": op8_decontam_prefix,
    "op9_media_sequences": op9_media_sequences,
    "op10_line_windows": op10_line_windows,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op7_jaccard_pigeonhole": r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
g as (select distinct doc_id, g from (
  select doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) g from w)),
n as (select doc_id, count(*) n from g group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id x, doc_id y from documents union select r.x, e.b from r join e on e.a = r.y)
select d.doc_id, coalesce(n.n, 0) n_shingles, m.c component_id
from documents d left join n using (doc_id) join (select x, min(y) c from r group by 1) m on m.x = d.doc_id""",
    "op8_decontam_prefix": r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws from benchmark),
bw as (select distinct item_id, least(13, len(ws)) len, unnest(list_transform(range(1, greatest(1, len(ws) - 12) + 1), lambda i: array_to_string(ws[i:i + 12], ' '))) win from b where len(ws) > 0),
ds as (select doc_id, ws, l.len, unnest(range(1, len(ws) - l.len + 2)) s from d, (select distinct len from bw) l where len(ws) >= l.len),
dw as (select doc_id, len, s, array_to_string(ws[s:s + len - 1], ' ') win from ds),
h as (select doc_id, s, len, item_id from dw join bw using (len, win)),
c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + len)) p from h) group by 1),
i as (select doc_id, count(*) n_items, sha256(string_agg(item_id, ',' order by item_id)) items_sha256 from (select distinct doc_id, item_id::varchar item_id from h) group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, coalesce(items_sha256, sha256('')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from d left join c using (doc_id) left join i using (doc_id)""",
    "op10_line_windows": r"""
with d as (select doc_id, string_split(text, chr(10)) ls from documents),
v as (select doc_id, ls, least(3, len(ls)) n, unnest(range(1, len(ls) - least(3, len(ls)) + 2)) pos from d),
w as (select doc_id, n, pos, array_to_string(ls[pos:pos + n - 1], chr(10)) w from v),
f as (select *, row_number() over (partition by w, n order by doc_id, pos) k from w where regexp_matches(w, '[\p{L}\p{N}]')),
g as (select distinct doc_id, unnest(range(pos, pos + n)) line from f where k > 1),
x as (select doc_id, list(line) gone from g group by 1)
select d.doc_id, coalesce(len(ls), 0)::bigint n_lines, coalesce(len(gone), 0)::bigint n_removed,
  case when gone is null then array_to_string(ls, chr(10)) else array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: not list_contains(gone, i)), lambda i: ls[i]), chr(10)) end as text
from d left join x using (doc_id)""",
}


def oracles() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

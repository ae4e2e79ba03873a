"""The ten operators as registered queries, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm import exact_dedup, langid, media, mixing, near_dedup, packing, quality, suffix_dedup, token_counts, warc

LEARN_MOD, LEARN_REST = 4, 2
QUALITY_MOD = 5
KEEP_SCORE = 0.3
TOKEN_LIMIT = 512


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_rest(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(id_col).cast("string")) % mod


def op1_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out_mod=QUALITY_MOD)
    return scored.withColumn("predicted", (F.col("score") >= KEEP_SCORE).cast("int"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def learn_languages(docs: DataFrame) -> langid.LanguageModel:
    return langid.fit_languages(docs.where(id_rest("doc_id", LEARN_MOD) != LEARN_REST))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = langid.identify(docs.select("doc_id", "text"), learn_languages(docs))
    held = F.coalesce(id_rest("doc_id", LEARN_MOD) == LEARN_REST, F.lit(False))
    return judged.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", mixing.taken_words(F.col("draws")).alias("taken"), "draws")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_counts.token_prefix_index(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return index.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_scores, op2_packing, op3_suffix_dedup, op4_language_id, op5_exact_dedup, op6_source_mix, op7_near_dedup, op8_media, op9_warc, op10_token_counts)
    return {f.__name__: f for f in own}


OP5_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)
"""

OP7_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as shared from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by all),
links as (
  select a, b from pairs join sizes sa on sa.doc_id = a join sizes sb on sb.doc_id = b where 100 * shared >= 75 * (sa.n + sb.n - shared)),
sides as (select a as u, b as v from links union all select b, a from links),
reach(node, root) as (
  select doc_id, doc_id from documents union select sides.v, reach.root from reach join sides on sides.u = reach.node where sides.v > reach.root),
roots as (select node, min(root) as component_id from reach group by node)
select d.doc_id, coalesce(s.n, 0) as n_shingles, r.component_id, d.doc_id = r.component_id as kept
from documents d join roots r on r.node = d.doc_id left join sizes s on s.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op7_near_dedup": OP7_SQL}

"""One query for each operator, over its whole tables, and SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, langid, neardup, njaccard, packing, quality, toxicity, urlfilter, warc

#: Folder of the public tokenizer files; the installed package's unless set.
TOKENIZERS = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers")

#: Rules of the url query: (host/path, block?).
URL_RULES = (("org/", False), ("example.org/es/", True), ("example.org/en/1", True), ("com/fr/", False), ("com/de/", True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_roundtrip(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return njaccard.ngram_jaccard(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_nearest": op2_nearest,
    "op3_quality": op3_quality,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

_BASE32_GROUP = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * k + 1}, 5))::bigint >> {s}) & 31) + 1)::int, 1)" for k in range(8) for s in (15, 10, 5, 0))

ORACLE_SQL: dict[str, str] = {
    "op9_warc": f"""
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as h, min(page_id) over (partition by payload) as first from p)
select page_id, payload_bytes, {_BASE32_GROUP} as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to from d
""",
    "op4_url_filter": r"""
with parts as (
  select page_id, url, case when url is null or position('://' in url) = 0 then null else substr(url, position('://' in url) + 3) end as rest from pages
), cut as (
  select page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') as raw_host, coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') as path from parts
), hosted as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from cut
), rules(h, p, block) as (
  values ('org', '/', false), ('example.org', '/es/', true), ('example.org', '/en/1', true), ('com', '/fr/', false), ('com', '/de/', true)
), best as (
  select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(block, length(h || p)) as block
  from hosted join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
)
select page_id, host, path, rule, case when block then 'block' else 'allow' end as verdict from hosted left join best using (page_id)
""",
}

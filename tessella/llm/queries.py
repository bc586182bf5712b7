"""The registered queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.fingerprint import edit_likeness
from tessella.llm.licenses import licenses_sql, scan_licenses
from tessella.llm.lines import LINES_SQL, drop_recurring_lines
from tessella.llm.minhash import near_duplicates
from tessella.llm.mixing import MIX_SQL, mix_sources
from tessella.llm.packing import pack, pack_sql
from tessella.llm.tokens import token_counts
from tessella.llm.topk import TOP_K_SQL, as_long, scaled, top_k
from tessella.llm.toxicity import fit_toxicity, score_toxicity
from tessella.llm.warc import ID_PREFIX, base32_sha1, read_warc, write_pages
from tessella.storage import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(_table(spark, sf_dir, "documents"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The SQL's templates: links between forms of which neither comes first at a node are left out.
    return drop_recurring_lines(_table(spark, sf_dir, "documents"), pairs=False).select("doc_id", "text", "n_lines", "n_dropped")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("x"))
    return top_k(vectors, F.col("vec_id") % 20 == 0, whole=True).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", as_long(F.col("score")).alias("score"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_pages(_table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, f"^{ID_PREFIX}([0-9-]+)$", 1)
    page_id = F.when(number("record_id") != "", number("record_id").cast("long")).alias("page_id")
    responses = read_warc(spark, path, "record_id string, record_type string, payload binary").where("record_type = 'response'")
    revisits = read_warc(spark, path, "record_id string, record_type string, refers_to string, payload_digest string, payload_length long").where("record_type = 'revisit'")
    full = responses.select(page_id, F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    slim = revisits.select(page_id, F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", number("refers_to").cast("long").alias("refers_to"))
    return full.union(slim)


WARC_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, payload_bytes, translate(array_to_string(list_transform(range(0, 8), lambda k: to_base(('0x' || substr(h, 5 * k + 1, 5))::BIGINT, 32, 4)), ''),
  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM d),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first OR page_id IS NULL THEN first END AS refers_to FROM m
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_mix_sources, op3_minhash_neardup, op4_token_counts, op5_toxicity, op6_fingerprints, op7_pack, op8_line_dedup, op9_top_k, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses_sql(), "op2_mix_sources": MIX_SQL, "op7_pack": pack_sql(), "op8_line_dedup": LINES_SQL, "op9_top_k": TOP_K_SQL, "op10_warc": WARC_SQL}

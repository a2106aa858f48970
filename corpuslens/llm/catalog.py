"""The registered queries of the training-data operators.

Each ``opN_<name>`` applies its operator with production parameters to its
whole table and derives the contract's columns; ``pipeline`` runs the stages of
``corpus_pipeline``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers

from . import twins
from .conversations import audited, damaged
from .embed_dedup import near_vectors
from .html_text import main_text
from .langid import held_out, identify, trained_on_rest
from .merkle import differing, edited_fingerprints
from .neardup import near_duplicates
from .packing import pack_documents
from .pieces import decode, encode
from .quality import COUNTS, quality
from .search import search
from .secret_scan import BASE_RULES, listed, scan
from .sharding import assign_shards
from .urls import UrlRule, judge_urls

URL_RULES = (UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"),
             UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/"))
SHARD_BYTES = 1 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


@_query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = decode(encode(_table(spark, sf_dir, "documents", "doc_id", "text"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


@_query
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = main_text(_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return rows.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, threshold=80)


@_query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select("row.doc_id", *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)),
                        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@_query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign_shards(_table(spark, sf_dir, "documents", "doc_id", "text"), SHARD_BYTES)
    return rows.select("row.doc_id", "n_bytes", "shard_id", F.col("depth").cast("long").alias("depth"), "shard_bytes",
                       "shard_rows")


ORACLES["op5_sharding"] = f"""
WITH RECURSIVE h AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::UBIGINT), 60, '0') AS bits
  FROM documents),
nodes AS (
  SELECT d AS depth, substr(bits, 1, d) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM h, range(0, 33) AS r(d) GROUP BY ALL),
placed AS (
  SELECT h.doc_id, h.n_bytes, h.bits, count(*) FILTER (WHERE n.shard_bytes > {SHARD_BYTES} AND n.shard_rows > 1) AS depth
  FROM h JOIN nodes n ON n.prefix = substr(h.bits, 1, n.depth) GROUP BY ALL)
SELECT a.doc_id, a.n_bytes, n.prefix AS shard_id, a.depth, n.shard_bytes, n.shard_rows
FROM placed a JOIN nodes n ON n.depth = a.depth AND n.prefix = substr(a.bits, 1, n.depth)
"""


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return quality(docs).select("doc_id", *COUNTS, "base_failed", "kept")


@_query
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge_urls(_table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)
    names = F.array(*(F.lit(r.name) for r in URL_RULES))
    rule = F.when(F.col("rule").isNotNull(), F.get(names, F.col("rule")))
    return rows.select("row.page_id", "host", "path", rule.alias("rule"), "verdict", "score")


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return pack_documents(docs, path, capacity=1024, closing=2, remembered=600_000).select(
        "row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), trained_on_rest(docs))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


@_query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(_table(spark, sf_dir, "documents", "doc_id", "text"))
    at = F.transform(differing(F.col("fingerprint"), F.col("edited_fingerprint")),
                     lambda d: F.concat(d["section"].cast("string"), F.lit("."), d["paragraph"].cast("string")))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                       "edited_fingerprint", "near_edited", "near_next", F.array_join(at, ",").alias("edits"))


@_query
def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), threshold=0.95)


@_query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return audited(damaged(rows), rows)


@_query
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"), k=10)


ORACLES["op3_neardup"] = twins.NEARDUP
ORACLES["op4_secrets"] = twins.SECRETS
ORACLES["op6_quality"] = twins.QUALITY
ORACLES["op13_search"] = twins.SEARCH
QUERIES["pipeline"] = corpus_pipeline.run

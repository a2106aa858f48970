"""Registered queries for chunking, embedding and nearest-vector search (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as V
from ..session import spread
from ..sources import table
from .registry import register
from .sqlparts import sql_embedding, sql_l2, sql_rank_key, sql_tokens

EMB_DIM = 64          # width of the driver's embeddings table
DOC_DIM = 64          # embed text into the same width


def _knn_oracle(same_label: bool) -> str:
    cond = "WHERE q.label = v.label" if same_label else ""
    return f"""
SELECT query_id, CAST(rank AS BIGINT) AS rank, embedding_id, round(dist, 6) AS dist FROM (
  SELECT query_id, embedding_id, dist,
         row_number() OVER (PARTITION BY query_id ORDER BY dist, embedding_id) AS rank
  FROM (SELECT q.vec_id AS query_id, v.vec_id AS embedding_id,
               {sql_l2('q.embedding', 'v.embedding')} AS dist
        FROM embeddings q JOIN embeddings v ON TRUE {cond}) d) r
WHERE rank <= 5"""


def _self_knn(spark, sf, same_label: bool):
    emb = table(spark, sf, "embeddings")
    vecs = emb.select(F.col("vec_id").alias("embedding_id"), "embedding", "label")
    qs = emb.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    res = V.knn(vecs, qs, k=5, same_class=("label", "label") if same_label else None)
    return res.select("query_id", F.col("rank").cast("long").alias("rank"), "embedding_id",
                      F.round("dist", 6).alias("dist"))


@register("knn_l2", _knn_oracle(False))
def knn_l2(spark, sf):
    """The 5 nearest vectors (squared L2) of every vector in the table."""
    return _self_knn(spark, sf, False)


@register("knn_by_label", _knn_oracle(True))
def knn_by_label(spark, sf):
    """Nearest vectors restricted to the query's own class."""
    return _self_knn(spark, sf, True)


# Few different vectors, so nearly every distance is a tie: the signs of the
# first TIE_DIM components.
TIE_DIM = 5


@register("knn_ties", f"""
WITH t AS (SELECT vec_id, list_transform(list_slice(embedding, 1, {TIE_DIM}), lambda x: sign(x)::FLOAT) AS v FROM embeddings)
SELECT query_id, CAST(rank AS BIGINT) AS rank, embedding_id, round(dist, 6) AS dist FROM (
  SELECT query_id, embedding_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, embedding_id) AS rank
  FROM (SELECT q.vec_id AS query_id, v.vec_id AS embedding_id, {sql_l2('q.v', 'v.v')} AS dist FROM t q JOIN t v ON TRUE) d) r
WHERE rank <= 7""")
def knn_ties(spark, sf):
    """D6 where most vectors are equal: 7 nearest, ties by id."""
    signs = F.transform(F.slice("embedding", 1, TIE_DIM), lambda x: F.signum(x).cast("float"))
    t = table(spark, sf, "embeddings").select("vec_id", signs.alias("embedding"))
    res = V.knn(t.withColumnRenamed("vec_id", "embedding_id"), t.withColumnRenamed("vec_id", "query_id"), k=7)
    return res.select("query_id", F.col("rank").cast("long").alias("rank"), "embedding_id", F.round("dist", 6).alias("dist"))


@register("vec_dim_check", f"""
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> {EMB_DIM}
                        OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0) AS n_bad
FROM embeddings""")
def vec_dim_check(spark, sf):
    """Rows whose vector is not EMB_DIM finite floats."""
    return V.check_vectors(table(spark, sf, "embeddings"), EMB_DIM)


@register("chunk_tokens", f"""
WITH t AS (SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents),
c AS (SELECT doc_id, unnest(range(0, CAST(ceil(len(tokens) / 512.0) AS BIGINT))) AS chunk_no, tokens FROM t)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no,
       CAST(len(list_slice(tokens, chunk_no * 512 + 1, chunk_no * 512 + 512)) AS INTEGER) AS n_tokens,
       md5(array_to_string(list_slice(tokens, chunk_no * 512 + 1, chunk_no * 512 + 512), ' ')) AS chunk_md5
FROM c""")
def chunk_tokens(spark, sf):
    """512-token chunks of every whole document."""
    ch = V.chunk_tokens(spread(table(spark, sf, "documents")), "text", ["doc_id"])
    return ch.select("doc_id", "chunk_no", F.size("tokens").alias("n_tokens"),
                     F.md5(F.array_join("tokens", " ")).alias("chunk_md5"))


@register("embed_docs", f"""
WITH e AS (SELECT doc_id, {sql_embedding('text', DOC_DIM)} AS v FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS dim, round(v[i]::DOUBLE, 6) AS value
FROM e, range(1, {DOC_DIM} + 1) r(i) WHERE v[i] <> 0""")
def embed_docs(spark, sf):
    """Hashed-count embedding of every document (non-zero entries)."""
    emb = V.embed(spread(table(spark, sf, "documents")), "text", V.HashedEmbedder(DOC_DIM))
    return (emb.select("doc_id", F.posexplode("embedding").alias("dim", "value"))
               .filter(F.col("value") != 0)
               .select("doc_id", F.col("dim").cast("int").alias("dim"),
                       F.round(F.col("value").cast("double"), 6).alias("value")))


@register("knn_docs", f"""
WITH d AS (SELECT doc_id, {sql_embedding('text', DOC_DIM)} AS v FROM documents),
q AS (SELECT item_id, {sql_embedding('text', DOC_DIM)} AS v FROM benchmark),
p AS (SELECT q.item_id AS query_id, d.doc_id AS embedding_id, {sql_l2('q.v', 'd.v')} AS dist
      FROM q JOIN d ON TRUE),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id
                                   ORDER BY {sql_rank_key('dist', 9)}, embedding_id) AS rank FROM p)
SELECT query_id, CAST(rank AS BIGINT) AS rank, embedding_id, round(dist, 6) AS dist
FROM r WHERE rank <= 5""")
def knn_docs(spark, sf):
    """D2 + D6: embed benchmark questions and all documents, 5 nearest docs each."""
    emb = V.HashedEmbedder(DOC_DIM)
    docs = V.embed(spread(table(spark, sf, "documents")), "text", emb).select(
        F.col("doc_id").alias("embedding_id"), "embedding")
    qs = V.embed(table(spark, sf, "benchmark"), "text", emb).select(
        F.col("item_id").alias("query_id"), "embedding")
    res = V.knn(docs, qs, k=5, rank_decimals=9)
    return res.select("query_id", F.col("rank").cast("long").alias("rank"), "embedding_id",
                      F.round("dist", 6).alias("dist"))

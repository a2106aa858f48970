"""Registered queries for record-store operations.

The free-form metadata collection is derived from ``part``: one entry per
part with the three required keys plus brand, size and type; insertion order
``_seq`` is the part key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code as C
from ..operators import docs as D
from ..operators import metadata as M
from ..operators import vectors as V
from ..session import materialize
from ..sources import table
from .corpora import MD_PAGES_SQL, PY_PARTS_SQL, md_pages, py_parts, with_ctes
from .q_code import FP, K
from .registry import register
from .sqlparts import sql_tokens

_META_SQL = f"""meta AS (
  SELECT p_partkey AS _seq, 'part_' || {K} AS function_name, {FP} AS file_path,
         'docs/api/' || lower(p_type) || '.md' AS api_reference, p_brand AS brand, p_size AS size,
         p_type AS ptype
  FROM part)
"""
_COLS = "_seq, function_name, file_path, api_reference, brand, size, ptype"


def metadata_table(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    return p.select(
        F.col("p_partkey").alias("_seq"), F.concat(F.lit("part_"), k).alias("function_name"),
        F.concat(F.lit("src/part_"), F.lpad(k, 8, "0"), F.lit(".py")).alias("file_path"),
        F.concat(F.lit("docs/api/"), F.lower("p_type"), F.lit(".md")).alias("api_reference"),
        F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("ptype"))


@register("meta_find", f"WITH {_META_SQL} SELECT {_COLS} FROM meta WHERE brand = 'Brand#1'")
def meta_find(spark, sf):
    """F8: all entries matching an equality filter."""
    return M.find(metadata_table(spark, sf), {"brand": "Brand#1"})


@register("meta_find_one", f"WITH {_META_SQL} SELECT {_COLS} FROM meta WHERE ptype = 'SMALL' "
          "ORDER BY _seq LIMIT 1")
def meta_find_one(spark, sf):
    """first match in store order."""
    return M.find_one(metadata_table(spark, sf), {"ptype": "SMALL"})


@register("meta_find_first_per", f"""WITH {_META_SQL}
SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY _seq) AS r FROM meta) x
WHERE r = 1""")
def meta_find_first_per(spark, sf):
    """F9 as a batch: the first entry for every brand filter."""
    return M.find_first_per(metadata_table(spark, sf), ["brand"])


@register("meta_update_one", f"""WITH {_META_SQL},
t AS (SELECT min(_seq) AS s FROM meta WHERE ptype = 'SMALL')
SELECT _seq, function_name, file_path,
       CASE WHEN _seq = (SELECT s FROM t) THEN 'docs/api/featured.md' ELSE api_reference END
         AS api_reference, brand, size, ptype
FROM meta""")
def meta_update_one(spark, sf):
    """F10 (one): ``$set`` on the first match only."""
    return M.update(metadata_table(spark, sf), {"ptype": "SMALL"},
                    {"api_reference": "docs/api/featured.md"})


@register("meta_update_first_per", f"""WITH {_META_SQL},
t AS (SELECT min(_seq) AS s FROM meta GROUP BY brand)
SELECT _seq, function_name, file_path,
       CASE WHEN _seq IN (SELECT s FROM t) THEN 'docs/api/featured.md' ELSE api_reference END
         AS api_reference, brand, size, ptype
FROM meta""")
def meta_update_first_per(spark, sf):
    """F10 (one) as a batch: first entry of every brand updated."""
    return M.update_first_per(metadata_table(spark, sf), ["brand"], None,
                              {"api_reference": "docs/api/featured.md"})


@register("meta_update_many", f"""WITH {_META_SQL}
SELECT {_COLS}, CASE WHEN ptype = 'SMALL' THEN 'small' END AS flag FROM meta""")
def meta_update_many(spark, sf):
    """F10 (many): ``$set`` a new field on every match."""
    return M.update(metadata_table(spark, sf), {"ptype": "SMALL"}, {"flag": "small"},
                    multiple=True)


@register("meta_delete_one", f"""WITH {_META_SQL}
SELECT {_COLS} FROM meta WHERE _seq <> (SELECT min(_seq) FROM meta WHERE brand = 'Brand#1')""")
def meta_delete_one(spark, sf):
    """F11 (one): drop the first match."""
    return M.delete(metadata_table(spark, sf), {"brand": "Brand#1"})


@register("meta_delete_first_per", f"""WITH {_META_SQL}
SELECT {_COLS} FROM meta WHERE _seq NOT IN (SELECT min(_seq) FROM meta GROUP BY ptype)""")
def meta_delete_first_per(spark, sf):
    """F11 (one) as a batch: drop the first entry of every type."""
    return M.delete_first_per(metadata_table(spark, sf), ["ptype"])


@register("meta_delete_many", f"WITH {_META_SQL} SELECT {_COLS} FROM meta WHERE brand <> 'Brand#1'")
def meta_delete_many(spark, sf):
    """F11 (many): drop every match."""
    return M.delete(metadata_table(spark, sf), {"brand": "Brand#1"}, multiple=True)


@register("meta_count", f"WITH {_META_SQL} SELECT brand, count(*) AS n FROM meta GROUP BY brand")
def meta_count(spark, sf):
    """matches per brand filter."""
    return M.count_per(metadata_table(spark, sf), ["brand"])


@register("meta_validate", """
SELECT count(*) AS n_entries, count(*) FILTER (WHERE p_size % 5 = 0) AS n_invalid FROM part""")
def meta_validate(spark, sf):
    """Entries lacking a required key (here every part whose size is a
    multiple of 5 has no ``api_reference``) -- the insert would be refused."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    rec = F.map_concat(
        F.create_map(F.lit("function_name"), F.concat(F.lit("part_"), k),
                     F.lit("file_path"), F.concat(F.lit("src/part_"), k, F.lit(".py"))),
        F.when(F.col("p_size") % 5 == 0, F.create_map().cast("map<string,string>"))
         .otherwise(F.create_map(F.lit("api_reference"), F.lower("p_type"))))
    return M.validate_metadata(p.select(rec.alias("record")), "record")


# --------------------------------------------------------------------------
# ids and lookups over the indexed derived corpus
# --------------------------------------------------------------------------

_KEYS_SQL = with_ctes(MD_PAGES_SQL, PY_PARTS_SQL) + f""",
code AS (SELECT file_path, unnest(range(0, CAST(ceil(len({sql_tokens('raw_code')}) / 512.0) AS BIGINT)))
                AS chunk_no, 'code' AS kind FROM py_parts),
docs AS (SELECT file_path, 0 AS chunk_no, 'doc' AS kind FROM md_pages),
allk AS (SELECT * FROM code UNION ALL SELECT * FROM docs),
keys AS (SELECT file_path, CAST(chunk_no AS INTEGER) AS chunk_no, kind,
                row_number() OVER (ORDER BY file_path, chunk_no) - 1 AS embedding_id FROM allk)
"""


def _keys(spark, sf):
    # the texts of files that parse: counted in two branches (long ones by piece), so
    # staged, or each branch would parse all files
    code = C.parse_code(py_parts(spark, sf))[0].select("file_path", "raw_code").transform(materialize)
    # per-file chunk counts: read by the range pass (twice) and the chunk expansion
    counts = V.chunk_counts(code, "raw_code", ["file_path"]).transform(materialize)
    first = V.file_first_ids(counts, md_pages(spark, sf).select("file_path"))
    return V.number_chunks(first, counts)


@register("dense_ids", _KEYS_SQL + "SELECT file_path, chunk_no, kind, embedding_id FROM keys")
def dense_ids(spark, sf):
    """One id per code chunk and per document, dense over both, in path order."""
    return _keys(spark, sf).select("file_path", "chunk_no", "kind", "embedding_id")


@register("by_embedding_id", _KEYS_SQL + """,
probes AS (SELECT embedding_id FROM keys UNION ALL SELECT embedding_id + 1000000000 FROM keys)
SELECT p.embedding_id, c.file_path AS code_file, d.file_path AS doc_file
FROM probes p LEFT JOIN keys c ON c.embedding_id = p.embedding_id AND c.kind = 'code'
LEFT JOIN keys d ON d.embedding_id = p.embedding_id AND d.kind = 'doc'""")
def by_embedding_id(spark, sf):
    """the code record holding each id (array membership) and the doc
    record with that id, for every id and as many unknown ids."""
    keys = _keys(spark, sf)
    code_files = V.ids_per_file(keys).filter(F.col("kind") == "code")
    doc_files = keys.filter(F.col("kind") == "doc").select("embedding_id", "file_path")
    probes = keys.select("embedding_id").unionByName(
        keys.select((F.col("embedding_id") + 1000000000).alias("embedding_id")))
    code_hit = M.code_by_embedding_id(code_files, probes).withColumnRenamed("file_path", "code_file")
    doc_hit = M.doc_by_embedding_id(doc_files, probes.distinct()).withColumnRenamed("file_path", "doc_file")
    return code_hit.join(doc_hit, "embedding_id", "left")


@register("by_path", with_ctes(MD_PAGES_SQL, PY_PARTS_SQL) + """,
probes AS (SELECT file_path FROM py_parts UNION ALL SELECT file_path FROM md_pages
           UNION ALL SELECT 'missing/' || file_path FROM py_parts)
SELECT p.file_path, length(c.raw_code) AS code_chars, md5(c.raw_code) AS code_md5, d.n_sections
FROM probes p LEFT JOIN py_parts c ON c.file_path = p.file_path
LEFT JOIN (SELECT file_path, CAST(len(regexp_extract_all(raw_content, '(?m)^(#{1,6})\\s+(.+?)$', 2))
                  AS INTEGER) AS n_sections FROM md_pages) d ON d.file_path = p.file_path""")
def by_path(spark, sf):
    """record lookups by path for every file and as many unknown paths."""
    code, _ = C.parse_code(py_parts(spark, sf), keep=materialize)
    docs, _ = D.parse_docs(md_pages(spark, sf))
    probes = code.select("file_path").unionByName(docs.select("file_path")).unionByName(
        code.select(F.concat(F.lit("missing/"), "file_path").alias("file_path")))
    c = M.by_path(M.with_defaults(code), probes, ["raw_code"])
    d = M.by_path(M.doc_with_defaults(docs), probes.distinct(), ["sections"])
    return (c.select("file_path", F.length("raw_code").cast("long").alias("code_chars"), F.md5("raw_code").alias("code_md5"))
             .join(d.select("file_path", F.size("sections").cast("int").alias("n_sections"))
                    .withColumn("n_sections", F.when(F.col("n_sections") >= 0, F.col("n_sections"))),
                   "file_path", "left"))

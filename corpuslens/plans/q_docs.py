"""Registered queries for documentation extraction (C1-C9) on ``md_pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docs as D
from .corpora import MD_PAGES_SQL, md_pages, with_ctes
from .registry import register

_MD = with_ctes(MD_PAGES_SQL)

# the operators' patterns, which are also DuckDB's syntax
_HEADINGS = f"regexp_extract_all(raw_content, '(?m){D.HEADING_PATTERN}', 2)"
_IN_FENCE = [f"regexp_extract_all(f, '{p}', 1)" for p in (D.DEF_PATTERN, D.CLASS_PATTERN, D.IMPORT_PATTERN)]
_LINKED = " OR ".join(f"contains(lower(p[2]), '{w}')" for w in D.LINK_WORDS)
_REFS_SQL = f"""
  list_concat(list_concat(
    flatten(list_transform(regexp_extract_all(raw_content, '(?s){D.FENCE_PATTERN}', 1),
      lambda f: list_concat(list_concat({_IN_FENCE[0]}, {_IN_FENCE[1]}), {_IN_FENCE[2]}))),
    regexp_extract_all(raw_content, '{D.INLINE_CODE}', 1)),
    list_transform(
      list_filter(list_zip(regexp_extract_all(raw_content, '{D.LINK}', 1), regexp_extract_all(raw_content, '{D.LINK}', 2)),
                  lambda p: {_LINKED}),
      lambda p: p[1] || ' (' || p[2] || ')'))"""
#: The whole documentation record as text: headings, cleaned text, references.
DOC_DETAILS_SQL = f"""array_to_string(list_transform({_HEADINGS}, lambda x: trim(x)), '|') || '#' ||
  md5(regexp_replace(raw_content, '\\n\\s*\\n', chr(10) || chr(10), 'g')) || '#' || array_to_string(list_sort(list_distinct({_REFS_SQL})), ', ')"""


def doc_details(sections="sections", cleaned="cleaned_content", refs="api_references"):
    return F.concat(F.array_join(sections, "|"), F.lit("#"), F.md5(cleaned), F.lit("#"), refs)


@register("doc_sections", _MD + f"""
, s AS (SELECT file_path, {_HEADINGS} AS secs FROM md_pages)
SELECT file_path, CAST(unnest(range(0, len(secs))) AS INTEGER) AS pos, trim(unnest(secs)) AS section
FROM s""")
def doc_sections(spark, sf):
    """Every heading title of every Markdown page, in order."""
    return md_pages(spark, sf).select(
        "file_path", F.posexplode(D.sections("raw_content")).alias("pos", "section")) \
        .withColumn("pos", F.col("pos").cast("int"))


@register("doc_api_refs", _MD + f"""
SELECT file_path, array_to_string(list_sort(list_distinct({_REFS_SQL})), ', ') AS api_references
FROM md_pages""")
def doc_api_refs(spark, sf):
    """Sorted distinct API references per page (fences, inline code, links)."""
    docs, _ = D.parse_docs(md_pages(spark, sf))
    return docs.select("file_path", "api_references")


@register("doc_api_ref_rows", _MD + f"""
, r AS (SELECT file_path, list_sort(list_distinct({_REFS_SQL})) AS refs FROM md_pages)
SELECT file_path, CAST(unnest(range(0, len(refs))) AS INTEGER) AS pos, unnest(refs) AS ref FROM r""")
def doc_api_ref_rows(spark, sf):
    """C5 as rows: one reference per row with its sorted position."""
    md = md_pages(spark, sf)
    return md.select("file_path", F.posexplode(D.api_reference_list("raw_content"))
                     .alias("pos", "ref")).withColumn("pos", F.col("pos").cast("int"))


@register("doc_clean", _MD + r"""
SELECT file_path, regexp_replace(raw_content, '\n\s*\n', chr(10) || chr(10), 'g') AS cleaned_content
FROM md_pages""")
def doc_clean(spark, sf):
    """Blank-line runs squeezed to one empty line."""
    docs, _ = D.parse_docs(md_pages(spark, sf))
    return docs.select("file_path", "cleaned_content")


@register("doc_collapse", _MD + r"""
SELECT file_path, regexp_replace(raw_content, '\s+', ' ', 'g') AS collapsed FROM md_pages""")
def doc_collapse(spark, sf):
    """Whitespace runs collapsed to one space."""
    return md_pages(spark, sf).select(
        "file_path", D.preprocess_documentation("raw_content").alias("collapsed"))


@register("doc_header_lines", _MD + r"""
, h AS (SELECT file_path, list_transform(list_filter(string_split(raw_content, chr(10)),
               lambda l: starts_with(l, '#')), lambda l: trim(l)) AS lines FROM md_pages)
SELECT file_path, CAST(unnest(range(0, len(lines))) AS INTEGER) AS pos, unnest(lines) AS line FROM h""")
def doc_header_lines(spark, sf):
    """Lines that start with '#', stripped."""
    return md_pages(spark, sf).select(
        "file_path", F.posexplode(D.extract_sections("raw_content")).alias("pos", "line")) \
        .withColumn("pos", F.col("pos").cast("int"))


@register("doc_records", _MD + f"""
SELECT file_path, CAST(len({_HEADINGS}) AS INTEGER) AS n_sections, length(raw_content) AS n_chars, md5(raw_content) AS content_md5,
       {DOC_DETAILS_SQL} AS details, CAST(-1 AS BIGINT) AS embedding_id, 'DocumentationFile.class' AS type
FROM md_pages""")
def doc_records(spark, sf):
    """The assembled documentation record, all fields."""
    docs, _ = D.parse_docs(md_pages(spark, sf))
    return docs.select("file_path", F.size("sections").cast("int").alias("n_sections"),
                       F.length("raw_content").cast("long").alias("n_chars"), F.md5("raw_content").alias("content_md5"),
                       doc_details().alias("details"), "embedding_id", "type")


@register("doc_strict_quarantine", _MD + f"""
SELECT file_path, CASE WHEN page_id_mod = 0 THEN 'quarantine' ELSE 'doc' END AS outcome,
       CASE WHEN page_id_mod = 0 THEN NULL
            ELSE CAST(len({_HEADINGS}) AS INTEGER) END
         AS n_sections
FROM (SELECT file_path, raw_content,
             CAST(regexp_extract(file_path, '([0-9]+)', 1) AS BIGINT) % 5 AS page_id_mod FROM md_pages) m""")
def doc_strict_quarantine(spark, sf):
    """C2 with ``strict=True`` (Q1 as written): every page whose id is a
    multiple of 5 gets a line of six backticks, which the written fence
    pattern cannot read -- those pages are quarantined, the rest parsed."""
    md = md_pages(spark, sf)
    pid = F.regexp_extract("file_path", r"([0-9]+)", 1).cast("long")
    md = md.withColumn("raw_content", F.when(pid % 5 == 0, F.concat("raw_content", F.lit("``````\n")))
                       .otherwise(F.col("raw_content")))
    docs, bad = D.parse_docs(md, strict=True)
    return (docs.select("file_path", F.lit("doc").alias("outcome"),
                        F.size("sections").cast("int").alias("n_sections"))
                .unionByName(bad.select("file_path", F.lit("quarantine").alias("outcome"),
                                        F.lit(None).cast("int").alias("n_sections"))))

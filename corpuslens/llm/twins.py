"""DuckDB SQL twins of the operators' queries that SQL can express."""

from __future__ import annotations

from .quality import MARGINS, PRIOR, SPREAD
from .secret_scan import BASE_RULES, RULES

_WORD = r"[^\x20\x09-\x0D]"

NEARDUP = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '{_WORD}+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] || chr(10) || ws[i + 3] AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4) x
    UNION ALL SELECT doc_id, array_to_string(ws, chr(10)) FROM w WHERE len(ws) BETWEEN 1 AND 3) y),
size AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id
           GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.y, reach.r FROM reach JOIN both_ways l ON l.x = reach.doc_id),
component AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN component c ON c.doc_id = d.doc_id LEFT JOIN size s ON s.doc_id = d.doc_id
"""

_RATES = {
    "symbol_rate": "1000 * n_symbols // greatest(word_chars, 1)",
    "upper_rate": "1000 * len(regexp_extract_all(t, '[A-Z]')) // greatest(len(regexp_extract_all(t, '[A-Za-z]')), 1)",
    "bang_rate": "1000 * len(regexp_extract_all(t, '[!?]')) // greatest(word_chars, 1)",
    "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)",
    "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)",
}


def _blend(own: str, below: str) -> str:
    """Share up to a grid value of a group's counts and PRIOR documents dealt as below."""
    return f"({own}.upto + {PRIOR} * {below}) / ({own}.size + {PRIOR})"


def _counted(name: str, by: str) -> str:
    """Documents up to each grid value of each rate, by group: ``by``..., rate, v, upto, size."""
    same = "".join(f"n.{c} IS NOT DISTINCT FROM k.{c} AND " for c in by.split(", ") if c)
    cols = "".join(f"k.{c}, " for c in by.split(", ") if c)
    more = f"{by}, " if by else ""
    return f"""{name} AS (
  SELECT {cols}k.rate, v, k.size, sum(coalesce(n.n, 0)) OVER (PARTITION BY {cols}k.rate ORDER BY v)::DOUBLE AS upto
  FROM (SELECT {more}rate, count(*)::DOUBLE AS size FROM sketched GROUP BY {more}rate) k CROSS JOIN range(0, 1001) AS grid(v)
  LEFT JOIN (SELECT {more}rate, x, count(*) AS n FROM sketched GROUP BY {more}rate, x) n ON {same}n.rate = k.rate AND n.x = v)"""


QUALITY = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM documents),
windows AS (
  SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3) x),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) y WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) z GROUP BY doc_id),
counted AS (
  SELECT w.*, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
rated AS (
  SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         {", ".join(f"{v} AS {k}" for k, v in _RATES.items())}
  FROM counted),
sketched AS (
  SELECT lang, source, unnest([{", ".join(f"'{k}'" for k in MARGINS)}]) AS rate, unnest([{", ".join(MARGINS)}]) AS x
  FROM rated WHERE NOT base_failed),
{_counted("g", "lang, source")},
{_counted("l", "lang")},
{_counted("a", "")},
shares AS (
  SELECT g.lang, g.source, g.rate, g.v, {_blend("g", "(" + _blend("l", "(a.upto / a.size)") + ")")} AS share
  FROM g JOIN l ON l.lang IS NOT DISTINCT FROM g.lang AND l.rate = g.rate AND l.v = g.v JOIN a ON a.rate = g.rate AND a.v = g.v),
quantiles AS (
  SELECT lang, source, rate, min(v) FILTER (WHERE share >= 0.25 - 1e-12) AS low, min(v) FILTER (WHERE share >= 0.75 - 1e-12) AS high
  FROM shares GROUP BY lang, source, rate),
limits AS (
  SELECT lang, source, {", ".join(f"max(high + {SPREAD} * (high - low) + {m}) FILTER (WHERE rate = '{k}') AS {k}" for k, m in MARGINS.items())}
  FROM quantiles GROUP BY lang, source)
SELECT r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
       NOT r.base_failed AND NOT coalesce({" OR ".join(f"r.{k} > f.{k}" for k in MARGINS)}, false) AS kept
FROM rated r LEFT JOIN limits f ON f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source
"""


def _matches(rank: int, rule) -> str:
    """Matches of a rule with their places: lengths of gaps and matches, added up."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, s[i] AS start, s[i] + h[i] AS stop FROM (
    SELECT doc_id, h, a, unnest(range(1, len(h) + 1)) AS i, list_transform(range(1, len(h) + 1),
           lambda j: list_sum(g[1:j]) + coalesce(list_sum(h[1:j - 1]), 0)) AS s
    FROM (SELECT doc_id, list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) AS h,
                 list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x)) AS a,
                 list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS g FROM d) x WHERE len(h) > 0) y
  WHERE a[i] >= {rule.least}"""


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_matches(k, r) for k, r in enumerate(RULES))}),
listed AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE rank = {k}) AS n_{r.kind}" for k, r in enumerate(BASE_RULES))},
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(BASE_RULES)}) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed l ON l.doc_id = d.doc_id
"""


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
SEARCH = f"""
WITH items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS uid, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
tf AS (
  SELECT uid, doc_id, len(any_value(terms))::BIGINT AS n, term, count(*) AS tf
  FROM (SELECT uid, doc_id, terms, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM items) GROUP BY uid, doc_id, term),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, s GROUP BY term),
parts AS (
  SELECT uid, doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS part
  FROM tf JOIN w ON w.term = tf.term, s),
scores AS (
  SELECT item_id, uid, doc_id, sum(part)::BIGINT AS score FROM parts JOIN items USING (term) GROUP BY ALL),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

"""Quality rules with thresholds that adapt to each language and source.

Every text is measured once (counts below). Its rates, as whole per mille,
go into one mergeable quantile sketch per (lang, source, rate): counts per
grid value, at most 1,001 of them, so a sketch has a bounded size, adding
counts merges two sketches exactly, and a quantile is off by less than 0.001.
A document is rejected when a rate lies above its group's upper fence

    q75 + SPREAD * (q75 - q25) + margin of the rate

so a cutoff follows what is usual in that language and source. Every group's
quantiles are those of its own sketch with ``PRIOR`` documents more that are
dealt as in its language, and the language's are blended with the whole table's
likewise: one formula at every size, in which a group's own rates count for more
the more documents it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import arrow_map, schema_with, staged
from .words import Chunk, chunks, find_words, hash_ranges, mix64

#: Per rate, the distance in per mille beyond the spread that is still ordinary.
MARGINS = {"symbol_rate": 40, "upper_rate": 60, "bang_rate": 40, "dup_line_rate": 450, "repeat_rate": 300}
SPREAD = 3
PRIOR = 200

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ALL = (*COUNTS, *MARGINS)

_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_HEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


def _flags(text: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(text)] = True
    return table


_SYMBOL = _flags(b"#*$%&|<>")
_BANG = _flags(b"!?")
_UPPER = _flags(bytes(range(0x41, 0x5B)))
_LETTER = _UPPER | _flags(bytes(range(0x61, 0x7B)))
_WINDOW = np.array([3, 5, 7], np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeat_words(h: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice in that text."""
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        inside = doc[:-2] == doc[2:]
        key = h[:-2] * _WINDOW[0] + h[1:-1] * _WINDOW[1] + h[2:] * _WINDOW[2]
        key = mix64(key + mix64(doc[:-2].astype(np.uint64)))
        _, where, seen = np.unique(key[inside], return_inverse=True, return_counts=True)
        at = np.flatnonzero(inside)[seen[where] > 1]
        for k in range(3):
            covered[at + k] = True
    return _per_text(covered, first)


def _line_counts(c: Chunk, word_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, by text."""
    breaks = np.flatnonzero(c.data == 0x0A)
    start = np.union1d(c.offsets[:-1], breaks + 1)
    start = start[start < len(c.data)]
    end = np.concatenate([start[1:], [len(c.data)]])
    doc = np.searchsorted(c.offsets, start, "right") - 1
    end = end - (c.data[end - 1] == 0x0A)
    wordy = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end, doc = start[wordy], end[wordy], doc[wordy]
    key = mix64(hash_ranges(c.data, start, end) + mix64(doc.astype(np.uint64)))
    _, lead = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[lead] = False
    n = c.hi - c.lo
    return np.bincount(doc, minlength=n), np.bincount(doc, weights=again, minlength=n).astype(np.int64)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts and per mille rates of each text of a string column."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in _ALL}
    for c in chunks(texts):
        w = find_words(c)
        h = hash_ranges(c.data, w.start, w.end)
        n_words = np.diff(w.first)
        chars = _per_text(_SOLID[c.data] & _HEAD[c.data], c.offsets)
        symbols = _per_text(_SYMBOL[c.data], c.offsets)
        lines, dup = _line_counts(c, w.start)
        repeat = _repeat_words(h, w.doc, w.first)
        rate = lambda part, whole: 1000 * part // np.maximum(whole, 1)
        for k, v in zip(_ALL, (n_words, chars, symbols, dup, repeat, rate(symbols, chars),
                               rate(_per_text(_UPPER[c.data], c.offsets), _per_text(_LETTER[c.data], c.offsets)),
                               rate(_per_text(_BANG[c.data], c.offsets), chars), rate(dup, lines),
                               rate(repeat, n_words)), strict=True):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _measured(batches):
    for b in batches:
        m = measure(b.column(b.num_columns - 1))
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:-1], *(pa.array(m[k], pa.int64()) for k in _ALL)], [*b.schema.names[:-1], *_ALL])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``doc`` (a struct of all input columns but the text), counts and
    rates: whole texts, null as empty, read by one narrow task a partition."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    src = docs.select(F.struct(*rest).alias("doc"), F.col(text).cast("string").alias("_text"))
    return arrow_map(src, _measured, schema_with([src.schema["doc"]], ", ".join(f"{k} long" for k in _ALL)))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def rate_sketch(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable sketch: ``by..., rate, value, n``; counts combine map-side."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), F.col(k).alias("value")) for k in MARGINS)))
    return rows.select(*by, pairs.alias("p")).groupBy(*by, "p.rate", "p.value").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "rate", "value").agg(F.sum("n").alias("n"))


def _listed(sketch: DataFrame, by: list[str], name: str) -> DataFrame:
    """A sketch as one array for each ``by``, of bounded size."""
    return sketch.groupBy(*by).agg(F.collect_list(F.struct("rate", "value", "n")).alias(name))


def _dense(entries) -> np.ndarray:
    """Documents up to each grid value, by rate, of a listed sketch."""
    out = np.zeros((len(MARGINS), 1001))
    at = {k: i for i, k in enumerate(MARGINS)}
    for e in entries:
        out[at[e["rate"]], e["value"]] += e["n"]
    return np.cumsum(out, axis=1)


def blended(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Shares up to each grid value: a group's counts and PRIOR documents dealt
    as ``below`` says."""
    return (own + PRIOR * below) / (own[:, -1:] + PRIOR)


def upper_fences(share: np.ndarray) -> list[int]:
    low, high = ((share >= q - 1e-12).argmax(axis=1) for q in (0.25, 0.75))
    return [int(h + SPREAD * (h - x) + m) for x, h, m in zip(low, high, MARGINS.values())]


def adaptive_fences(rows: DataFrame) -> DataFrame:
    """``lang, source, fences``: the thresholds of every group of ``rows``
    (``lang, source`` and rates). Documents that fail the base rules are left
    out of the sketches."""
    sketch = rate_sketch(rows.where(~base_failed()), ["lang", "source"])
    sketch = staged(sketch, "quality-sketch")
    everything = _dense(merged(sketch, []).collect())  # at most 1,001 rows a rate
    whole = everything / np.maximum(everything[:, -1:], 1)

    def run(batches):
        for b in batches:
            out = [upper_fences(blended(_dense(own), blended(_dense(lang), whole)))
                   for own, lang in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["lang", "source", "limits"])

    lang = _listed(merged(sketch, ["lang"]), ["lang"], "shared").withColumnRenamed("lang", "l2")
    met = (_listed(sketch, ["lang", "source"], "own").join(lang, F.col("lang").eqNullSafe(F.col("l2")))
           .select("lang", "source", "own", "shared"))
    out = arrow_map(met, run, schema_with(met.schema.fields[:2], "limits array<long>"))
    names = F.array(*(F.lit(k) for k in MARGINS))
    return staged(out.select("lang", "source", F.map_from_arrays(names, "limits").alias("fences")), "quality-fences")


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (``lang, source``, counts, rates) with ``base_failed, kept``: the
    joined filter. A group without limits holds only base failures."""
    lim = limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("fences").alias("_f"))
    above = [F.col(k) > F.col("_f")[k] for k in MARGINS]
    bad = above[0]
    for x in above[1:]:
        bad = bad | x
    return (rows.join(lim, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False)))
            .drop("_l", "_s", "_f"))


def quality(docs: DataFrame) -> DataFrame:
    """Measure and judge ``docs(doc_id, text, lang, source, ...)``.

    Returns ``doc_id, lang, source``, the counts, the rates, ``base_failed`` and
    ``kept`` for every input row. Null or word-less text fails the base rules;
    null lang or source is a group of its own; repeated rows are judged one by
    one; other columns are ignored; an empty table gives no rows.
    """
    rows = staged(measured(docs.select("doc_id", "lang", "source", "text")).select("doc.*", *_ALL), "quality-rows")
    return judged(rows, adaptive_fences(rows))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with their own columns.

    Texts are measured twice, to learn the limits and to apply them, rather
    than shuffled to meet their verdicts."""
    seen = measured(docs.select("lang", "source", "text")).select("doc.*", *_ALL)
    limits = adaptive_fences(seen)
    rows = (docs.select(F.struct("*").alias("row"), "lang", "source", "text"))
    rows = measured(rows).select("doc.row", "doc.lang", "doc.source", *_ALL)
    return judged(rows, limits).where("kept").select("row.*")

"""Document fingerprints: a Merkle tree over sections and paragraphs.

A section ends with a blank line, a paragraph with a line break, and a paragraph
is cut into leaves by its content: after every word whose hash is a multiple of
``LEAF_WORDS``, and after ``LEAF_MOST`` words without such a one (a run of more than 64
characters without white space counts as several words). So an edit changes the
leaf it falls in, not those after it. Leaves hold every character, so equal
texts have equal trees. A paragraph's node hashes its leaves, a section's its
paragraphs and the root its sections: roots test equality, and where they
differ, the differing branches locate the edit.

A fingerprint is the tree as a string: ``root|sections|leaves`` with short codes
of the sections (``/`` between) and of the leaves (``.`` between leaves, ``;``
after a paragraph, ``/`` after a section). DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .secret_scan import settled

#: One word in so many ends a leaf; words of a leaf at most.
LEAF_WORDS, LEAF_MOST = 5, 16
_WORD = r"(?s)\S{1,64}+\s*+|\s++"
_LEAF = rf"(?s)(?:\S{{1,64}}+\s*+|\s++){{1,{LEAF_MOST}}}+"
# A cut is written into the text as two characters; the first is followed by
# another second one where the text has it itself.
_MARK, _CUT, _OWN = "\x01", "\x01\x03", "\x01\x02"
#: Hex digits of a leaf's or section's code in a fingerprint (32 bits).
CODE = 8
#: Rows of a range of ids that one window handles, ranges at most, and ranges
#: of a step of the two-step search for an id's range.
RANGE_ROWS, RANGES, STEP = 1_500, 4_096, 64
_FIRST = -(1 << 63)


def leaf_hashes(text: Column) -> Column:
    """Hashes of the leaves by section and paragraph: three nested arrays."""
    parts = lambda x, end: F.filter(F.split(x, end, -1), lambda p: p != "")
    every = lambda x, what: F.regexp_extract_all(x, F.lit(what), F.lit(0))

    def leaves(paragraph: Column) -> Column:
        ends = lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(LEAF_WORDS)) == 0, _CUT).otherwise("")
        marked = F.array_join(F.transform(every(paragraph, _WORD), lambda w: F.concat(w, ends(w))), "")
        return F.flatten(F.transform(F.split(marked, _CUT, -1), lambda x: every(x, _LEAF)))

    return F.transform(parts(F.replace(text, F.lit(_MARK), F.lit(_OWN)), r"(?<=\n\n)"), lambda section: F.transform(
        parts(section, r"(?<=\n)"), lambda paragraph: F.transform(leaves(paragraph), F.md5)))


def with_fingerprint(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``df`` with a fingerprint of each text column: ``{text: new column}``;
    a null text has the fingerprint of an empty one."""
    df = settled(df, **{f"_{new}": leaf_hashes(F.coalesce(F.col(text), F.lit(""))) for text, new in texts.items()})
    sections = {f"_{new}_s": F.transform(f"_{new}", lambda s: F.md5(F.array_join(
        F.transform(s, lambda p: F.md5(F.array_join(p, ""))), ""))) for new in texts.values()}
    df = settled(df, **sections)
    code = lambda h: F.substring(h, 1, CODE)
    out = {new: F.concat_ws(
        "|", F.sha2(F.array_join(f"_{new}_s", ""), 256), F.array_join(F.transform(f"_{new}_s", code), "/"),
        F.array_join(F.transform(f"_{new}", lambda s: F.array_join(F.transform(
            s, lambda p: F.array_join(F.transform(p, code), ".")), ";")), "/")) for new in texts.values()}
    return settled(df, **out).drop(*(f"_{new}" for new in texts.values()), *sections)


def same(a: Column, b: Column) -> Column:
    """Whether two fingerprints have the same root."""
    return F.substring(a, 1, 64) == F.substring(b, 1, 64)


def likeness(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with ``{name: (a, b)}`` the likeness of two fingerprints: twice
    the distinct leaves they share by the distinct leaves they have; 1 for equal
    roots."""
    columns = sorted({c for p in pairs.values() for c in p})
    codes = lambda c: F.array_distinct(F.filter(F.split(F.element_at(F.split(c, r"\|", -1), 3), "[./;]"), lambda x: x != ""))
    df = settled(df, **{f"_{c}_codes": codes(c) for c in columns})
    for name, (a, b) in pairs.items():
        x, y = F.col(f"_{a}_codes"), F.col(f"_{b}_codes")
        shared = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(x) + F.size(y), F.lit(1))
        df = df.withColumn(name, F.when(same(F.col(a), F.col(b)), F.lit(1.0)).otherwise(shared))
    return df.drop(*(f"_{c}_codes" for c in columns))


def differing(a: Column, b: Column) -> Column:
    """Where two fingerprints differ, as ``section, paragraph`` numbers from 0 in
    order; whole sections with equal codes are passed over, equal roots give
    an empty array."""
    leaves = lambda c: F.split(F.element_at(F.split(c, r"\|", -1), 3), "/", -1)
    pairs = F.zip_with(leaves(a), leaves(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def section(p: Column, i: Column) -> Column:
        both = F.zip_with(F.split(F.coalesce(p["x"], F.lit("")), ";", -1), F.split(F.coalesce(p["y"], F.lit("")), ";", -1),
                          lambda x, y: ~x.eqNullSafe(y))
        at = F.filter(F.transform(both, lambda d, j: F.when(d, j)), lambda j: j.isNotNull())
        return F.transform(at, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    found = F.flatten(F.transform(pairs, lambda p, i: F.when(~p["x"].eqNullSafe(p["y"]), section(p, i)).otherwise(
        F.array().cast("array<struct<section:int,paragraph:int>>"))))
    return F.when(same(a, b), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(found)


def _range_of(order: Column, cuts: Sequence[int]) -> Column:
    """Number of the cuts (ascending) up to ``order``, found in two steps."""
    fine = [cuts[k:k + STEP] for k in range(0, len(cuts), STEP)]
    up_to = lambda xs: F.size(F.filter(xs, lambda c: c <= order))
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)) if xs else F.array().cast("array<long>")
    if not fine:
        return F.lit(0)
    block = F.greatest(up_to(longs([f[0] for f in fine])) - 1, F.lit(0))
    return block * STEP + up_to(F.get(F.array(*(longs(f) for f in fine)), block))


def with_next(docs: DataFrame, columns: Sequence[str], prepare) -> DataFrame:
    """Rows of ``docs(doc_id, text)`` after ``prepare``, each with ``next_<c>`` of
    ``columns`` from the row after it in order of doc_id (null first), ties by
    text; the last is followed by the first.

    Ids are cut into ranges of about equal row counts at approximate quantiles.
    Every range is ordered by itself and ends with a copy of the first row of the
    range after it, so no task sees more than a few ranges and texts are
    shuffled once.
    """
    order = F.coalesce("doc_id", F.lit(_FIRST).cast("long"))
    n = docs.count()
    ranges = max(1, min(RANGES, -(-n // RANGE_ROWS)))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = docs.select(F.percentile_approx(order, shares, 10_000)).first()[0] if n and shares else []
    cuts = sorted(set(cuts or []))
    dealt = docs.withColumn("_order", order).withColumn("_range", _range_of(order, cuts))
    heads = sorted((r._range, r.head) for r in dealt.groupBy("_range").agg(F.min("_order").alias("head")).collect())
    after = docs.sparkSession.createDataFrame(
        [(heads[k][0], heads[(k + 1) % len(heads)][1]) for k in range(len(heads))], "_before int, _head long")
    tie = F.xxhash64("text")
    firsts = (dealt.join(F.broadcast(after), F.col("_order") == F.col("_head")).drop("_range")  # at most RANGES rows
              .withColumn("_nth", F.row_number().over(Window.partitionBy("_before").orderBy(tie, "text")))
              .where("_nth = 1").withColumnRenamed("_before", "_range").select(*dealt.columns))
    rows = (prepare(dealt).withColumn("_copy", F.lit(False))
            .unionByName(prepare(firsts).withColumn("_copy", F.lit(True))).withColumn("_tie", tie))
    in_order = Window.partitionBy("_range").orderBy("_copy", "_order", "_tie")
    return (rows.select("*", *(F.lead(c).over(in_order).alias(f"next_{c}") for c in columns))
            .where(~F.col("_copy")).drop("_copy", "_order", "_tie", "_range"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text, fingerprint`` of all rows of ``docs(doc_id, text, ...)``;
    null text is empty; repeated rows have equal fingerprints."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_fingerprint(texts, {"text": "fingerprint"})


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id long, text, ...)`` and of an edit of each
    text: its last quarter (code points, rounded down) replaced by as much from
    the start of the next document, or all of that where it is shorter.

    Returns ``doc_id, n_chars, edited, fingerprint, edited_fingerprint,
    near_edited, near_next`` for every row. Null text is empty, a null doc_id
    comes first, rows of one doc_id follow each other; a single row is its own
    next; other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(texts, ["text", "fingerprint"], lambda df: with_fingerprint(df, {"text": "fingerprint"}))
    n = F.length("text")
    gone = F.floor(n / 4).cast("int")
    rows = settled(rows, n_chars=n.cast("long"), edited=F.concat(
        F.substring(F.col("text"), F.lit(1), n - gone), F.substring(F.col("next_text"), F.lit(1), gone)))
    rows = with_fingerprint(rows.drop("text", "next_text"), {"edited": "edited_fingerprint"})
    rows = likeness(rows, {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "next_fingerprint")})
    return rows.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

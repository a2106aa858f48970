import bisect
import collections
import functools
import random
import re
from fractions import Fraction

import duckdb

from pyspark.sql import functions as F

from cases import edge_docs, edge_rows, no_docs
from conftest import SMOKE
from corpuslens.llm import catalog
from corpuslens.llm.quality import COUNTS, MARGINS, PRIOR, SPREAD, adaptive_fences, base_failed, measured, merged, quality, quality_filter, rate_sketch

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = set()
    for k, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            repeated.update((k, k + 1, k + 2))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def rates(text):
    n, chars, symbols, dup, repeat = counts(text)
    text = text or ""
    lines = sum(1 for x in text.split("\n") if WORD.search(x))
    part = lambda a, b: 1000 * a // max(b, 1)
    return dict(symbol_rate=part(symbols, chars), upper_rate=part(len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))),
                bang_rate=part(len(re.findall("[!?]", text)), chars), dup_line_rate=part(dup, lines), repeat_rate=part(repeat, n))


def brute_force(rows):
    """Verdicts of (lang, source, text) rows: quantiles of a group's documents and
    PRIOR more that are dealt as in its language, that likewise, in fractions."""
    failed = [counts(t)[0] < 50 or 100 * counts(t)[4] > 50 * counts(t)[0] for _, _, t in rows]
    own = [rates(t) for _, _, t in rows]
    groups = {}
    for k, (lang, source, _) in enumerate(rows):
        if not failed[k]:
            for g in ((lang, source), lang, "all"):
                groups.setdefault(g, []).append(k)

    @functools.cache
    def fence(lang, source, rate):
        some = [sorted(own[k][rate] for k in groups[g]) for g in ((lang, source), lang, "all")]

        def share(v, n=0):
            upto = bisect.bisect_right(some[n], v)
            if n == 2:
                return Fraction(upto, len(some[n]))
            return (upto + PRIOR * share(v, n + 1)) / (len(some[n]) + PRIOR)

        low, high = (next(v for v in sorted(set(some[2])) if share(v) >= Fraction(q, 4)) for q in (1, 3))
        return high + SPREAD * (high - low) + MARGINS[rate]

    out = [not failed[k] and all(own[k][r] <= fence(lang, source, r) for r in MARGINS) for k, (lang, source, _) in enumerate(rows)]
    return failed, out


def test_twin_is_the_formula_of_the_query(spark):
    """Groups of 1 to 900 documents, whose rates differ by group."""
    rng = random.Random(8)
    rows = []
    for g, (lang, source, n) in enumerate([("en", "a", 199), ("en", "b", 200), ("en", "c", 900), ("de", None, 30), ("de", "a", 1), (None, "a", 30)]):
        for k in range(n):
            words = [f"{rng.choice('WXwx')}{rng.randrange(10**6)}{'#' if rng.random() < 0.02 * g else ''}" for _ in range(rng.randrange(48, 70))]
            if rng.random() < 0.15:  # at and around the fences
                words = [w + rng.choice("!#") * rng.randrange(4) for w in words]
            if rng.random() < 0.3:
                words += words[:rng.randrange(3, 30)]
            lines = [" ".join(words[:30]), " ".join(words[30:])] + ["once more"] * rng.choice([0, 0, 1, 3, 6])
            rows.append((lang, source, "\n".join(lines)))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality(df).collect()}
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    cursor = con.execute(catalog.ORACLES["op6_quality"])
    names = [c[0] for c in cursor.description]
    twin = {r[names.index("doc_id")]: (r[names.index("base_failed")], r[names.index("kept")]) for r in cursor.fetchall()}
    assert twin == got == dict(enumerate(zip(*brute_force(rows))))
    assert 0.02 < sum(not kept and not failed for failed, kept in got.values()) / len(rows) < 0.9


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: (r.lang, r.source, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    failed, kept = (dict(zip(docs, x)) for x in brute_force(list(docs.values())))
    rows = catalog.QUERIES["op6_quality"](spark, SMOKE).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == counts(docs[r.doc_id][2])
        assert (r.base_failed, r.kept) == (failed[r.doc_id], kept[r.doc_id])


def test_groups_adapt_and_small_ones_borrow(spark):
    plain = "all the plain words of one text number so and so on for a good while " * 4
    text = lambda k, extra: " ".join(f"{w}{k}{j}" for j, w in enumerate(plain.split()[:56])) + extra * 30
    rows = [("en", "calm", text(k, "")) for k in range(250)] + [("en", "tables", text(k, " |")) for k in range(250)]
    rows += [("en", "calm", text(999, " |")), ("en", "tiny", text(998, " |||")), (None, None, text(997, ""))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    got = {r.doc_id: r.kept for r in quality(df).collect()}
    assert [got[k] for k in range(len(rows))] == brute_force(rows)[1]
    assert got[300] and not got[500] and got[502]  # bars are usual in one source only


def test_edge_rows(spark):
    rows = quality(edge_docs(spark)).collect()
    texts = edge_rows()
    assert sorted((str(r.doc_id), *(r[c] for c in COUNTS)) for r in rows) == sorted((str(i), *counts(t)) for i, t, *_ in texts)
    assert all(r.base_failed and not r.kept for r in rows)
    assert quality_filter(edge_docs(spark)).columns == edge_docs(spark).columns
    assert quality_filter(edge_docs(spark)).count() == 0
    assert quality(no_docs(spark)).count() == 0 and quality_filter(no_docs(spark)).count() == 0


def test_filter_agrees_with_the_operator(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    kept = {r.doc_id for r in quality(docs).where("kept").collect()}
    assert {r.doc_id for r in quality_filter(docs).collect()} == kept


def test_sketches_merge_exactly(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select("lang", "source", "text")
    rows = measured(docs).select("doc.*", *MARGINS, *COUNTS).where(~base_failed())
    by_source = merged(rate_sketch(rows, ["lang", "source"]), ["lang"])
    whole = rate_sketch(rows, ["lang"])
    assert by_source.exceptAll(whole).count() == 0 and whole.exceptAll(by_source).count() == 0
    assert whole.agg(F.max("value")).first()[0] <= 1000


def test_limits_follow_one_formula_at_every_size(spark):
    """Fences against quantiles of weighted documents, in fractions."""
    rng = random.Random(4)
    groups = {("en", "a"): 199, ("en", "b"): 200, ("en", "c"): 900, ("de", None): 30, ("de", "a"): 1, (None, "a"): 7}
    rows = [(*g, 60, 0, *(rng.randrange(top * (k % 3 + 1)) for top in (90, 300, 20, 310, 333)))
            for k, (g, n) in enumerate(groups.items()) for _ in range(n)]
    df = spark.createDataFrame(rows, "lang string, source string, n_words long, n_repeat_words long, " + ", ".join(f"{r} long" for r in MARGINS))
    got = {(r.lang, r.source): r.fences for r in adaptive_fences(df).collect()}
    assert set(got) == set(groups)
    for g in groups:
        own, lang = [r for r in rows if r[:2] == g], [r for r in rows if r[0] == g[0]]
        for k, rate in enumerate(MARGINS, 4):
            share = lambda of, v: Fraction(sum(r[k] <= v for r in of), len(of))  # noqa: E731, B023

            def mixed(v):
                below = (len(lang) * share(lang, v) + PRIOR * share(rows, v)) / (len(lang) + PRIOR)  # noqa: B023
                return (len(own) * share(own, v) + PRIOR * below) / (len(own) + PRIOR)  # noqa: B023

            values = sorted({r[k] for r in rows})
            low, high = (next(v for v in values if mixed(v) >= Fraction(q, 4)) for q in (1, 3))
            assert got[g][rate] == high + SPREAD * (high - low) + MARGINS[rate]


def test_a_source_is_not_dropped_whole_for_one_document_less(spark):
    text = lambda k, extra: " ".join(f"w{k}x{j}" for j in range(56)) + extra * 30
    rows = [("en", "calm", text(k, "")) for k in range(1500)]
    rows += [("en", f"tables{n}", text(f"{n}y{k}", " |")) for n in (199, 200) for k in range(n)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    kept = {(r.source, r.kept) for r in quality(df).select("source", "kept").distinct().collect()}
    assert kept == {("calm", True), ("tables199", True), ("tables200", True)}

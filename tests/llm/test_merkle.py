import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from cases import edge_docs, edge_rows, no_docs
from conftest import SMOKE
from corpuslens.llm import catalog, merkle
from corpuslens.llm.merkle import differing, edited_fingerprints, fingerprints, with_fingerprint, with_next

md5 = lambda x: hashlib.md5(x.encode()).hexdigest()


def signed(word):
    h = xxhash.xxh64_intdigest(word.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def brute_force(text):
    """The same tree, cut and hashed in plain Python."""
    space = "[ \t\n\x0b\f\r]"
    token = f"(?:[^ \t\n\x0b\f\r]{{1,64}}{space}*|{space}+)"
    text = text.replace("\x01", "\x01\x02")
    out = []

    def leaves(paragraph):
        held = []
        for m in re.finditer(token, paragraph):
            held.append(m[0])
            if signed(m[0]) % merkle.LEAF_WORDS == 0 or len(held) == merkle.LEAF_MOST:
                yield "".join(held)
                held = []
        if held:
            yield "".join(held)

    for section in re.split(r"(?<=\n\n)", text):
        paragraphs = [p for p in re.split(r"(?<=\n)", section) if p]
        if paragraphs:
            out.append([[md5(x) for x in leaves(p)] for p in paragraphs])
    tops = [md5("".join(md5("".join(p)) for p in s)) for s in out]
    root = hashlib.sha256("".join(tops).encode()).hexdigest()
    n = merkle.CODE
    leaves = "/".join(";".join(".".join(h[:n] for h in p) for p in s) for s in out)
    return "|".join([root, "/".join(t[:n] for t in tops), leaves])


def likeness(a, b):
    if a.split("|")[0] == b.split("|")[0]:
        return 1.0
    x, y = ({c for c in re.split("[./;]", f.split("|")[2]) if c} for f in (a, b))
    return 2 * len(x & y) / max(len(x) + len(y), 1)


def check(rows, docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0]))
    texts = [t or "" for _, t in order]
    assert len(rows) == len(order)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for k, (d, _) in enumerate(order):
        if len(by[d]) > 1:
            continue  # rows of one id are in order of a hash, see the ties test
        text, after, r = texts[k], texts[(k + 1) % len(texts)], by[d][0]
        if len({t for i, t in docs if i == order[(k + 1) % len(order)][0]}) > 1:
            continue
        gone = len(text) // 4
        edited = text[:len(text) - gone] + after[:gone]
        assert r.n_chars == len(text) and r.fingerprint == brute_force(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.edited_fingerprint == brute_force(edited)
        assert abs(r.near_edited - likeness(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - likeness(r.fingerprint, brute_force(after))) < 1e-12


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    check(catalog.QUERIES["op10_fingerprints"](spark, SMOKE).collect(), docs)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 1)
    monkeypatch.setattr(merkle, "STEP", 4)
    docs = [(k * k, f"text {k}\nand more of it {k}\n\nend {k % 3}") for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(edited_fingerprints(df).withColumn("edited_sha256", F.sha2("edited", 256)).collect(), docs)


def test_edge_rows(spark):
    docs = [(i, t) for i, t, *_ in edge_rows()]
    check(edited_fingerprints(edge_docs(spark)).withColumn("edited_sha256", F.sha2("edited", 256)).collect(), docs)
    assert edited_fingerprints(no_docs(spark)).count() == 0 and fingerprints(no_docs(spark)).count() == 0
    one = edited_fingerprints(spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.edited == "a b c d e f a b" and one.near_next == 1.0


def test_ties_are_followed_once(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 1)
    df = spark.createDataFrame([(k // 4, f"t{k % 3}") for k in range(20)] + [(None, "n")] * 3, "doc_id long, text string")
    rows = with_next(df, ["text"], lambda d: d).collect()
    assert len(rows) == 23  # every row has one successor and each row is one's successor
    assert sorted(r.text for r in rows) == sorted(r.next_text for r in rows)


def test_equal_texts_and_located_edits(spark):
    lines = [f"line {k} of this text, all of it" for k in range(9)]
    lines[4] += "\n"  # a blank line: two sections
    other = list(lines)
    other[6] = "line 6 of that text, all of it"
    rows = [("\n".join(lines), "\n".join(lines)), ("\n".join(lines), "\n".join(other)), (None, "")]
    df = with_fingerprint(spark.createDataFrame(rows, "a string, b string"), {"a": "x", "b": "y"})
    got = [[(d.section, d.paragraph) for d in r.d] for r in df.select(differing(F.col("x"), F.col("y")).alias("d")).collect()]
    assert got == [[], [(1, 1)], []]


def test_main_path_is_native(spark):
    plan = edited_fingerprints(spark.read.parquet(f"{SMOKE}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "SinglePartition" not in plan


def test_one_word_more_changes_one_leaf(spark):
    """A word put before, into or after a paragraph of 1,000 words leaves the
    other leaves as they are; equal words in a row are cut as well."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    base, same = " ".join(words), "wort " * 5000
    rows = [(base, "one " + base), (base, " ".join([*words[:500], "one", *words[500:]])), (base, base + " one"), (same, same + "ende"),
            ("x \x01y", "x y"), ("a\x01\x03b", "ab")]
    df = with_fingerprint(spark.createDataFrame(rows, "a string, b string"), {"a": "x", "b": "y"})
    got = merkle.likeness(df, {"near": ("x", "y")}).collect()
    assert all(r.x == brute_force(r.a) and r.y == brute_force(r.b) for r in got)
    assert all(r.near > 0.95 for r in got[:3]) and got[3].near > 0.4
    assert all(r.x != r.y for r in got)

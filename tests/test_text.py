"""Text helpers equal Python's str/re behaviour on strings rich in edge characters."""

import random
import re


from corpuslens.functions import text as T
from corpuslens.operators import docs as D

ALPHABET = list("ab #`\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000\u00e9_.()[]/") + ["\r\n"]


def _strings(n=400, seed=7):
    rnd = random.Random(seed)
    out = ["", " ", "\n", "# x", "#\n\nnext", "a\r\nb", "x y"]
    for _ in range(n):
        out.append("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))))
    return out


def _frame(spark, strings):
    return spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")


def test_strip_and_splitlines_follow_python(spark):
    strings = _strings()
    got = _frame(spark, strings).select("i", T.strip_("s").alias("strip"), T.splitlines_("s").alias("lines")).collect()
    for r in got:
        assert r["strip"] == strings[r["i"]].strip() and list(r["lines"]) == strings[r["i"]].splitlines()


# text; collapsed white space; squeezed blank lines; header lines; cleaned code; question
WRITTEN = [
    ("a  b\t\nc", "a b c", "a  b\t\nc", [], "a  b\nc", "a  b\t\nc"),
    ("# T\n\n \n\n## S  \nx # y\n", "# T ## S x # y ", "# T\n\n## S  \nx # y\n", ["# T", "## S"], "x", "# T\n\n \n\n## S  \nx # y"),
    ("  x = '#no'\r\n\r\n# all\r\ny", " x = '#no' # all y", "  x = '#no'\r\n\n# all\r\ny", ["# all"], "x = '\ny",
     "x = '#no'\r\n\r\n# all\r\ny"),
    ("", "", "", [], "", ""),
    (" caf\u00e9\u00a0\u2028#z ", " caf\u00e9 #z ", " caf\u00e9\u00a0\u2028#z ", ["#z"], "caf\u00e9", "caf#z"),
]


def test_cleaning_of_written_texts(spark):
    df = _frame(spark, [w[0] for w in WRITTEN]).select(
        "i", T.collapse_ws("s").alias("collapse"), T.squeeze_blank_lines("s").alias("squeeze"),
        T.header_lines("s").alias("headers"), T.strip_comments_and_blank_lines("s").alias("clean"), T.preprocess_query("s").alias("pre"))
    for r in df.collect():
        assert (r["collapse"], r["squeeze"], list(r["headers"]), r["clean"], r["pre"]) == WRITTEN[r["i"]][1:]


HEADINGS = [
    ("# Title\n## Sub  \n####### seven\n#x\n#\n\nnext line\n", ["Title", "Sub", "next line"]),
    ("no heading\n ## indented\ntext # late", []),
    ("#\tTab\n###### six\n# a # b", ["Tab", "six", "a # b"]),
    ("# one\r\n# two\r\n", ["one", "two"]),
    ("#  \u00a0caf\u00e9\u2003 \n#\u00a0nbsp", ["caf\u00e9", "nbsp"]),
    ("```\n# in code\n```\n#", ["in code"]),
    ("", []), ("#", []), ("# ", []), ("#\n\n\n", []),
]


def test_headings_of_written_texts(spark):
    df = _frame(spark, [h[0] for h in HEADINGS]).select("i", D.sections("s").alias("sec"))
    for r in df.collect():
        assert list(r["sec"]) == HEADINGS[r["i"]][1], HEADINGS[r["i"]]

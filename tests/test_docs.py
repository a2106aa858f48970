"""Documentation record extraction on a hand-made page."""

from corpuslens.operators import docs as D

PAGE = (
    "# Title\r\n"
    "Intro with `pkg.mod.func` and `plain` and `a.b` again `a.b`.\n"
    "\n   \n"
    "## Links\n"
    "See [API guide](https://x.org/API/v1) and [home](https://x.org/) and [Docs](/Documentation).\n"
    "```python\n"
    "# comment heading\n"
    "from os.path import join\n"
    "import numpy\n"
    "class Widget:\n"
    "    def render(self):\n"
    "        pass\n"
    "```\n"
    "#nospace\n"
)


def test_doc_record(spark):
    df = spark.createDataFrame([("d/a.md", PAGE)], "file_path string, raw_content string")
    docs, bad = D.parse_docs(df)
    r = docs.collect()[0]
    assert list(r["sections"]) == ["Title", "Links", "comment heading"]
    assert list(r["api_references_arr"]) == sorted({
        "os.path", "join", "numpy", "Widget", "render", "pkg.mod.func", "a.b",
        "API guide (https://x.org/API/v1)", "Docs (/Documentation)"})
    assert r["api_references"] == ", ".join(r["api_references_arr"])
    assert "\n\n## Links" in r["cleaned_content"] and "\n   \n" not in r["cleaned_content"]
    assert r["embedding_id"] == -1 and r["type"] == "DocumentationFile.class"
    assert bad.count() == 0


def test_strict_six_backticks_quarantined(spark):
    df = spark.createDataFrame([("d/a.md", "# T\n``````\n"), ("d/b.md", "# U\n")],
                               "file_path string, raw_content string")
    docs, bad = D.parse_docs(df, strict=True)
    assert [r["file_path"] for r in docs.collect()] == ["d/b.md"]
    assert [r["file_path"] for r in bad.collect()] == ["d/a.md"]


def test_header_lines_and_collapse(spark):
    df = spark.createDataFrame([("#a\n  # b\n# c \n",)], "t string")
    r = df.select(D.extract_sections("t").alias("h"), D.preprocess_documentation("t").alias("c")).first()
    assert list(r["h"]) == ["#a", "# c"]
    assert r["c"] == "#a # b # c "

"""Reply reading ladder, classification and prompts."""

from corpuslens.operators import questions as Q


def test_reply_ladder(spark):
    qs = [(i, t) for i, t in enumerate([
        "What does function foo() do?",      # 0 valid reply
        "doc for Bar",                       # 1 fenced reply
        "module Baz",                        # 2 single quotes
        "code foo()",                        # 3 missing key -> fallback
        "  Docker Thing  ",                  # 4 no reply -> fallback, 'doc' wins
        "hello",                             # 5 truncated -> fallback Invalid
        "function x",                        # 6 code-related with nothing -> rejected
        "function y",                        # 7 trailing junk -> fallback
    ])]
    rs = [(0, '{"functions": ["foo"], "modules": [], "classification": "code-related"}'),
          (1, '```json\n{"functions": [], "modules": ["Bar"], "classification": "documentation-related"}\n```'),
          (2, "{'functions': [], 'modules': ['Baz'], 'classification': 'code-related'}"),
          (3, '{"functions": ["foo"], "classification": "code-related"}'),
          (4, None),
          (5, '{"functions": ['),
          (6, '{"functions": [], "modules": [], "classification": "code-related"}'),
          (7, '{"functions": ["y"], "modules": [], "classification": "code-related"} extra')]
    q = spark.createDataFrame(qs, "query_id long, query_text string")
    r = spark.createDataFrame(rs, "query_id long, text string")
    got = {x["query_id"]: x for x in Q.read_replies(q, r).collect()}
    assert (got[0]["status"], list(got[0]["functions"]), got[0]["classification"]) == \
           ("reply", ["foo"], "code-related")
    assert (got[1]["status"], list(got[1]["modules"])) == ("reply", ["Bar"])
    assert (got[2]["status"], list(got[2]["modules"])) == ("reply", ["Baz"])
    assert (got[3]["status"], list(got[3]["functions"]), got[3]["classification"]) == \
           ("fallback", ["foo"], "code-related")
    assert (got[4]["status"], got[4]["query"], got[4]["classification"], list(got[4]["modules"])) == \
           ("fallback", "Docker Thing", "documentation-related", ["Docker", "Thing"])
    assert (got[5]["status"], got[5]["classification"]) == ("fallback", "Invalid")
    assert (got[6]["status"], got[6]["classification"]) == ("rejected", None)
    assert got[7]["status"] == "fallback"
    strict = {x["query_id"]: x for x in Q.read_replies(q, r, strict=True).collect()}
    assert (list(strict[3]["functions"]), strict[3]["classification"]) == (["foo()"], "code")


def test_preprocess_classify_heuristics(spark):
    df = spark.createDataFrame([(" été Run() and Go_2 x() Doc ",)], "t string")
    r = df.select(Q.preprocess_query("t").alias("p")).select(
        "p", Q.classify("p").alias("c"), Q.heuristic_functions("p").alias("f"),
        Q.heuristic_modules("p").alias("m")).first()
    assert r["p"] == "t Run() and Go_2 x() Doc"
    assert r["c"] == "documentation"
    assert list(r["f"]) == ["Run()", "x()"]
    assert list(r["m"]) == ["Run", "Go_2", "Doc"]


def test_clean_response(spark):
    df = spark.createDataFrame([("```json\n {\"a\": 1} \n```",), ("x```",), ("```jsonx",)], "t string")
    got = [r[0] for r in df.select(Q.clean_response("t")).collect()]
    assert got == ['{"a": 1}', "x", "x"]

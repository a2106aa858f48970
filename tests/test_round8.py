"""Names that stay off the driver."""

import re

from corpuslens.operators import code as C
from corpuslens.operators import questions as Q


def test_parsed_names_are_not_broadcast_on_an_estimate(spark):
    source = "class Tree:\n    def grow(self):\n        pass\ndef cut(x):\n    return x\n"
    code, _ = C.parse_code(spark.createDataFrame([("a.py", source), ("b.py", "def cut(y):\n    pass\n")], "file_path string, raw_code string"))
    asked = spark.createDataFrame([(1, "may cut() grow a Tree, or cut it?"), (2, "nothing known"), (3, None)], "query_id long, query string")
    found = Q.extraction_prompts(asked, code)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[name", plan) and re.search(r"SortMergeJoin(\(skew=true\))? \[name", plan), plan
    got = {r.query_id: r.prompt for r in found.collect()}
    assert '"function": [\n    "cut",\n    "grow"\n  ],\n  "class": [\n    "Tree"\n  ]' in got[1]
    assert '"function": [],\n  "class": []' in got[2] and got[3] is None

"""Python extraction (B1-B10) on a golden module, plus malformed input."""

from corpuslens.operators import code as C

SRC = '''"""Module doc."""
import a.b as c
from . import x
from ..p.q import r
from m import *
G = H = 1
t1, t2 = 1, 2
ann: int = 3
aug = 0
aug += 1

class K(Base, pkg.Mix, Gen[int], metaclass=Meta):
    """Class doc."""
    attr = 5

    @property
    @deco.attr
    @called(1)
    def meth(self, v=default()):
        """Meth doc."""
        self.n()
        a.b.c()
        h()()
        def inner():
            inner_call()
        return obj.attr()

async def co():
    await other()

def top():
    pass
'''


def test_golden_module(spark):
    df = spark.createDataFrame([("pkg/a.py", SRC)], "file_path string, raw_code string")
    code, bad = C.parse_code(df)
    assert bad.count() == 0
    r = code.collect()[0]
    ents = [(e["name"], e["type"], e["line_number"], e["docstring"], list(e["decorators"]),
             list(e["parents"])) for e in r["entities"]]
    # breadth-first: K and top (depth 1; async co is not a function), meth
    # (depth 2), inner (depth 3)
    assert ents == [
        ("K", "class", 12, "Class doc.", [], ["Base", "Mix"]),
        ("top", "function", 31, None, [], []),
        ("meth", "function", 19, "Meth doc.", ["property", "attr"], []),
        ("inner", "function", 24, None, [], []),
    ]
    calls = [(c["caller"], c["callee"], c["line_number"]) for c in r["function_calls"]]
    # breadth-first under each def; decorator and default-argument calls count;
    # a.b.c() and the outer call of h()() are dropped; inner's call also
    # counts for meth
    assert calls == [
        ("meth", "called", 18), ("meth", "default", 19), ("meth", "self.n", 21),
        ("meth", "obj.attr", 26), ("meth", "h", 23), ("meth", "inner_call", 25),
        ("inner", "inner_call", 25),
    ]
    assert list(r["imports"]) == ["a.b", ".x", "p.q.r", "m.*"]
    gv = [(g["name"], g["line_number"]) for g in r["global_variables"]]
    assert gv == [("G", 6), ("H", 6), ("aug", 9), ("attr", 14)]
    assert list(r["docstrings"]) == ["Class doc.", "Meth doc."]
    assert r["type"] == "CodeFile.class" and r["cleaned_code"] is None


def test_malformed_files_go_to_quarantine(spark):
    rows = [("ok.py", "x = 1\n"), ("syntax.py", "def f(:\n"), ("nul.py", "x = 1\x00\n"),
            ("none.py", None)]
    df = spark.createDataFrame(rows, "file_path string, raw_code string")
    code, bad = C.parse_code(df)
    assert [r["file_path"] for r in code.collect()] == ["ok.py"]
    errs = {r["file_path"]: r["error"] for r in bad.collect()}
    assert set(errs) == {"syntax.py", "nul.py", "none.py"}
    assert errs["syntax.py"].startswith("SyntaxError")


def test_clean_code(spark):
    df = spark.createDataFrame([("  x = '#no'  # c\n\n\ty = 2\r\n",)], "t string")
    assert df.select(C.clean_code("t").alias("c")).first()["c"] == "x = '\ny = 2"


NESTED = """\
def outer(a=first()):
    mod.load(x)

    def inner():
        helper(deep(1))
        self.a.b()
    class K:
        def method(self):
            inner()
    return last()
call_at_top()
"""


def test_calls_of_nested_functions():
    got = [(c["caller"], c["callee"], c["line_number"]) for c in C.extract_python("n.py", NESTED)["function_calls"]]
    assert sorted(got) == sorted([
        ("outer", "first", 1), ("outer", "mod.load", 2), ("outer", "helper", 5), ("outer", "deep", 5),
        ("outer", "inner", 9), ("outer", "last", 10), ("inner", "helper", 5), ("inner", "deep", 5), ("method", "inner", 9)])


def test_calls_of_generated_sources():
    """Sources laid out from a known nesting: a call belongs to every function
    that encloses it."""
    import random
    rng = random.Random(8)
    for n in range(60):
        lines, want = [], []

        def body(depth, enclosing):
            for _ in range(rng.randrange(1, 4)):
                kind = rng.choice(["call", "method", "def"]) if depth < 4 else "call"
                pad = "    " * depth
                name = f"n{len(lines)}"
                if kind == "def":
                    lines.append(f"{pad}def {name}():")
                    body(depth + 1, [*enclosing, name])
                else:
                    target = name if kind == "call" else f"obj.{name}"
                    lines.append(f"{pad}{target}()")
                    want.extend((f, target, len(lines)) for f in enclosing)

        body(0, [])
        got = [(c["caller"], c["callee"], c["line_number"]) for c in C.extract_python("g.py", "\n".join(lines))["function_calls"]]
        assert sorted(got) == sorted(want), n

"""Few pairs in double precision, tokens hashed once, records built by fields."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.operators import code as C
from corpuslens.operators import vectors as V


@pytest.mark.parametrize("n", [8, 64, 4096])
@pytest.mark.parametrize("share", [0.0, 0.001, 0.5, 1.0])
def test_places_are_those_of_the_true_flags(n, share):
    flags = np.random.default_rng(n).random(n) < share
    assert V._places(flags).tolist() == np.flatnonzero(flags).tolist()


@pytest.mark.parametrize("decimals", [9, None])
def test_few_pairs_are_compared_in_double_precision(decimals, monkeypatch):
    rng = np.random.default_rng(5)
    vectors, queries = rng.random((4001, 16)), rng.random((130, 16))
    seen, real = [], V._least_pairs
    monkeypatch.setattr(V, "BLOCK_CELLS", 1 << 14)  # slices of queries, the last one shorter
    monkeypatch.setattr(V, "_least_pairs", lambda key, *rest: seen.append(key.size) or real(key, *rest))
    cell = V._Cell(16, 2, decimals, False)
    cell.add_queries(pa.record_batch({"vec": pa.array(queries.tolist()), "query_id": pa.array(np.arange(130))}))
    cell.add_vectors(pa.record_batch({"vec": pa.array(vectors.tolist()), "embedding_id": pa.array(np.arange(4001))}))
    assert sum(seen) <= 130 * 4001 / 20
    got = cell.result().to_pydict()
    for q in range(130):
        key = V._rank_key(((vectors - queries[q]) ** 2).sum(axis=1), decimals)
        want = np.lexsort((np.arange(4001), key))[:2]
        assert [e for e, i in zip(got["embedding_id"], got["query_id"]) if i == q] == want.tolist()


def test_a_token_that_repeats_is_hashed_once(monkeypatch):
    hashed, real = [], hashlib.md5
    monkeypatch.setattr(V.hashlib, "md5", lambda t, **kw: hashed.append(t) or real(t, **kw))
    rows = [["a", "é", "a"], None, [], ["a", "b", "", "a", "b"]] * 100
    fn = V._token_counts_fn(8, "embedding", ["embedding"])
    got = pa.Table.from_batches(fn([pa.record_batch({"_read": pa.array(rows, pa.list_(pa.string()))})]))["embedding"].to_pylist()
    assert sorted(hashed) == sorted(t.encode() for t in ("a", "é", "b", ""))
    for row, vec in zip(rows, got):
        if row is None:
            assert vec is None
            continue
        want = np.zeros(8)
        for t in row:
            want[int(real(t.encode()).hexdigest()[:8], 16) % 8] += 1
        assert vec == (want / (np.linalg.norm(want) or 1)).astype(np.float32).tolist()


def test_embedded_tokens_are_those_of_the_expression(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, ["x", "y", "x", "ß"]), (2, []), (3, None), (4, [f"t{i}" for i in range(20)])], "id long, tokens array<string>")
    got = V.HashedEmbedder(16, max_tokens=7).embed_tokens(df, "tokens", keys=["id"])
    bucket = F.transform(F.slice("tokens", 1, 7), lambda x: F.pmod(F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"), F.lit(16)))
    for r in got.join(df.select("id", bucket.alias("b")), "id").collect():
        if r.b is None:
            assert r.embedding is None
            continue
        want = np.bincount(np.array(r.b, dtype=np.int64), minlength=16).astype(float)
        assert r.embedding == (want / (np.linalg.norm(want) or 1)).astype(np.float32).tolist()


def test_records_are_those_of_arrow():
    source = 'import os\nx = y = 1\nclass A(B, c.D):\n    """Doc."""\n    @p.q\n    def f(self, a=g()):\n        return h(a).k()\n'
    one = C.extract_python("a.py", source)
    for field, kind in C._EXTRACTED.items():
        if field not in ("imports", "error"):
            rows = [one[field], None, [], one[field]]
            assert C._records(rows, kind).equals(pa.array(rows, kind))
    assert C._records([None, []], C._EXTRACTED["entities"]).equals(pa.array([None, []], C._EXTRACTED["entities"]))


def test_fields_passed_over_hold_nothing():
    import ast
    source = ("type X = Y[int]\ntry:\n    pass\nexcept E as e:\n    f1()\nmatch f2():\n    case {'a': P(b=1), **rest} if f3(): f4()\n"
              "    case [*s] | (1 as t): f5()\nx: int = f6(k=f7())\nx += -f8() if not f9() < f10() <= 2 else f'{f11()!r:{f12()}}'\n"
              "def g[T: f13()](a: f14() = f15(), *b, **c) -> f16():\n    global z\n    return [q async for q in f17()]\n")
    wrapped = "def outer():\n" + "".join("    " + line + "\n" for line in source.splitlines())
    got = {c["callee"] for c in C.extract_python("a.py", wrapped)["function_calls"] if c["caller"] == "outer"}
    want = {n.func.id for n in ast.walk(ast.parse(wrapped)) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    assert got == want and {f"f{i}" for i in range(1, 18)} <= got

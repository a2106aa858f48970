"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import embed_dedup, staging
from corpuslens.llm.embed_dedup import hadamard, near_vectors, plan, spanning, table_keys
from corpuslens.llm.catalog import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, threshold=0.95):
    """(n_links of each row, component of each vec_id) by all pairs."""
    good = {}
    for r, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, float)
            u = u / np.abs(u).max()
            good[r] = u / np.sqrt((u * u).sum())
    links, root = [0] * len(rows), {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(good)
    for n, x in enumerate(keys):
        for y in keys[n + 1:]:
            if len(good[x]) == len(good[y]) and good[x] @ good[y] >= threshold:
                links[x] += 1
                links[y] += 1
                a, b = sorted((find(rows[x][0]), find(rows[y][0])))
                root[b] = a
    return links, {i: find(i) for i in root}


def check(spark, rows, **columns):
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    got = [tuple(r) for r in near_vectors(df).collect()]
    links, comp = brute(rows)
    want = [(i, n, comp.get(i), i == comp.get(i)) for (i, _), n in zip(rows, links, strict=True)]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def planted(rng, dim, centres, copies, cosine):
    rows = []
    for c in range(centres):
        x = rng.standard_normal(dim)
        x /= np.linalg.norm(x)
        rows.append(x)
        for _ in range(copies):
            z = rng.standard_normal(dim)
            z -= (z @ x) * x
            rows.append(cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z))
    return [(i, (v * (1 + i % 3)).tolist()) for i, v in enumerate(rows)]


def test_hadamard_is_the_transform():
    x = np.random.default_rng(0).standard_normal((3, 8))
    h = np.array([[1.0]])
    while len(h) < 8:
        h = np.block([[h, h], [h, -h]])
    np.testing.assert_allclose(hadamard(x), x @ h.T)


@pytest.mark.parametrize("dim", [5, 64, 100])
def test_equals_all_pairs(spark, dim):
    check(spark, planted(np.random.default_rng(dim), dim, 60, 3, 0.97))


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 32)
    check(spark, planted(np.random.default_rng(3), 32, 1, 400, 0.99) )


def test_large_tables_take_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(staging, "SENT_ROWS", 0)
    check(spark, planted(np.random.default_rng(5), 16, 30, 3, 0.98))


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, []), (6, [0.0, -0.0]), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [0.0, 1.0]),
            (11, [0.0, 5.0]), (12, [1e200, 0.0]), (13, [1e-300, 0.0]), (14, [1.0, 0.0, 0.0]), (15, [3.0]), (16, [5.0]),
            (17, [-5.0]), (18, [-0.0, 1.0])]
    check(spark, rows, label=3, kept="x", component_id="x", key="x", cid="x")


def test_no_rows(spark):
    out = near_vectors(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == 0


@pytest.mark.parametrize("vectors", [1000, 100_000, 10**9])
def test_recall_at_the_threshold(vectors):
    """Pairs of exactly the threshold share a bucket at every size."""
    rows = planted(np.random.default_rng(11), 64, 500, 1, 0.9501)
    v = np.array([r for _, r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    p = plan(64, vectors, 0.95)
    missed = np.ones(500, bool)
    for t in range(p.tables):
        k = table_keys(v, t, p.depth)
        missed &= ~embed_dedup._share(k[::2], k[1::2])
    assert missed.mean() <= 0.01


def test_spanning_labels():
    label = spanning(np.array([0, 3, 5, 2]), np.array([4, 1, 2, 4]), 7)
    assert label.tolist() == [0, 1, 0, 1, 0, 0, 6]


def test_query_finds_what_all_pairs_find(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    links, comp = brute(rows)
    got = QUERIES["op11_embeddings"](spark, path).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == \
        sorted((i, n, comp[i]) for (i, _), n in zip(rows, links, strict=True))

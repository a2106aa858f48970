"""Nearest vectors told in single precision; blocks dealt to a task each."""

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.operators import vectors as V


@pytest.mark.parametrize("scale", [1e-25, 1e-12, 1.0, 1e9, 1e13])
def test_single_precision_loses_no_near_pair(scale):
    rng = np.random.default_rng(3)
    vectors, queries = (np.round(rng.normal(size=(n, 64)), 1) * scale for n in (400, 60))
    dist = ((vectors[:, None, :] - queries[None, :, :]) ** 2).sum(axis=2)
    limit = np.sort(dist, axis=0)[5]  # as far as the sixth: right at the bound
    left = np.hstack([vectors, (vectors ** 2).sum(axis=1)[:, None], np.ones((400, 1))])
    right = np.hstack([-2.0 * queries, np.ones((60, 1)), (queries ** 2).sum(axis=1)[:, None]])
    a, b, fits = V._in_single(left, right, limit)
    assert a.dtype == b.dtype == np.float32 and fits.all()
    told = a @ b.T <= 0
    assert told[dist <= limit].all()
    if scale >= 1e-12:  # and few others
        assert told.sum() < 7 * 60


def test_single_precision_is_left_where_it_does_not_reach():
    left, right = np.array([[1e20, 1e40, 1.0]]), np.array([[-2.0, 1.0, 1.0], [-2.0, 1.0, 1.0]])
    assert V._in_single(left, right, np.array([1.0, 2.0])) is None
    left = np.array([[1.0, 1.0, 1.0]])
    assert V._in_single(left, right, np.array([1.0, np.inf]))[2].tolist() == [True, False]


@pytest.mark.parametrize("decimals", [9, None])
def test_a_cell_keeps_the_least_of_many_slices(decimals, monkeypatch):
    """Ties, a zero query, queries of two magnitudes; bounds are set anew after as many vectors as set them."""
    rng = np.random.default_rng(4)
    dim, n, k = 8, 5000, 3
    vectors, queries = rng.integers(0, 4, (n, dim)).astype(float), rng.integers(0, 4, (50, dim)).astype(float)
    queries[0], queries[1] = 0, 1e20
    ids, seen = rng.permutation(n), []
    real = V._knn_block
    monkeypatch.setattr(V, "FIRST_VECTORS", 16)
    monkeypatch.setattr(V, "_knn_block", lambda v, *rest: seen.append(len(v)) or real(v, *rest))
    cell = V._Cell(dim, k, decimals, False)
    cell.add_queries(pa.record_batch({"vec": pa.array(queries.tolist()), "query_id": pa.array(np.arange(50))}))
    rb = pa.record_batch({"vec": pa.array(vectors.tolist()), "embedding_id": pa.array(ids)})
    for lo in range(0, n, 700):
        cell.add_vectors(rb.slice(lo, 700))
    assert all(some <= max(16, sum(seen[:i])) for i, some in enumerate(seen))
    got = cell.result().to_pydict()
    for q in range(50):
        dist = ((vectors - queries[q]) ** 2).sum(axis=1)
        key = V._rank_key(dist, decimals)
        assert sorted(e for e, i in zip(got["embedding_id"], got["query_id"]) if i == q) == sorted(ids[np.lexsort((ids, key))[:k]].tolist())


def test_each_block_has_a_task_of_its_own(spark):
    vectors = spark.range(300).selectExpr("id AS embedding_id", "array(double(id % 17), double(id % 5)) AS embedding")
    queries = spark.range(40).selectExpr("id AS query_id", "array(double(id), 1D) AS embedding")
    found = V.knn(vectors, queries, k=2, max_block_bytes=2048, vector_block_bytes=1024)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("direct_shuffle_partition_id") == 1, plan
    got = {(r.query_id, r.rank): r.embedding_id for r in found.collect()}
    for q in range(40):
        want = sorted(range(300), key=lambda v: ((v % 17 - q) ** 2 + (v % 5 - 1) ** 2, v))[:2]
        assert [got[q, 1], got[q, 2]] == want

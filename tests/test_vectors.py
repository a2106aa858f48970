"""Exact kNN against numpy brute force; dense ids; hashed embedder; chunking."""

import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import vectors as V
from corpuslens.operators.ids import dense_ids


def _brute(Q, qids, X, xids, k, qcls=None, xcls=None):
    out = {}
    for qi, q in zip(qids, Q):
        d = ((X.astype(np.float64) - q.astype(np.float64)) ** 2).sum(1)
        cand = [(d[j], xids[j]) for j in range(len(X))
                if qcls is None or xcls[j] == qcls[list(qids).index(qi)]]
        out[qi] = [x for _, x in sorted(cand)[:k]]
    return out


@pytest.mark.parametrize("block_bytes", [V.MAX_QUERY_BLOCK_BYTES, 8 * 6 * 7])
def test_knn_matches_brute_force(spark, block_bytes):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 6)).astype(np.float32)
    X[10] = X[11]  # exact tie: id order decides
    cls = rng.integers(0, 3, size=300)
    Q = np.vstack([X[:20], rng.normal(size=(5, 6)).astype(np.float32)])
    vec = spark.createDataFrame([(int(i), X[i].tolist(), int(cls[i])) for i in range(300)],
                                "embedding_id long, embedding array<float>, c int").repartition(5)
    qs = spark.createDataFrame([(int(100 + i), Q[i].tolist(), int(cls[i % 300])) for i in range(len(Q))],
                               "query_id long, embedding array<float>, c int")
    got = V.knn(vec, qs, k=4, max_block_bytes=block_bytes).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        res.setdefault(r["query_id"], []).append(r["embedding_id"])
    assert res == _brute(Q, list(range(100, 100 + len(Q))), X, list(range(300)), 4)
    got_c = V.knn(vec, qs, k=3, same_class=("c", "c")).collect()
    res_c = {}
    for r in sorted(got_c, key=lambda r: (r["query_id"], r["rank"])):
        res_c.setdefault(r["query_id"], []).append(r["embedding_id"])
    qcls = [int(cls[i % 300]) for i in range(len(Q))]
    assert res_c == _brute(Q, list(range(100, 100 + len(Q))), X, list(range(300)), 3, qcls, cls)


def test_knn_skips_bad_vectors_and_checks(spark):
    vec = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0]), (3, None), (4, [3.0, 4.0])],
                                "embedding_id long, embedding array<float>")
    qs = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, embedding array<float>")
    rows = V.knn(vec, qs, k=5).orderBy("rank").collect()
    assert [(r["embedding_id"], r["dist"]) for r in rows] == [(1, 0.0), (4, 25.0)]
    chk = V.check_vectors(vec, 2).first()
    assert (chk["n_rows"], chk["n_bad"]) == (4, 2)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_dense_ids_are_dense_and_ordered(spark, parts):
    keys = [(f"f{i % 37:03d}", i // 37) for i in range(500)]
    df = spark.createDataFrame(keys, "file_path string, chunk_no int").repartition(7)
    out = dense_ids(df, ["file_path", "chunk_no"], "id", start=10, num_partitions=parts).collect()
    got = sorted((r["id"], r["file_path"], r["chunk_no"]) for r in out)
    want = [(10 + i, f, c) for i, (f, c) in enumerate(sorted(keys))]
    assert got == want


def test_hashed_embedder_matches_numpy(spark):
    texts = ["Hello, World! hello", "", "x" * 3, "déjà vu — 42_a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    emb = V.HashedEmbedder(dim=16).embed_text(df, "t").collect()
    for r in emb:
        toks = [m.group(0) for m in re.finditer(r"[\w]+|[^\w\s]", texts[r["i"]].lower())]
        c = np.zeros(16)
        for t in toks[:512]:
            c[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 16] += 1
        n = np.sqrt((c * c).sum())
        want = (c / n if n > 0 else c).astype(np.float32)
        assert np.array_equal(np.array(r["embedding"], dtype=np.float32), want), texts[r["i"]]


def test_chunking(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(1100))), (2, ""), (3, "a b")],
                               "id int, t string")
    ch = V.chunk_tokens(df, "t", ["id"], chunk_size=512).select("id", "chunk_no", F.size("tokens").alias("n"))
    assert sorted(tuple(r) for r in ch.collect()) == [(1, 0, 512), (1, 1, 512), (1, 2, 76), (3, 0, 2)]
    whole = V.chunk_tokens(df, "t", ["id"], chunk_size=None).select("id", F.size("tokens").alias("n"))
    assert sorted(tuple(r) for r in whole.collect()) == [(1, 1100), (2, 0), (3, 2)]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_file_numbering_matches_row_ranks(spark, parts):
    from corpuslens.operators.ids import dense_offsets
    rows = [(f"f{i:03d}", (i * 7) % 5) for i in range(120)]   # weight 0 files own no id
    df = spark.createDataFrame(rows, "file_path string, n long").repartition(4)
    out = dense_offsets(df, ["file_path"], "n", "off", start=3, num_partitions=parts).collect()
    got = {r["file_path"]: r["off"] for r in out}
    acc, want = 3, {}
    for f, n in sorted(rows):
        want[f] = acc
        acc += n
    assert got == want
    counts = spark.createDataFrame([("b.py", 2), ("d.py", 1), ("e.py", 0)], "file_path string, n_chunks int")
    docs = spark.createDataFrame([("a.md",), ("c.md",)], "file_path string")
    keys = V.number_chunks(V.file_first_ids(counts, docs), counts).collect()
    assert sorted((r["embedding_id"], r["file_path"], r["chunk_no"]) for r in keys) == [
        (0, "a.md", 0), (1, "b.py", 0), (2, "b.py", 1), (3, "c.md", 0), (4, "d.py", 0)]


def test_append_vectors_validates(spark, tmp_path):
    from corpuslens.sources.store import TableStore
    st = TableStore(spark, str(tmp_path / "v"))
    good = spark.createDataFrame([(0, "code", [1.0, 2.0])], "embedding_id long, kind string, embedding array<float>")
    bad = spark.createDataFrame([(1, "doc", [1.0])], "embedding_id long, kind string, embedding array<float>")
    assert V.append_vectors(st, good, 2) == 1
    with pytest.raises(ValueError):
        V.append_vectors(st, good.unionByName(bad), 2)
    assert st.read("vectors").count() == 1


def test_index_numbers_multi_chunk_files(spark):
    from corpuslens.plans.ingest import index_corpus
    long_src = "\n".join(f"v{i} = {i}" for i in range(400))      # 1,200 tokens -> 3 chunks
    code = spark.createDataFrame([("b.py", long_src), ("d.py", "x = 1\n"), ("e.py", "")],
                                 "file_path string, raw_code string")
    docs = spark.createDataFrame([("a.md", "# A\n"), ("c.md", "# C\n")],
                                 "file_path string, raw_content string")
    idx = index_corpus(code, docs, embedder=V.HashedEmbedder(dim=8))
    got = sorted((r["embedding_id"], r["file_path"], r["chunk_no"], r["kind"])
                 for r in idx.vectors.collect())
    assert got == [(0, "a.md", 0, "doc"), (1, "b.py", 0, "code"), (2, "b.py", 1, "code"),
                   (3, "b.py", 2, "code"), (4, "c.md", 0, "doc"), (5, "d.py", 0, "code")]
    ids = {r["file_path"]: list(r["embedding_ids"]) for r in idx.code_files.collect()}
    assert ids == {"b.py": [1, 2, 3], "d.py": [5], "e.py": []}
    assert {r["file_path"]: r["embedding_id"] for r in idx.doc_files.collect()} == {"a.md": 0, "c.md": 4}
    whole = index_corpus(code, docs, embedder=V.HashedEmbedder(dim=8), chunk_size=None, id_start=10)
    got = sorted((r["embedding_id"], r["file_path"]) for r in whole.vectors.collect())
    assert got == [(10, "a.md"), (11, "b.py"), (12, "c.md"), (13, "d.py"), (14, "e.py")]


def _sorted_pairs(out):
    return sorted(zip(np.concatenate(out[0]).tolist(), np.concatenate(out[1]).tolist()))


@pytest.mark.parametrize("decimals", [None, 9, 2])
@pytest.mark.parametrize("values", ["few", "rounded", "any"])
def test_knn_block_equals_sorting_all_pairs(values, decimals):
    rng = np.random.default_rng(len(values))
    for _ in range(40):
        n, m, dim, k = rng.integers(1, 60), rng.integers(1, 12), rng.integers(1, 6), rng.integers(1, 7)
        draw = {"few": lambda shape: rng.integers(-1, 2, shape).astype(float), "any": rng.standard_normal,
                "rounded": lambda shape: np.round(rng.standard_normal(shape), 1)}[values]
        vectors, queries, ids = draw((n, dim)), draw((m, dim)), rng.permutation(1000)[:n]
        want = []
        for q, x in enumerate(queries):
            diff = vectors - x
            key = V._rank_key(np.einsum("ij,ij->i", diff, diff), decimals)
            want += [(q, int(ids[j])) for j in np.lexsort((ids, key))[:k]]
        assert _sorted_pairs(V._knn_block(vectors, ids, queries, np.arange(m), k, decimals)) == sorted(want)


@pytest.mark.parametrize("equal", [True, False])
def test_knn_memory_is_bounded_when_all_vectors_tie(equal):
    """10,000 vectors as far from each of 1,000 queries: no pair of them all is held."""
    dim, vectors = 768, np.zeros((10_000, 768), np.float32)
    vectors[np.arange(10_000), 3 if equal else np.arange(10_000) % 700] = 1
    queries = np.zeros((1000, dim))
    queries[:, 760] = 1
    cell = V._Cell(dim, 5, 9, False)
    cell.queries = (np.arange(1000).astype(object), queries, np.full(1000, None, object))
    offsets = pa.array(np.arange(0, vectors.size + 1, dim, dtype=np.int32))
    rb = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel())),
                                     pa.array(np.arange(10_000))], ["vec", "embedding_id"])
    tracemalloc.start()
    try:
        cell.add_vectors(rb)
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
    assert sorted(set(cell.best[1].tolist())) == list(range(5)) and len(cell.best[1]) == 5000

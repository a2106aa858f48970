from pyspark.sql import functions as F

from cases import edge_docs, edge_rows, no_docs, some_docs
from conftest import SMOKE
from corpuslens.llm import catalog
from corpuslens.llm.sharding import assign_shards, write_shards


def check(rows, limit):
    """Shards partition the hash space, fit the limit and were split only when too large."""
    shards = {}
    for r in rows:
        shards.setdefault(r.shard_id, []).append(r)
    ids = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(ids, ids[1:]))  # prefix free
    total = {}
    for s, own in shards.items():
        size = sum(r.n_bytes for r in own)
        assert {(r.depth, r.shard_bytes, r.shard_rows) for r in own} == {(len(s), size, len(own))}
        assert size <= limit or len(own) == 1
        for k in range(len(s)):
            total[s[:k]] = total.get(s[:k], 0) + size
    assert all(n > limit for n in total.values())  # every bucket above a shard had to be split
    return shards


def test_documents(spark):
    docs = some_docs(spark)
    for limit in (10_000, 100_000, 10**9):
        rows = assign_shards(docs, limit).collect()
        assert len(rows) == docs.count()
        check(rows, limit)
    assert check(assign_shards(docs, 10**9).collect(), 10**9).keys() == {""}


def test_one_hot_key_is_split(spark):
    docs = spark.range(600).select((F.col("id") % 2 * F.col("id")).alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    assert len(check(assign_shards(docs, 1000).collect(), 1000)) >= 60


def test_repeated_rows_and_edges(spark):
    rows = assign_shards(edge_docs(spark), 1000).collect()
    assert len(rows) == len(edge_rows())
    check(rows, 1000)
    assert assign_shards(no_docs(spark), 1000).count() == 0


def test_query_and_files(spark, tmp_path):
    check(catalog.QUERIES["op5_sharding"](spark, SMOKE).collect(), catalog.SHARD_BYTES)
    docs = some_docs(spark)
    write_shards(docs, str(tmp_path / "out"), 100_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard_id").exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert all(len([f for f in d.iterdir() if f.suffix == ".parquet"]) == 1 for d in (tmp_path / "out").iterdir() if d.is_dir())

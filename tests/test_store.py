"""Table store and record-store operations."""

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import metadata as M
from corpuslens.sources.store import TableStore


def _meta(spark):
    rows = [(i, f"f{i}", f"p{i % 3}.py", None if i == 4 else f"api{i}", [i, i + 10]) for i in range(6)]
    return spark.createDataFrame(rows, "_seq long, function_name string, file_path string, "
                                       "api_reference string, ids array<long>")


def test_store_versions(spark, tmp_path):
    st = TableStore(spark, str(tmp_path / "store"))
    assert not st.exists("t")
    assert st.read("t", schema=_meta(spark).schema).count() == 0
    st.write("t", _meta(spark))
    st.append("t", _meta(spark).limit(1))
    assert st.read("t").count() == 7
    # rewrite reads the current version and writes the next one
    st.write("t", M.delete(st.read("t"), {"file_path": "p0.py"}, multiple=True))
    assert st.read("t").count() == 4
    st.clear("t", _meta(spark).schema)
    assert st.exists("t") and st.read("t").count() == 0


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _xs(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "x int")


def _break_before_commit(monkeypatch, st):
    """The next write leaves its files but dies before Spark's committer is done."""
    put = TableStore._put

    def broken(self, df, folder, partition_by):
        put(self, df, folder, partition_by)
        fs, p = self._path(f"{folder}/_SUCCESS")
        fs.delete(p, False)
        raise KeyboardInterrupt

    monkeypatch.setattr(TableStore, "_put", broken)
    return lambda: monkeypatch.setattr(TableStore, "_put", put)


@pytest.mark.parametrize("first", [True, False])
def test_failed_append_leaves_nothing(spark, tmp_path, monkeypatch, first):
    st = TableStore(spark, str(tmp_path / "s"))
    if not first:
        st.append("t", _xs(spark, 0))
    mend = _break_before_commit(monkeypatch, st)
    with pytest.raises(KeyboardInterrupt):
        st.append("t", _xs(spark, 1))
    mend()
    assert st.exists("t") is not first
    st.append("t", _xs(spark, 1))
    assert _rows(st.read("t")) == ([(1,)] if first else [(0,), (1,)])


def test_failed_replacement_leaves_the_table(spark, tmp_path, monkeypatch):
    st = TableStore(spark, str(tmp_path / "s"))
    st.write("t", _xs(spark, 1, 2))
    mend = _break_before_commit(monkeypatch, st)
    with pytest.raises(KeyboardInterrupt):
        st.write("t", _xs(spark, 9))
    mend()
    assert _rows(st.read("t")) == [(1,), (2,)]
    st.append("t", _xs(spark, 3))
    st.write("t", _xs(spark, 7))
    assert _rows(st.read("t")) == [(7,)]


def test_two_replacements_of_one_table(spark, tmp_path, monkeypatch):
    """Both see the same table; the second fails and the first one's rows stay."""
    st, other = (TableStore(spark, str(tmp_path / "s")) for _ in range(2))
    st.write("t", _xs(spark, 0))
    seen = st._generation("t")
    st.write("t", _xs(spark, 1, 2))
    with monkeypatch.context() as m:
        m.setattr(other, "_generation", lambda name: seen)
        with pytest.raises(RuntimeError):
            other.write("t", _xs(spark, 3))
    assert _rows(st.read("t")) == [(1,), (2,)]


def test_append_overtaken_by_a_replacement(spark, tmp_path, monkeypatch):
    st = TableStore(spark, str(tmp_path / "s"))
    st.append("t", _xs(spark, 0))
    put = TableStore._put

    def overtaken(self, df, folder, partition_by):
        put(self, df, folder, partition_by)
        monkeypatch.setattr(TableStore, "_put", put)
        TableStore(spark, st.root).write("t", _xs(spark, 5))

    monkeypatch.setattr(TableStore, "_put", overtaken)
    with pytest.raises(RuntimeError):
        st.append("t", _xs(spark, 1))
    assert _rows(st.read("t")) == [(5,)]
    st.append("t", _xs(spark, 1))
    assert _rows(st.read("t")) == [(1,), (5,)]


def test_append_under_a_key_happens_once(spark, tmp_path):
    st = TableStore(spark, str(tmp_path / "s"))
    assert st.append("t", _xs(spark, 1), key="batch1") and not st.append("t", _xs(spark, 1), key="batch1")
    assert st.append("t", _xs(spark), key="batch2")
    assert sorted(st.keys("t")) == ["batch1", "batch2"] and _rows(st.read("t")) == [(1,)]
    assert st.read("t", keys=["batch2"]).count() == 0


def test_partitions_empty_rows_and_clean_up(spark, tmp_path):
    st = TableStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("code", 1), ("doc", 2)], "kind string, x int")
    st.append("t", rows.limit(0), partition_by=["kind"])
    assert st.exists("t") and st.read("t").count() == 0
    st.append("t", rows, partition_by=["kind"])
    assert _rows(st.read("t").filter("kind = 'doc'").select("kind", "x")) == [("doc", 2)]
    st.write("t", st.read("t").filter("x = 1"))
    st.remove_replaced("t")
    assert _rows(st.read("t").select("kind", "x")) == [("code", 1)]


def test_filters_updates_deletes(spark):
    df = _meta(spark)
    assert M.find(df, {"ids": 12}).first()["_seq"] == 2          # array contains
    assert M.find(df, {"api_reference": None}).first()["_seq"] == 4
    assert M.find(df, {"missing": None}).count() == 6
    assert M.find_one(df, {"file_path": "p1.py"}).first()["_seq"] == 1
    up = {r["_seq"]: r for r in M.update(df, {"file_path": "p1.py"}, {"api_reference": "X", "new": "y"}).collect()}
    assert (up[1]["api_reference"], up[1]["new"], up[4]["api_reference"], up[4]["new"]) == ("X", "y", None, None)
    many = M.update(df, {"file_path": "p1.py"}, {"api_reference": "X"}, multiple=True)
    assert many.filter(F.col("api_reference") == "X").count() == 2
    assert sorted(r["_seq"] for r in M.delete(df, {"file_path": "p2.py"}).collect()) == [0, 1, 3, 4, 5]
    assert M.delete(df, {"file_path": "p2.py"}, multiple=True).count() == 4
    assert M.count(df, {"file_path": "p0.py"}) == 2


def test_insert_metadata_validation(spark, tmp_path):
    st = TableStore(spark, str(tmp_path / "s2"))
    good = spark.createDataFrame([({"function_name": "a", "file_path": "b", "api_reference": None},)],
                                 "record map<string,string>")
    bad = spark.createDataFrame([({"function_name": "a", "file_path": "b"},)], "record map<string,string>")
    assert M.insert_metadata(st, "meta", good, "record") == 1
    with pytest.raises(ValueError):
        M.insert_metadata(st, "meta", good.unionByName(bad), "record")
    assert st.read("meta").count() == 1


def test_typed_views_fill_defaults(spark):
    code = spark.createDataFrame(
        [("a.py", None, None, None)],
        "file_path string, entities array<struct<name:string>>, embedding_ids array<long>, type string")
    r = M.with_defaults(code).first()
    assert (list(r["entities"]), list(r["embedding_ids"]), r["type"]) == ([], [], "CodeFile.class")
    docs = spark.createDataFrame([("d.md", None, None, None, None)],
                                 "file_path string, sections array<string>, api_references string, "
                                 "embedding_id long, type string")
    d = M.doc_with_defaults(docs).first()
    assert (list(d["sections"]), d["api_references"], d["embedding_id"], d["type"]) == \
           ([], "", -1, "DocumentationFile.class")

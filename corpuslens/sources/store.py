"""Tables as plain Parquet folders.

Every write is one Spark job into a folder of its own, whose name is never
used again; it counts once Spark's committer has left ``_SUCCESS`` there. A job
that fails, or is tried again, so leaves nothing that a reader sees, and no
folder that a reader may hold is ever written to.

A table's folders lie in numbered generations. An append adds a folder to the
current one. A replacement (update, delete, clear) starts the next one, by renaming
a one-line file that names its first folder to ``first``: of two jobs that replace
the same generation the second fails there and changes nothing, and an append that
was overtaken by a replacement fails with none of its rows in the table. ``root``
may be on any file system the cluster can reach, by default under
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import scratch_path


class TableStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or scratch_path(spark, "store")).rstrip("/")

    # -- folders ------------------------------------------------------------
    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        """Names in a folder; none where it does not exist. Any other failure
        raises, so it is never taken for an empty table."""
        fs, p = self._path(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _committed(self, path: str) -> bool:
        fs, p = self._path(f"{path}/_SUCCESS")
        return fs.exists(p)

    def _generation(self, name: str) -> int:
        numbers = sorted((int(n) for n in self._names(f"{self.root}/{name}") if re.fullmatch(r"\d{8}", n)), reverse=True)
        return next((n for n in numbers if "first" in self._names(self._home(name, n))), 0)

    def _home(self, name: str, generation: int) -> str:
        return f"{self.root}/{name}/{generation:08d}"

    def _folders(self, name: str, generation: int) -> dict[str, str]:
        """Committed folders of a generation by key: its first one (key ``""``) and
        appends; of several attempts under one key, one counts."""
        home, out = self._home(name, generation), {}
        names = self._names(home)
        if "first" in names:
            out[""] = f"{home}/{self.spark.read.text(f'{home}/first', wholetext=True).first()[0].strip()}"
        for n in sorted(names):
            if (m := re.fullmatch(r"put=add-(.+)-[0-9a-f]{32}", n)) and m[1] not in out and self._committed(f"{home}/{n}"):
                out[m[1]] = f"{home}/{n}"
        return out

    def _put(self, df: DataFrame, folder: str, partition_by: list[str] | None) -> None:
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(folder)
        if partition_by and set(self._names(folder)) <= {"_SUCCESS"}:  # no rows, so no file has the columns
            rest = T.StructType([f for f in df.schema if f.name not in partition_by])
            empty = "/".join(f"{c}=__HIVE_DEFAULT_PARTITION__" for c in partition_by)
            self.spark.createDataFrame([], rest).write.parquet(f"{folder}/{empty}")

    def _load(self, folders: list[str]) -> DataFrame:
        """The rows of folders of one generation; their names look like a partition
        column to Spark, which is left out."""
        r = self.spark.read.option("basePath", folders[0].rsplit("/", 1)[0])
        return r.option("mergeSchema", str(len(folders) > 1).lower()).parquet(*folders).drop("put")

    # -- public API ---------------------------------------------------------
    def exists(self, name: str) -> bool:
        """the table has been created."""
        return bool(self._folders(name, self._generation(name)))

    def keys(self, name: str) -> list[str]:
        """The keys of the current appends."""
        return [k for k in self._folders(name, self._generation(name)) if k]

    def read(self, name: str, schema: T.StructType | None = None, keys: list[str] | None = None) -> DataFrame:
        """A10: open the table (only the appends of ``keys``, if given), or an
        empty one with ``schema`` if there is nothing to read."""
        found = self._folders(name, self._generation(name))
        folders = [f for k, f in found.items() if keys is None or k in keys]
        if not folders:
            if schema is None:
                raise FileNotFoundError(f"table {name!r} does not exist")
            return self.spark.createDataFrame([], schema)
        return self._load(folders)

    def write(self, name: str, df: DataFrame, sort_by: list[str] | None = None,
              partition_by: list[str] | None = None) -> None:
        """Replace the table with ``df``, which may read it. ``sort_by`` clusters
        rows inside files so point lookups skip row groups; ``partition_by``
        (string columns) lays out folders that filters on them prune."""
        number = self._generation(name) + 1
        home, folder = self._home(name, number), f"put=base-{uuid.uuid4().hex}"
        self._put(df.sortWithinPartitions(*sort_by) if sort_by else df, f"{home}/{folder}", partition_by)
        fs, claim = self._path(f"{home}/.{folder}")
        out = fs.create(claim, False)
        out.write(bytearray(folder, "utf-8"))
        out.close()
        first = self._path(f"{home}/first")[1]
        if fs.exists(first) or not fs.rename(claim, first):
            raise RuntimeError(f"table {name!r} was replaced by another job meanwhile; it is unchanged by this one")

    def append(self, name: str, df: DataFrame, partition_by: list[str] | None = None, key: str | None = None) -> bool:
        """Add rows (creating the table); columns that it lacks are
        added to it. Rows appended under a ``key`` are added once: where the
        key is there, nothing is written and the result is False, so a replayed
        batch is harmless."""
        generation = self._generation(name)
        found = self._folders(name, generation)
        if key is not None and key in found:
            return False
        types = {f.name: f.dataType for f in self._load(list(found.values())).schema} if found else {}
        for f in df.schema:
            if types.get(f.name, f.dataType).simpleString() not in (f.dataType.simpleString(), "void"):
                raise ValueError(f"column {f.name!r} of table {name!r} is {types[f.name].simpleString()}")
        attempt = uuid.uuid4().hex
        self._put(df, f"{self._home(name, generation)}/put=add-{key or attempt}-{attempt}", partition_by)
        if self._generation(name) != generation:
            raise RuntimeError(f"table {name!r} was replaced by another job meanwhile; append again")
        return True

    def clear(self, name: str, schema: T.StructType) -> None:
        """An empty table with the declared schema."""
        self.write(name, self.spark.createDataFrame([], schema))

    def remove_replaced(self, name: str) -> None:
        """Delete what replacements have left behind. Only for when no job reads
        an earlier generation any more."""
        now = self._generation(name)
        for n in self._names(f"{self.root}/{name}"):
            if re.fullmatch(r"\d{8}", n) and int(n) < now:
                fs, p = self._path(f"{self.root}/{name}/{n}")
                fs.delete(p, True)

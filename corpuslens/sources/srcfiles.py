"""Scanning a project tree (A1-A4): list it, then read the files spread by size.

``list_sources`` lists with the Python data source ``srcfiles``. The driver
walks the tree breadth-first only until it holds ``listingPartitions`` directories
(or has listed ``driverListLimit`` entries); those directories are dealt into at
most ``listingPartitions`` partitions, whose executors list the subtrees. The list
is a staged table ``path, size``, which the driver never holds. ``read_listed``
deals the files by their place in the running sum of bytes (and a fixed cost for
each file) into tasks of about ``partition_bytes``, and those read them: where a
directory holds many of the files, its files are still read by many tasks.

    spark.read.format("srcfiles").option("extensions", ".py,.md").load(root)

reads in the tasks that list. Few directories are then each split over up to
``shardsPerDirectory`` partitions, which read the files whose path hash falls in
their shard; the files the driver met on the way are grouped into partitions of
about ``partitionBytes`` bytes (at most ``maxFilesPerPartition`` files).

Names are matched with ``endswith`` (case-sensitive) like the reference crawler,
and -- unlike Spark's file sources, which skip names starting with ``_`` or
``.`` -- hidden names such as ``__init__.py`` are kept. A missing root gives
an empty table. Listing and reading go through ``pyarrow.fs``, so the root may
be a local path or any URI pyarrow understands (``hdfs://``, ``s3://``, ...).

``read_sources`` then decodes the bytes: strict UTF-8 (checked in the JVM with
``is_valid_utf8``), text-mode newlines, and files that fail go to a
quarantine table instead of stopping the job.
"""

from __future__ import annotations

import logging
import math
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import universal_newlines
from ..operators.ids import dense_offsets
from ..session import stage

log = logging.getLogger(__name__)

DEFAULT_EXTENSIONS = (".py", ".md")
SCHEMA = "path string, content binary, size long"
LIST_SCHEMA = "path string, size long"

#: Bytes of files that one task reads, what opening a file counts as, and
#: bytes that a task hands on at a time.
PARTITION_BYTES, OPEN_COST, BATCH_BYTES = 32 << 20, 128 << 10, 8 << 20


def _fs_and_path(root: str):
    import pyarrow.fs as pafs
    if root.startswith("file://"):
        return pafs.LocalFileSystem(), root[len("file://"):]
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), root[len("file:"):]
    if "://" in root:
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def _matches(info, extensions) -> bool:
    import pyarrow.fs as pafs
    return info.type == pafs.FileType.File and any(info.base_name.endswith(e) for e in extensions)


def expand_tree(root: str, extensions, want_dirs: int, max_entries: int):
    """Driver side: breadth-first expansion of ``root`` until ``want_dirs``
    directories are pending or ``max_entries`` entries were listed.
    Returns ``(files met, pending directories)``; a missing root gives
    nothing."""
    import pyarrow.fs as pafs
    fs, base = _fs_and_path(root)
    if fs.get_file_info(base).type == pafs.FileType.NotFound:
        log.error("Directory %s does not exist.", root)
        return [], []
    files, dirs, listed = [], [base], 0
    while dirs and len(dirs) < want_dirs and listed < max_entries:
        deeper = []
        for n, d in enumerate(dirs):
            if listed >= max_entries:  # the rest of this level is left to the executors
                deeper.extend(dirs[n:])
                break
            for info in fs.get_file_info(pafs.FileSelector(d, recursive=False)):
                listed += 1
                if info.type == pafs.FileType.Directory:
                    deeper.append(info.path)
                elif _matches(info, extensions):
                    files.append((info.path, info.size or 0))
        dirs = deeper
    return sorted(files), sorted(dirs)


def _slices(root: str, files, target: int, max_files: int):
    parts, cur, size = [], [], 0
    for path, n in files:
        if cur and (size + n > target or len(cur) >= max_files):
            parts.append(_Slice(root, cur))
            cur, size = [], 0
        cur.append((path, n))
        size += n
    if cur:
        parts.append(_Slice(root, cur))
    return parts


def _read_slice(partition, content: bool):
    if not partition.root:
        return
    import pyarrow.fs as pafs
    fs, _ = _fs_and_path(partition.root)
    files = partition.files
    for subtree in partition.subtrees:
        # executor side: list this directory's whole subtree
        found = fs.get_file_info(pafs.FileSelector(subtree, recursive=True))
        files = files + sorted((f.path, f.size or 0) for f in found if _matches(f, partition.extensions))
    if partition.shards > 1:
        files = [f for f in files if zlib.crc32(f[0].encode()) % partition.shards == partition.shard]
    for path, size in files:
        if not content:
            yield (path, None, size)
            continue
        with fs.open_input_stream(path) as fh:
            data = fh.read()
        yield (path, bytes(data), len(data))


class _Slice(InputPartition):
    def __init__(self, root: str, files: list[tuple[str, int]], subtrees: tuple[str, ...] = (),
                 extensions=DEFAULT_EXTENSIONS, shard: int = 0, shards: int = 1):
        super().__init__((subtrees, shard) if subtrees else files)
        self.root = root
        self.files = files
        self.subtrees = tuple(subtrees)
        self.extensions = tuple(extensions)
        self.shard, self.shards = shard, shards


class SourceFilesReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path")
        exts = options.get("extensions")
        self.extensions = tuple(exts.split(",")) if exts else DEFAULT_EXTENSIONS
        self.content = options.get("content", "true") == "true"
        self.target = int(options.get("partitionBytes", PARTITION_BYTES))
        self.max_files = int(options.get("maxFilesPerPartition", 1024))
        self.want_dirs = int(options.get("listingPartitions", 256))
        self.max_entries = int(options.get("driverListLimit", 100_000))
        self.shards = int(options.get("shardsPerDirectory", 4))

    def partitions(self):
        if not self.root:
            return [_Slice("", [])]
        files, dirs = expand_tree(self.root, self.extensions, self.want_dirs, self.max_entries)
        parts = _slices(self.root, files, self.target, self.max_files)
        # a directory may hold a large share of the tree: where there are few,
        # split their files over several tasks by a stable hash of the path
        shards = max(1, min(self.shards, self.want_dirs // max(len(dirs), 1))) if self.content else 1
        groups = [dirs[k::self.want_dirs] for k in range(min(len(dirs), self.want_dirs))]
        parts += [_Slice(self.root, [], subtrees=g, extensions=self.extensions, shard=k, shards=shards)
                  for g in groups for k in range(shards)]
        return parts or [_Slice(self.root, [])]

    def read(self, partition):
        return _read_slice(partition, self.content)


class SourceFilesDataSource(DataSource):
    @classmethod
    def name(cls):
        return "srcfiles"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SourceFilesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceFilesDataSource)


def list_sources(spark: SparkSession, root: str, extensions=DEFAULT_EXTENSIONS, **options) -> DataFrame:
    """A1: the staged list ``path, size`` of the tree's matching files."""
    register(spark)
    found = (spark.read.format("srcfiles").option("extensions", ",".join(extensions)).option("content", "false")
             .options(**options).load(root))
    return stage(found.select("path", "size"), "listing")


def _read_files(root: str):
    def run(batches):
        fs, _ = _fs_and_path(root)
        paths, contents, held = [], [], 0

        def batch():
            sizes = pa.array([len(c) for c in contents], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary()), sizes],
                                              ["path", "content", "size"])

        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path) as fh:
                    contents.append(bytes(fh.read()))
                paths.append(path)
                held += len(contents[-1])
                if held >= BATCH_BYTES:
                    yield batch()
                    paths, contents, held = [], [], 0
        if paths:
            yield batch()
    return run


def read_listed(files: DataFrame, root: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Read listed files (``path, size``) as ``path, content, size``, in tasks that
    hold about ``partition_bytes`` each, whatever directories they lie in."""
    cost = files.select("path", (F.col("size") + OPEN_COST).alias("cost"))
    total = cost.agg(F.sum("cost")).first()[0]
    if total is None:
        return files.sparkSession.createDataFrame([], SCHEMA)
    tasks = math.ceil(total / partition_bytes)
    dealt = dense_offsets(cost, ["path"], "cost", "at").withColumn("bin", F.floor(F.col("at") / partition_bytes).cast("int"))
    return dealt.repartition(tasks, "bin").select("path").mapInArrow(_read_files(root), SCHEMA)


def read_sources(spark: SparkSession, root: str, extensions=DEFAULT_EXTENSIONS):
    """A1 + A2: ``(files(path, text), quarantine(file_path, error))``.

    ``text`` is the strict UTF-8 decoding with ``\\r\\n`` and ``\\r`` read as
    ``\\n`` (how the reference opens files); undecodable files are quarantined.
    """
    # staged: the files of each kind and the undecodable ones are separate results
    return decode_sources(stage(read_listed(list_sources(spark, root, extensions), root), "files-read"))


def decode_sources(raw: DataFrame):
    """A2: ``raw(path, content)`` -> ``(files(path, text), quarantine)``."""
    text = F.col("content").cast("string")
    decoded = raw.select("path", text.alias("_t"), F.is_valid_utf8(text).alias("_ok"))
    files = decoded.filter("_ok").select("path", universal_newlines("_t").alias("text"))
    bad = decoded.filter(~F.col("_ok")).select(F.col("path").alias("file_path"),
                                               F.lit("invalid UTF-8").alias("error"))
    return files, bad

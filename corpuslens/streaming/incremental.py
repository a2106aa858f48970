"""Incremental indexing of a growing project tree with Structured Streaming.

    readStream (a clock) --tick--> foreachBatch:
        list the tree by executors -> anti join with the known paths -> read
        -> decode -> dispatch -> index (ids continue after the stored maximum)
        -> append records, vectors, call sites, quarantine, the batch's graph folds

A batch appends the fold of its own files to ``node_folds`` and ``edge_folds``; what is
stored is not rewritten, so the bytes written follow the batch. ``graph_tables`` merges the
folds on read: they are min/max over order keys, so the result equals a full rebuild.
To keep the reads short, every ``FAN`` folds of a level are merged into one of the next,
so a fold is rewritten once for each level, of which there are log(batches).

Arrivals are known by path: the paths that a tick finds and that no earlier one
found are appended to the table ``arrivals`` before they are read, so a file is
taken once whatever its modification time, a replayed tick takes the same files, and
the driver holds no list. A file that changes in place is not read again.

Every append carries the batch's number as its key and is added once, so a
replayed batch is harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import graph as G
from ..plans.ingest import index_corpus, split_sources
from ..sources.srcfiles import DEFAULT_EXTENSIONS, LIST_SCHEMA, decode_sources, list_sources, read_listed
from ..sources.store import TableStore

#: Folds of one level that are merged into one of the next.
FAN = 8


def _cover(store: TableStore, name: str) -> list[tuple[int, int, int]]:
    """The folds to read, as (level, first batch, last batch): those within no
    fold of a higher level."""
    folds = sorted((tuple(int(x) for x in k.split(".")) for k in store.keys(name)), reverse=True)
    out: list[tuple[int, int, int]] = []
    for level, lo, hi in folds:
        if not any(a <= lo and hi <= b for _, a, b in out):
            out.append((level, lo, hi))
    return out


def _key(fold: tuple[int, int, int]) -> str:
    return ".".join(map(str, fold))


def _merge(store: TableStore, name: str, folds: list) -> DataFrame:
    """One fold of several."""
    rows = store.read(name, G.NODE_SCHEMA if name == "node_folds" else G.EDGE_SCHEMA, keys=[_key(f) for f in folds])
    return G.merge_node_folds(rows) if name == "node_folds" else G.merge_edge_folds(rows)


def _compact(store: TableStore, name: str) -> None:
    """Merge ``FAN`` folds of a level into one of the next, level by level. The
    merged ones stay where they are and are no longer read."""
    while True:
        cover = _cover(store, name)
        full = [level for level in {f[0] for f in cover} if sum(f[0] == level for f in cover) >= FAN]
        if not full:
            return
        folds = sorted(f for f in cover if f[0] == min(full))[:FAN]
        store.append(name, _merge(store, name, folds), key=_key((min(full) + 1, folds[0][1], folds[-1][2])))


def graph_tables(store: TableStore) -> tuple[DataFrame, DataFrame]:
    """The graph ``(nodes, edges)`` of all batches so far."""
    return tuple(_merge(store, name, _cover(store, name)) for name in ("node_folds", "edge_folds"))


def apply_batch(store: TableStore, raw: DataFrame, epoch_id: int, embedder=None) -> None:
    """Index one batch of ``raw(path, content, size)`` files into ``store``.

    Idempotent, so a micro-batch replayed after a failure leaves the store as one
    application would: each table takes the batch once, by its number, and ids
    continue after the largest id of earlier batches.
    """
    epoch, key = F.lit(epoch_id).cast("long"), f"batch{epoch_id}"
    files, undecodable = decode_sources(raw)
    code_src, doc_src, skipped = split_sources(files)
    start = 0
    if store.exists("vectors"):
        top = (store.read("vectors").filter(F.col("_epoch") != epoch_id)
               .agg(F.max("embedding_id")).first()[0])
        start = 0 if top is None else top + 1
    idx = index_corpus(code_src, doc_src, embedder=embedder, id_start=start)
    bad = (idx.quarantine.select("file_path", "error")
           .unionByName(undecodable).unionByName(skipped))
    for name, df in {"code_files": idx.code_files, "doc_files": idx.doc_files, "vectors": idx.vectors,
                     "quarantine": bad, "edge_calls": idx.edge_calls}.items():
        store.append(name, df.withColumn("_epoch", epoch), partition_by=["kind"] if name == "vectors" else None, key=key)
    for name, df in {"node_folds": idx.nodes, "edge_folds": idx.edges}.items():
        store.append(name, df, key=_key((0, epoch_id, epoch_id)))
        _compact(store, name)


def arrivals(spark: SparkSession, root: str, store: TableStore, epoch_id: int, extensions=DEFAULT_EXTENSIONS) -> DataFrame | None:
    """The files ``path, content, size`` that are new in tick ``epoch_id``; None if none is."""
    key = f"batch{epoch_id}"
    if key not in store.keys("arrivals"):
        known = store.read("arrivals", T.StructType.fromDDL(LIST_SCHEMA))
        new = list_sources(spark, root, extensions).join(known.select("path"), "path", "left_anti")
        if new.isEmpty():
            return None
        store.append("arrivals", new, key=key)
    return read_listed(store.read("arrivals", keys=[key]), root)


def start_incremental_ingest(spark: SparkSession, root: str, store: TableStore,
                             checkpoint_location: str, extensions=DEFAULT_EXTENSIONS,
                             embedder=None, available_now: bool = True):
    """Start the streaming ingest; returns the ``StreamingQuery``.

    ``available_now=True`` processes what is there and stops (a scheduled
    run); otherwise the tree is looked at every 30 seconds. The stream itself is a
    clock whose checkpoint numbers the ticks.
    """
    def tick(df, epoch):
        raw = arrivals(spark, root, store, epoch, extensions)
        if raw is not None:
            apply_batch(store, raw, epoch, embedder)

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="30 seconds")
    return writer.start()

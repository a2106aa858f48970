"""Near-duplicate documents by one-permutation MinHash and exact confirmation.

A document is the set of its distinct word shingles. One hash function deals
the shingles into ``BINS`` bins and the least hash of each bin is its
signature; an empty bin borrows the value of another by optimal densification
(each bin probes the others in an order fixed for that bin, so the lender is an
independent, uniform choice). ``ROWS`` bins make a band; documents that agree
on a band share a bucket.

Candidates are stars: in each of two rounds a bucket's members are paired with
one centre only, never with each other. Pairs are confirmed on the full shingle
sets, links are folded into components, centres leave their bucket (all their
pairs there are decided), and buckets whose members are all in one component
are done. What is open then (documents that share a passage but are not alike,
groups that straddle the threshold) is decided exactly in tiles of bounded
size, which return spanning links only. No bucket, partner or candidate is
capped.

Documents with equal sets are one class and enter once, by their smallest
doc_id, so groups of copies never meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import connected_components
from .staging import arrow_map, hinted, staged
from .words import chunks, find_words, hash_ranges, mix64

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Rounds of one centre a bucket; what is open then is decided in tiles.
STAR_ROUNDS = 2
#: Members of a block; a tile holds two blocks at most.
TILE = 256

_SIG_SCHEMA = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
_SET_SCHEMA = "doc_id long, shingles array<long>"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BAND_STEP = mix64(np.arange(1, BINS + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def _probe_orders() -> np.ndarray:
    """Row i: bin i itself, then the other bins in an order fixed for bin i."""
    rng = np.random.default_rng(BINS)
    return np.stack([np.concatenate([[i], rng.permutation(np.delete(np.arange(BINS), i))]) for i in range(BINS)])


_PROBES = _probe_orders()


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    steps = mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for c in chunks(texts):
        w = find_words(c)
        h = hash_ranges(c.data, w.start, w.end, lower=True)
        rolled = np.zeros(max(len(h) - size + 1, 0), np.uint64)
        for k in range(size):
            rolled += h[k:k + len(rolled)] * steps[k]
        rolled = mix64(rolled)
        for d in range(c.hi - c.lo):
            lo, hi = w.first[d], w.first[d + 1]
            if hi - lo >= size:
                yield np.unique(rolled[lo:hi - size + 1])
            elif hi > lo:  # the whole short sequence, apart from every full shingle
                yield mix64(np.array([(h[lo:hi] * steps[:hi - lo]).sum() + np.uint64(hi - lo)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of a sorted, non-empty set."""
    bins = (shingles >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    filled, first = np.unique(bins, return_index=True)
    values = np.zeros(BINS, np.uint64)
    values[filled] = shingles[first]
    if len(filled) < BINS:
        has = np.zeros(BINS, bool)
        has[filled] = True
        empty = np.flatnonzero(~has)
        lender = _PROBES[empty, has[_PROBES[empty]].argmax(axis=1)]
        values[empty] = values[lender]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    mixed = mix64(values * _BAND_STEP).reshape(BANDS, ROWS)
    return mix64(mixed.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEP)


def _signatures(size: int):
    def run(batches):
        for b in batches:
            ids, n, s1, s2, bands = b.column(0), [], [], [], []
            for s in shingle_sets(b.column(1), size):
                n.append(len(s))
                s1.append(mix64(s).sum(dtype=np.uint64))
                s2.append(mix64(s ^ _STEP).sum(dtype=np.uint64))
                bands.append(band_keys(signature(s)).view(np.int64) if len(s) else None)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), as_long(s1), as_long(s2), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "s1", "s2", "bands"])
    return run


def _sets(size: int):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sets = [s.view(np.int64) for s in shingle_sets(part.column(1), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))],
                                                 ["doc_id", "shingles"])
    return run


def _centers(rows: DataFrame) -> DataFrame:
    """One centre a bucket, the least member in an order drawn for the bucket."""
    turn = F.xxhash64("key", "cid")
    heads = rows.groupBy("key").agg(F.min_by("cid", turn).alias("a"), F.min_by("n", turn).alias("na"),
                                    F.min_by("comp", turn).alias("ca"))
    return hinted(staged(heads, "dup-centers"))


def _open(rows: DataFrame) -> DataFrame:
    """Rows of buckets whose members lie in two components or more. Their keys
    are a table of its own, so a bucket of many rows can be split in the join."""
    live = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    return rows.join(hinted(staged(live.select("key"), "dup-open")), "key")


def _rest(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links between components within buckets that the stars left open.

    A bucket's members are dealt into blocks of about TILE by hash; every two
    blocks (and each block with itself) make a tile, a group of bounded size
    that is decided by one sparse product of its sets. A tile returns links
    that span its components, fewer than its members."""
    blocks = hinted(staged(rows.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("g")), "dup-blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("g")).cast("int")
    dealt = (rows.join(blocks, "key").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "own", "cid", "comp"))
    tile = ["key", "i", "j"]
    live = dealt.groupBy(*tile).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    full = dealt.join(live.select(*tile), tile).join(
        sets.select(F.col("doc_id").alias("cid"), "shingles"), "cid")

    def decide(pdf):
        found = tile_links(pdf["cid"].to_numpy(), pdf["comp"].to_numpy(), pdf["own"].to_numpy(),
                           pdf["shingles"].tolist(), threshold)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return staged(full.groupBy(*tile).applyInPandas(decide, "a long, b long"), "dup-rest")


def tile_links(ids, comps, side, sets, threshold: int) -> list[tuple[int, int]]:
    """Links that join the components of a tile; two rows of one block are
    compared only when the tile has one block. ``sets`` hold distinct values."""
    size = np.array([len(s) for s in sets], np.int64)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = seen[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    two = len(np.unique(side)) == 2
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side != side.min()) if two else left
    common = np.zeros((len(left), len(right)), np.float32)
    lo = 0
    while lo < len(row):  # so many columns at a time that the dense part stays small
        hi = int(np.searchsorted(column, column[lo] + 4096))
        part = np.zeros((len(sets), int(column[hi - 1] - column[lo]) + 1), np.float32)
        part[row[lo:hi], column[lo:hi] - column[lo]] = 1
        common += part[left] @ part[right].T
        lo = hi
    common = common.astype(np.int64)
    union = size[left][:, None] + size[right][None, :] - common
    hits = np.argwhere((100 * common >= threshold * union) & (comps[left][:, None] != comps[right][None, :]))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for x, y in zip(left[hits[:, 0]], right[hits[:, 1]], strict=True):
        a, b = root(int(comps[x])), root(int(comps[y]))
        if a != b:
            parent[a] = b
            links.append((int(ids[x]), int(ids[y])))
    return links


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id long, text string, ...)``.

    Two documents are linked when ``100 * |A and B| >= threshold * |A or B|``
    for their sets of ``shingle``-word shingles (A-Z lower-cased); a document of
    fewer words has its whole word sequence as its one shingle. Returns
    ``doc_id, n_shingles, component_id, kept`` for every input row; a group's
    component_id is its smallest doc_id, which alone is kept.

    Null or word-less text: no shingles, its own component. Rows that repeat a
    doc_id are one document: a link of any of its texts is a link of the
    document. A null doc_id is linked with nothing, has a null component and is
    kept. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = staged(arrow_map(texts, _signatures(shingle), _SIG_SCHEMA), "dup-signatures")
    real = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")

    # a table of its own, so the copies of one text can be split in the join
    classes = staged(real.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep")), "dup-classes")
    members = staged(real.join(classes, ["n_shingles", "s1", "s2"]).select(
        "doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")),
        "dup-members")

    rows = (members.where("bands IS NOT NULL")
            .select(F.explode("bands").alias("key"), F.col("doc_id").alias("cid"), F.col("n_shingles").alias("n"),
                    F.col("doc_id").alias("comp")))
    rows = staged(_open(rows), "dup-buckets")

    wanted = hinted(staged(rows.select(F.col("cid").alias("doc_id")).distinct(), "dup-wanted"))
    sets = staged(arrow_map(texts.join(wanted, "doc_id", "left_semi"), _sets(shingle), _SET_SCHEMA), "dup-sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))

    links = members.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    tested, found = [], []
    for _ in range(STAR_ROUNDS):
        starred = rows.join(_centers(rows), "key").where("cid <> a")
        pairs = (starred.where("comp <> ca")
                 .where(100 * F.least("n", "na") >= threshold * F.greatest("n", "na"))
                 .select(F.least("a", "cid").alias("a"), F.greatest("a", "cid").alias("b")).distinct())
        for t in tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        new = staged(pairs.join(right, "b").join(left, "a").select(
            "a", "b", (100 * common >= threshold * (F.size("x") + F.size("y") - common)).alias("linked")), "dup-pairs")
        tested.append(new.select("a", "b"))
        found.append(new.where("linked").select("a", "b"))
        comps = connected_components(reduce(DataFrame.unionByName, found))
        rows = staged(_open(starred.select("key", "cid", "n").join(
            comps.select(F.col("node").alias("cid"), "root"), "cid", "left")
            .select("key", "cid", "n", F.coalesce("root", "cid").alias("comp"))), "dup-buckets")
    found.append(_rest(rows, sets, threshold))

    groups = connected_components(reduce(DataFrame.unionByName, found, links))
    out = (sigs.select("doc_id", "n_shingles")
           .join(groups.select(F.col("node").alias("doc_id"), F.col("root")), "doc_id", "left")
           .withColumn("component_id", F.coalesce("root", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))



def deduplicated(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps: one document of each
    group. Of rows that repeat a doc_id, the least text stays; rows without a
    doc_id all stay. The ids to drop are the few; texts are not shuffled where
    their list is short."""
    flags = staged(near_duplicates(docs, shingle, threshold).select("doc_id", "kept"), "dup-flags")
    gone = staged(flags.where("NOT kept").select("doc_id").distinct(), "dup-gone")
    again = staged(flags.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
                   .where("n > 1").select("doc_id"), "dup-again")
    left = docs.join(hinted(gone), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    many = left.join(hinted(again), "doc_id", "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    first = Window.partitionBy("row.doc_id").orderBy(F.col("row.text").asc_nulls_first(), F.to_json("row"))
    many = many.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")
    return left.join(hinted(again), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(many)

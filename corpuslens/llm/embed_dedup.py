"""Near-duplicate embeddings by cross-polytope hashing and verified pairs.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the coordinate axis (with sign) that it then lies
closest to. ``depth`` hashes make a table's bucket. Each vector stands in its
own bucket and is also a probe in the ``PROBES`` buckets next best by the gap
to the largest coordinate. ``plan`` picks the depth by the number of vectors,
so that buckets stay small, and then the number of tables by a simulation of
pairs at the threshold, so that such a pair is missed with probability ``MISS``.

Candidates are two members of a bucket, one of them at home there. Buckets are
cut into tiles of bounded size; a tile first drops members without a partner
whose 128 rotated signs are near, and only what is left meets its vectors. Every
candidate pair is verified by its cosine in double precision, and is counted in
the first bucket that the two share, so no pair is ever a row: a tile returns a
number of links for each member and links that span its components.

Equal vectors are one class that enters once with its number of copies.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .staging import arrow_map, hinted, schema_with, staged
from .words import mix64

PROBES = 3
#: Runners-up of a hash that a probe may take.
ALTERNATIVES = 4
MISS = 1e-4
#: Vectors at home in a bucket that the depth aims at, at most.
LOAD = 4
#: Rotated signs of a vector's sketch.
SIGNS = 128
#: Members of a block; a tile holds two blocks at most.
TILE = 256
#: Rows that a task looks at together (whole tiles).
SLICE = 8192

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    depth: int
    tables: int


def hadamard(y: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row (a power of two wide), not normalised."""
    n, width = y.shape
    h = 1
    while h < width:
        y = y.reshape(n, -1, 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return y


def _width(dim: int) -> int:
    return max(2, 1 << (dim - 1).bit_length())


@lru_cache(maxsize=64)
def _signs(width: int, number: int) -> np.ndarray:
    """The random signs of rotation ``number``."""
    return np.random.default_rng([width, number]).choice([-1.0, 1.0], (3, width))


def _rotated(v: np.ndarray, number: int) -> np.ndarray:
    width = _width(v.shape[1])
    y = np.pad(v, ((0, 0), (0, width - v.shape[1])))
    for s in _signs(width, number):
        y = hadamard(y * s) / math.sqrt(width)
    return y


@lru_cache(maxsize=16)
def _combinations(depth: int, choices: int) -> np.ndarray:
    return np.array(list(itertools.product(range(choices), repeat=depth)), np.int64)


def table_keys(v: np.ndarray, table: int, depth: int) -> np.ndarray:
    """Keys of one table for unit rows: the own bucket, then the probes."""
    n, width = len(v), _width(v.shape[1])
    choices = min(ALTERNATIVES, width)
    axes, gaps = [], []
    for k in range(depth):
        y = _rotated(v, table * depth + k)
        size = np.abs(y)
        best = np.argsort(-size, axis=1, kind="stable")[:, :choices]
        top = np.take_along_axis(size, best, 1)
        axes.append(2 * best + (np.take_along_axis(y, best, 1) < 0))
        gaps.append((top[:, :1] - top) ** 2)
    combos = _combinations(depth, choices)
    total = sum(gaps[k][:, combos[:, k]] for k in range(depth))
    taken = np.argsort(total, axis=1, kind="stable")[:, :PROBES + 1]
    key = np.full(taken.shape, (table + 1) * 0x10001 + width * 0x100000001, np.uint64)
    for k in range(depth):
        axis = axes[k][np.arange(n)[:, None], combos[taken, k]].astype(np.uint64)
        key = mix64(key * _STEP + axis + np.uint64(1))
    return key.view(np.int64)


@lru_cache(maxsize=64)
def plan(dim: int, vectors: int, threshold: float) -> Plan:
    """Depth and tables for unit vectors of ``dim`` components: about ``LOAD``
    vectors a bucket, and tables until a pair at the threshold is missed by all
    with probability ``MISS`` (from 1,000 simulated pairs)."""
    width = _width(dim)
    depth = 1
    while (2 * width) ** depth * LOAD < vectors and depth < 5:
        depth += 1
    rng = np.random.default_rng([dim, depth])
    x = _unit(rng.standard_normal((1000, dim)))
    z = rng.standard_normal((1000, dim))
    z = z - (z * x).sum(1, keepdims=True) * x
    y = threshold * x + math.sqrt(1 - threshold**2) * _unit(np.where(np.abs(z) < 1e-12, 0, z))
    hit = np.mean([_share(table_keys(x, t, depth), table_keys(_unit(y), t, depth)) for t in range(3)])
    hit = min(max(float(hit), 0.02), 1 - 1e-6)
    return Plan(depth, math.ceil(math.log(MISS) / math.log(1 - hit)))


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where one of two is at home in a bucket of the other (keys on the last axis)."""
    return (a[..., :1] == b).any(-1) | (b[..., :1] == a).any(-1)


def _sketch(v: np.ndarray) -> np.ndarray:
    """``SIGNS`` signs of the rotated rows as two integers."""
    signs = np.concatenate([_rotated(v, r) >= 0 for r in range(-(-SIGNS // _width(v.shape[1])))], axis=1)[:, :SIGNS]
    return np.packbits(signs, axis=1).view(np.int64)


def _far(threshold: float) -> int:
    """Differing signs beyond which a pair is no candidate: six deviations
    above those of a pair at the threshold."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SIGNS * p + 6 * math.sqrt(SIGNS * p * (1 - p)))


def _rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The usable vectors of a list column by width: (row numbers, matrix).
    Rows are scaled by their largest component; null, empty, zero and
    non-finite rows and rows with a null component are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        v = flat[first[rows][:, None] + np.arange(size)]
        top = np.abs(v).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        if good.any():
            out.append((rows[good], v[good] / top[good, None]))
    return out


def _hashed(vectors: int, threshold: float):
    def run(batches):
        for b in batches:
            n = b.num_rows
            h1, h2, ok = (np.zeros(n, np.int64) for _ in range(3))
            sketch = np.zeros((n, 2), np.int64)
            keys: list = [None] * n
            for rows, v in _rows(b.column("embedding")):
                p = plan(v.shape[1], vectors, threshold)
                bits = (v + 0.0).view(np.uint64)  # no negative zero
                steps = mix64(np.arange(1, v.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
                h1[rows] = mix64((mix64(bits) * steps).sum(1, dtype=np.uint64)).view(np.int64)
                h2[rows] = mix64((mix64(bits ^ _STEP) * mix64(steps)).sum(1, dtype=np.uint64)).view(np.int64)
                ok[rows] = 1
                for lo in range(0, len(rows), 2048):
                    u = _unit(v[lo:lo + 2048])
                    sketch[rows[lo:lo + 2048]] = _sketch(u)
                    all_keys = np.concatenate([table_keys(u, t, p.depth) for t in range(p.tables)], axis=1)
                    for r, k in zip(rows[lo:lo + 2048], all_keys, strict=True):
                        keys[r] = k
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("embedding"), pa.array(h1), pa.array(h2), pa.array(sketch[:, 0].copy()),
                 pa.array(sketch[:, 1].copy()), pa.array(ok == 1), pa.array(keys, pa.list_(pa.int64()))],
                ["vec_id", "embedding", "h1", "h2", "s1", "s2", "usable", "keys"])
    return run


def _whole_tiles(batches):
    """Batches of a partition sorted by tile as tables of whole tiles with the
    number of each row's tile."""
    kept = []
    for b in itertools.chain(batches, [None]):
        if b is not None:
            kept.append(b)
            if sum(x.num_rows for x in kept) < SLICE:
                continue
        if not kept:
            return
        t = pa.Table.from_batches(kept).combine_chunks()
        tile = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
        new = np.concatenate([[True], (tile[:, 1:] != tile[:, :-1]).any(0)]) if t.num_rows else np.zeros(0, bool)
        end = t.num_rows if b is None else int(np.flatnonzero(new)[-1])
        kept = t.slice(end).to_batches() if b is not None else []
        if end:
            yield t.slice(0, end), np.cumsum(new[:end])
        if b is None:
            return


def _pairs(t: pa.Table, tile: np.ndarray):
    """Candidate pairs of whole tiles, a bounded number at a time: members of
    one tile, one at home there, of different blocks where it has two."""
    own, home = t.column("own").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
    two = t.column("i").to_numpy() != t.column("j").to_numpy()
    a = np.arange(len(tile))
    for gap in range(1, len(tile)):
        a = a[a + gap < len(tile)]
        a = a[tile[a] == tile[a + gap]]
        if not len(a):
            return
        b = a + gap
        fit = (home[a] | home[b]) & (~two[a] | (own[a] != own[b]))
        yield a[fit], b[fit]


def _near(far: int):
    """Members of a tile with a partner whose signs are near."""
    def run(batches):
        for t, tile in _whole_tiles(batches):
            s1, s2 = (t.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2"))
            live = np.zeros(len(tile), bool)
            for a, b in _pairs(t, tile):
                near = np.bitwise_count(s1[a] ^ s1[b]) + np.bitwise_count(s2[a] ^ s2[b]) <= far
                live[a[near]] = True
                live[b[near]] = True
            yield from t.filter(pa.array(live)).select(["key", "i", "j", "own", "home", "cid"]).to_batches()
    return run


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Each of n nodes' least node in its component by the links a-b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while (label[label] != label).any():
            label = label[label]


def _linked(vectors: int, threshold: float):
    """For whole tiles with vectors: (cid, number of links first seen here) and
    links that span (rep, rep)."""
    def run(batches):
        for t, tile in _whole_tiles(batches):
            n = len(tile)
            weight, rep, key = (t.column(c).to_numpy() for c in ("copies", "rep", "key"))
            found = np.zeros(n, np.int64)
            left, right = [], []
            table_of, keys_of, unit_of = np.zeros(n, np.int64), {}, {}
            where, widths = np.zeros(n, np.int64), np.zeros(n, np.int64)
            keys_column = t.column("keys").combine_chunks()
            for rows, v in _rows(t.column("embedding")):
                dim = v.shape[1]
                widths[rows], where[rows] = dim, np.arange(len(rows))
                unit_of[dim] = _unit(v)
                mine = keys_column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1, PROBES + 1)
                keys_of[dim] = mine
                table_of[rows] = (mine == key[rows][:, None, None]).any(-1).argmax(1)
            for a, b in _pairs(t, tile):
                for dim in np.unique(widths[a]):
                    pick = (widths[a] == dim) & (widths[b] == dim)
                    x, y = a[pick], b[pick]
                    u, k = unit_of[dim], keys_of[dim]
                    hit = np.einsum("ij,ij->i", u[where[x]], u[where[y]]) >= threshold
                    x, y = x[hit], y[hit]
                    if not len(x):
                        continue
                    kx, ky = k[where[x]], k[where[y]]
                    table = _share(kx, ky).argmax(1)
                    at = np.arange(len(x))
                    kx, ky = kx[at, table], ky[at, table]
                    first = np.where((kx[:, :1] == ky).any(1), kx[:, 0], np.iinfo(np.int64).max)
                    first = np.minimum(first, np.where((ky[:, :1] == kx).any(1), ky[:, 0], np.iinfo(np.int64).max))
                    mine = (table == table_of[x]) & (first == key[x])
                    x, y = x[mine], y[mine]
                    np.add.at(found, x, weight[y])
                    np.add.at(found, y, weight[x])
                    left.append(x)
                    right.append(y)
            if not left:
                continue
            label = spanning(np.concatenate(left), np.concatenate(right), n)
            some = found > 0
            yield pa.RecordBatch.from_arrays(
                [t.column("cid").to_numpy()[some], found[some], rep[some], rep[label[some]]],
                ["cid", "links", "a", "b"])
    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Links of ``vectors(vec_id long, embedding array<float or double>, ...)``
    with cosine of at least ``threshold`` (above 0) among the pairs found.

    Returns for every input row ``vec_id, n_links, component_id, kept``: the
    number of other rows it is linked with, the smallest vec_id reachable by
    links, and whether that is its own.

    A vector that is null, empty, zero, or has a null or non-finite component
    links with nothing, nor do vectors of different widths. Every row is a
    vector of its own; rows that repeat a vec_id share a component. A row
    without a vec_id links with nothing, has a null component and is kept.
    Other columns are ignored; an empty table gives no rows.
    """
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    n = src.count()
    schema = schema_with(list(src.schema.fields), "h1 long, h2 long, s1 long, s2 long, usable boolean, keys array<long>")
    rows = staged(arrow_map(src, _hashed(n, threshold), schema)
                  .withColumn("cid", F.monotonically_increasing_id()), "vec-hashed")
    real = rows.where("usable AND vec_id IS NOT NULL")
    classes = staged(real.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.min("cid").alias("cid"),
                                                  F.count("*").alias("copies")), "vec-classes")
    heads = staged(rows.join(hinted(classes.select("cid", "rep", "copies")), "cid")
                   .select("cid", "rep", "copies", "s1", "s2", "keys", "embedding"), "vec-heads")

    members = heads.select("cid", "s1", "s2", F.posexplode("keys").alias("nth", "key")) \
        .select("key", "cid", "s1", "s2", (F.col("nth") % (PROBES + 1) == 0).alias("home"))
    blocks = members.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("used")) \
        .where("n > 1 AND used").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("g"))
    own = F.pmod(F.xxhash64("cid"), F.col("g")).cast("int")
    tile = ["key", "i", "j"]
    dealt = (members.join(hinted(staged(blocks, "vec-blocks")), "key").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     "own", "home", "cid", "s1", "s2"))

    def by_tile(df):
        return df.repartition(*tile).sortWithinPartitions(*tile)

    live = staged(arrow_map(by_tile(dealt), _near(_far(threshold)),
                            "key long, i int, j int, own int, home boolean, cid long"), "vec-live")
    full = live.join(heads.select("cid", "rep", "copies", "keys", "embedding"), "cid") \
        .select("key", "i", "j", "own", "home", "cid", "rep", "copies", "keys", "embedding")
    found = staged(arrow_map(by_tile(full), _linked(n, threshold), "cid long, links long, a long, b long"), "vec-links")

    counts = staged(found.groupBy("cid").agg(F.sum("links").alias("links")), "vec-counts")
    sized = staged(classes.join(hinted(counts), "cid", "left")
                   .select("h1", "h2", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "vec-sized")
    flat = rows.select("vec_id", F.when(F.col("usable") & F.col("vec_id").isNotNull(), F.col("h1")).alias("h1"), "h2")
    flat = flat.join(hinted(sized.select("h1", "h2", "rep", "links")), ["h1", "h2"], "left")
    flat = staged(flat.select("vec_id", "rep", F.coalesce("links", F.lit(0)).alias("n_links")), "vec-flat")
    edges = found.select("a", "b").unionByName(
        flat.where("rep <> vec_id").select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
    groups = connected_components(edges)
    out = flat.join(hinted(staged(groups.select(F.col("node").alias("vec_id"), "root"), "vec-groups")), "vec_id", "left") \
        .withColumn("component_id", F.coalesce("root", "vec_id"))
    return out.select("vec_id", "n_links", "component_id",
                      F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))

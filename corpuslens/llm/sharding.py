"""Sharding by extendible hashing.

A row's hash is a string of 120 bits: 60 of the MD5 of its key, then 60 drawn
for the row, so that rows of one hot key can be told apart. A shard is a hash
prefix. Starting from one bucket, only a bucket whose bytes exceed the limit is
split on another bit, until each fits; a single row above the limit stands
alone. The directory maps the prefixes to the shards.

Bytes are summed per prefix before anything else, eight bits at a time and only
below buckets that are still too large, so a pass sees at most 256 prefixes for
each of those and no row list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import hinted, staged

BITS, PASS_BITS = 60, 8


def _bits(number: Column) -> Column:
    return F.lpad(F.bin(number), BITS, "0")


def path_bits(h1: Column, h2: Column) -> Column:
    return F.concat(_bits(h1), _bits(h2))


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """A staged table of the rows of ``docs``: ``row`` (a struct of all columns,
    without the text unless ``keep``), ``n_bytes`` of the text in UTF-8 (null:
    0), and the hash as ``h1, h2``. Staged, because the drawn bits must stay."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if keep or c != text))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    out = docs.select(row.alias("row"), F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
                      F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long").alias("h1"),
                      F.floor(F.rand(1) * (1 << 52)).cast("long").bitwiseXOR(F.shiftleft(F.floor(F.rand(2) * 256).cast("long"), 52)).alias("h2"))
    return staged(out, "shard-rows")


def directory(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """``shard_id`` (prefix bits), ``depth, shard_bytes, shard_rows`` of every
    bucket of ``rows(n_bytes, h1, h2)``; an empty table has no bucket."""
    path = path_bits(F.col("h1"), F.col("h2"))
    shards, over, depth = [], None, 0
    while depth < 2 * BITS:
        end = depth + PASS_BITS
        cells = rows.select("n_bytes", "h1", "h2", F.substring(path, 1, end).alias("cell"))
        if over is not None:
            cells = cells.withColumn("up", F.substring("cell", 1, depth)).join(hinted(over), "up", "left_semi")
        cells = cells.groupBy("cell").agg(
            F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"), F.min("h1").alias("a1"),
            F.max("h1").alias("z1"), F.min("h2").alias("a2"), F.max("h2").alias("z2"))
        level = F.explode(F.sequence(F.lit(depth if over is None else depth + 1), F.lit(end)))
        nodes = cells.withColumn("depth", level).groupBy(
            "depth", F.expr("substring(cell, 1, depth)").alias("prefix")).agg(
            F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"),
            ((F.sum("n_bytes") > limit_bytes) & ((F.min("a1") < F.max("z1")) | (F.min("a2") < F.max("z2")))).alias("over"))
        nodes = staged(nodes, "shard-nodes")
        # a bucket is a node that need not be split below one that must be
        split = nodes.where("over").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        fit = nodes.where("NOT over")
        below = fit.withColumn("up", F.expr("substring(prefix, 1, depth - 1)")).join(split, ["depth", "up"], "left_semi")
        top = fit.where(F.col("depth") == (0 if over is None else depth + 1))
        shards.append((below.drop("up").unionByName(top) if over is None else below.drop("up").unionByName(top)).distinct())
        over = staged(nodes.where(F.col("over") & (F.col("depth") == end)).select(F.col("prefix").alias("up")), "shard-over")
        depth = end
        if not over.limit(1).count():
            break
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return staged(out.select(F.col("prefix").alias("shard_id"), "depth", F.col("n_bytes").alias("shard_bytes"),
                             F.col("n_rows").alias("shard_rows")), "shard-directory")


def located(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Every row of ``rows`` with its bucket: it is looked up at the depths that
    occur (at most 120 numbers), of which one has its prefix."""
    depths = sorted(r.depth for r in shards.select("depth").distinct().collect())
    path = path_bits(F.col("h1"), F.col("h2"))
    prefixes = F.array(*(F.substring(path, 1, d) for d in depths)) if depths else F.array().cast("array<string>")
    return rows.withColumn("shard_id", F.explode(prefixes)).join(hinted(shards), "shard_id")


def assign_shards(docs: DataFrame, limit_bytes: int, key: str = "doc_id") -> DataFrame:
    """The shard of every row of ``docs(key, text, ...)``: ``row`` (all columns
    but the text), ``n_bytes, shard_id, depth, shard_bytes, shard_rows``.

    No shard of more than one row exceeds ``limit_bytes``. Null text has no
    bytes; a null key hashes as an empty one; rows that share a key stay
    together unless their bucket is too large; an empty table gives no rows.
    """
    rows = keyed(docs, key)
    return located(rows, directory(rows, limit_bytes)).drop("h1", "h2")


def write_shards(docs: DataFrame, path: str, limit_bytes: int, key: str = "doc_id") -> None:
    """Write all rows as Parquet below ``path``, a folder ``shard_id=...`` with
    one file for each shard (``_`` before its prefix bits)."""
    rows = keyed(docs, key, keep=True)
    found = located(rows, directory(rows, limit_bytes))
    out = found.select("row.*", F.concat(F.lit("_"), F.col("shard_id")).alias("shard_id"))
    out.repartition("shard_id").write.partitionBy("shard_id").parquet(path)

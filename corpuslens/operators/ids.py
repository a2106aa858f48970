"""Dense, order-true row ids without a single-task global sort.

A global ``row_number()`` with no partition moves every row into one task. The
two-pass scheme below keeps the work spread out:

1. range-partition on the order key and sort inside each partition, so that
   partition ``p`` holds keys strictly before partition ``p + 1``; record the
   partition index and the position inside it;
2. checkpoint that table to the shared checkpoint folder -- the range bounds
   come from sampling, so a recomputation after a lost executor could pick
   other bounds; the checkpoint pins them;
3. count rows per partition (one row per partition), turn the counts into
   start offsets, and broadcast that table -- its size is the partition count;
4. id = start + offset(partition) + position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_PART_BITS = 33  # monotonically_increasing_id = partition index << 33 | row


def _range_partitions(df: DataFrame) -> int:
    """The session's shuffle width (sized for the cluster), not a count of
    the input's partitions, which would run its shuffles to find out."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def dense_ids(df: DataFrame, order_cols: list[str], id_col: str = "row_id",
              start: int | F.Column = 0, num_partitions: int | None = None) -> DataFrame:
    """Add ``id_col``: 0-based (plus ``start``) rank of each row in ``order_cols``
    order. Keys must be unique for the ids to be deterministic."""
    n = num_partitions or _range_partitions(df)
    ranged = (df.repartitionByRange(n, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_pos", F.monotonically_increasing_id()
                            - F.shiftleft(F.spark_partition_id().cast("long"), _PART_BITS))
                .transform(materialize))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a window without PARTITION BY is bounded by the
    # partition count here, not by the data.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    start_col = start if isinstance(start, F.Column) else F.lit(start)
    return (ranged.join(F.broadcast(offsets), "_pid")
                  .withColumn(id_col, (start_col + F.col("_off") + F.col("_pos")).cast("long"))
                  .drop("_pid", "_pos", "_off"))


def dense_offsets(df: DataFrame, order_cols: list[str], weight_col: str, out_col: str = "offset",
                  start: int | F.Column = 0, num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = ``start`` + the sum of ``weight_col`` over all rows
    before this one in ``order_cols`` order (an exclusive prefix sum).

    Used to number chunks from a file-level table: the file with ``n`` chunks
    gets ``n`` consecutive ids from its offset, so the chunk-level data (and
    the embedding that produces it) is computed once and never sampled."""
    n = num_partitions or _range_partitions(df)
    ranged = (df.repartitionByRange(n, *order_cols)
                .withColumn("_pid", F.spark_partition_id())
                .transform(materialize))
    within = Window.partitionBy("_pid").orderBy(*order_cols) \
                   .rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_before", F.coalesce(F.sum(weight_col).over(within), F.lit(0)))
    totals = ranged.groupBy("_pid").agg(F.sum(weight_col).alias("_n"))
    # one row per partition, as in dense_ids
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    start_col = start if isinstance(start, F.Column) else F.lit(start)
    return (local.join(F.broadcast(offsets), "_pid")
                 .withColumn(out_col, (start_col + F.col("_off") + F.col("_before")).cast("long"))
                 .drop("_pid", "_before", "_off"))

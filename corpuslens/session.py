"""Spark session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every corpuslens job assumes. AQE re-plans joins and coalesces
# partitions at run time and splits skewed join partitions (hot callee names,
# hot file paths); the UI stays off because no port may be opened.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpointed intermediates are removed once no plan references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "corpuslens", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage and stage intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` as configured by the
    operator (a shared file system). Only when nothing is configured -- local
    runs and tests -- a private folder is created under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="corpuslens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a staged table under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return base.rstrip("/") + "/tables/" + name


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table of the shared folder and read it back:
    later plans read only the columns and partitions they need, and the files
    survive the loss of executors."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a scan (a Python parse, tokenising whole texts)
    at least one partition per core. Small inputs often arrive as a single
    partition (one Parquet row group); large scans already have many
    partitions and pass through unchanged.

    Call it on scan-level DataFrames only: counting the partitions of a plan
    that contains a shuffle would run the stages before it."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


#: Bytes of the Arrow batches that Python tasks are handed.
BATCH_BYTES = 8 << 20


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes: Spark's own bound is a
    number of rows, which says little of long texts. The session's setting is
    left alone where it has one."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def materialize(df: DataFrame) -> DataFrame:
    """``stage`` for an intermediate result without a name of its own."""
    return stage(df, "intermediate")

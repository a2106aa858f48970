"""Tables staged between steps of an operator, in the cluster's shared folder.

The folder is the session's checkpoint folder (``spark.checkpoint.dir``); only
a session without one on a local master gets a private folder, as in tests.
Staged tables cut lineage: their files survive the loss of executors and are
never recomputed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="corpuslens-llm-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new table of the shared folder and read it
    back with the same schema (an empty frame keeps its columns)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a key table (a few longs each) up to which it is sent to all tasks.
SENT_ROWS = 250_000


def hinted(keys: DataFrame) -> DataFrame:
    """A staged table of narrow keys, marked for broadcast where its row count,
    taken here, proves it small; a larger one is left to a shuffled join."""
    return F.broadcast(keys) if keys.count() <= SENT_ROWS else keys


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


def schema_with(kept: list[T.StructField], added: str) -> T.StructType:
    """Result schema of a ``mapInArrow``: fields kept as they are (of any name)
    and the fields of a DDL string."""
    return T.StructType([*kept, *T.StructType.fromDDL(added).fields])

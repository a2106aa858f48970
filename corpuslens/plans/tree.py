"""Lay a derived corpus out as a project tree, with a Spark job.

Each executor writes the files of its partition through ``pyarrow.fs`` under
a fresh folder of the shared scratch area; nothing passes through the driver.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import arrow_map, scratch_path


def _writer(root: str):
    def run(batches):
        from ..sources.srcfiles import _fs_and_path
        fs, base = _fs_and_path(root)
        made = set()
        for rb in batches:
            for rel_path, content in zip(rb.column(0), rb.column(1)):
                path = f"{base}/{rel_path.as_py()}"
                parent = path.rsplit("/", 1)[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(path) as fh:
                    fh.write(content.as_buffer())
            yield pa.RecordBatch.from_pydict({"n": pa.array([rb.num_rows], pa.int64())})
    return run


def write_tree(spark: SparkSession, files: DataFrame, name: str = "tree") -> str:
    """Write ``files(rel_path, content binary)`` under a new folder; return it."""
    root = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    arrow_map(files.select("rel_path", "content"), _writer(root), "n long").agg(F.sum("n")).collect()
    return root

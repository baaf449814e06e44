"""Materialisation points.

A frame that several later branches read (a report and the rows it gates,
counts and the rows they number) is written once as a Parquet table in the
shared folder named by ``spark.checkpoint.dir`` and read back: the upstream
runs once, lineage is cut, the planner knows the real size, and a lost
executor re-reads the files instead of recomputing from the sources.

Tables fixed inside a ``scratch`` block are removed at its end, others at the
end of the Python process, as lazily returned frames still read them.
"""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tillbook.session import ensure_checkpoint_dir

_WRITTEN: dict[str, SparkSession] = {}
_BLOCK = threading.local()  # a streaming query fixes its tables in a thread of its own


def fix(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fixed-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    getattr(_BLOCK, "paths", []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end the tables that this thread fixed inside; no frame may read them later."""
    outer = getattr(_BLOCK, "paths", [])
    _BLOCK.paths = []
    try:
        yield
    finally:
        _remove(_BLOCK.paths)
        _BLOCK.paths = outer


def _remove(paths: list[str]) -> None:
    for path in paths:
        sc = _WRITTEN.pop(path).sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _remove_all() -> None:
    try:
        _remove(list(_WRITTEN))
    except Exception:  # the session has ended before the process
        pass

"""Intermediate tables in storage that every executor can read.

A long plan that is read more than once is written as Parquet below the folder named in
``spark.checkpoint.dir`` and read again. This cuts the lineage, and the files outlive any executor.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, as in tests, a new local one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="peerscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one. What is written there goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/peerscope/{uuid.uuid4().hex}/{name}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)  # only what exists can be marked
    files.deleteOnExit(folder)
    return path


#: The folders staged in each ``scratch`` block that is open, innermost last.
_blocks: list[list[tuple[SparkSession, str]]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables staged inside the block are deleted at its end, but for those that are to outlive it: these belong to the block around."""
    _blocks.append([])
    try:
        yield
    finally:
        for spark, folder in _blocks.pop():
            delete(spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table's files with the folder that was made for it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(frame: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """``frame`` written to the shared folder and read back, with the same schema.

    The files go at the end of the ``scratch`` block, or of the one around it with ``outlive``; without one, when the
    application ends.
    """
    path = work_folder(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    table = frame.sparkSession.read.schema(frame.schema).parquet(path)
    for block in _blocks[-2:-1] if outlive else _blocks[-1:]:
        block.append((frame.sparkSession, path))
    return table


def drop_staged(frame: DataFrame) -> None:
    """Delete the files of a table from ``staged`` that nothing reads any more."""
    for file in frame.inputFiles()[:1]:
        delete(frame.sparkSession, file.rsplit("/", 1)[0])

"""Results as files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_tsv(frame: DataFrame, path: str, compression: str = "none") -> None:
    """Tab-separated text; ``compression`` may be gzip."""
    frame.write.mode("overwrite").option("sep", "\t").option("nullValue", "\\N").option("compression", compression).csv(path)


def write_partitioned(frame: DataFrame, path: str, column: str = "part", overwrite_all: bool = False) -> None:
    """One folder per value of ``column``. Only the partitions that ``frame`` holds are replaced.

    The rebalance hint lets adaptive execution split a large partition over several tasks and files.
    """
    mode = "static" if overwrite_all else "dynamic"
    frame.hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(column).parquet(path)


def explained(frame: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

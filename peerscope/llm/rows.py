"""Rows of a table as documents of their own: numbers where ids don't tell rows apart, and names that are free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.staging import staged

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def free_name(frame: DataFrame, stem: str) -> str:
    """``stem``, with underscores behind it until no column of ``frame`` has the name (case left aside)."""
    taken = {c.lower() for c in frame.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def told_apart(documents: DataFrame, id_column: str) -> bool:
    """Whether the ids are integers, none of them null and none in two rows."""
    if documents.schema[id_column].dataType.simpleString() not in INTEGERS:
        return False
    return documents.groupBy(id_column).count().where(F.col(id_column).isNull() | (F.col("count") > 1)).isEmpty()


def numbered(documents: DataFrame, id_column: str, text_column: str, name: str, nulls_first: bool = False) -> DataFrame:
    """``documents`` with a number of each row in column ``name``, written to the shared folder.

    Numbers ascend with the id, null ids before or after all others, then with the digest of the text; rows alike in
    both are numbered in the order in which they are read. That last key also lets a range of like rows be split.
    """
    order = F.col(id_column).asc_nulls_first() if nulls_first else F.col(id_column).asc_nulls_last()
    tie = free_name(documents, "__tie")
    ordered = documents.withColumn(tie, F.monotonically_increasing_id()).orderBy(order, F.sha2(F.col(text_column).cast("string"), 256), tie)
    return staged(ordered.drop(tie).withColumn(name, F.monotonically_increasing_id()), "numbered")

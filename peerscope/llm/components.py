"""Connected components of a table of links, by alternating large and small stars.

Each step replaces links by links to the smallest neighbour and keeps what is connected: after a number of
steps logarithmic in the longest path every node is linked with the smallest node of its component. Links are
first thinned out where they lie, partition by partition, to a forest of stars. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.blocks import lean
from peerscope.staging import drop_staged, staged

#: Links that a task joins at once; then it hands on their forest and starts afresh.
FOREST_LINKS = 500_000


def forest(pairs: np.ndarray) -> np.ndarray:
    """Links (smallest, other) for the components of some links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([(root(x), x) for x in parent if root(x) != x], np.int64).reshape(-1, 2)


def local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def done() -> pa.RecordBatch:
        links = forest(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    for batch in batches:
        held.append(np.stack([np.asarray(batch.column(k)) for k in ("a", "b")], axis=1))
        if sum(map(len, held)) >= FOREST_LINKS:
            yield done()
            held.clear()
    if held:
        yield done()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every node with a link.

    ``links`` has columns ``a`` and ``b`` (long); loops and repeated links do no harm. No links: no rows.
    """
    now = staged(links.select("a", "b").where("a <> b").mapInArrow(lean(local_forests), "a long, b long"), "links")
    while not is_forest_of_stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: the larger neighbours of a node link with the smallest of the node and its neighbours
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        # small star: a node and its smaller neighbours link with the smallest of them
        first = large.groupBy("b").agg(F.min("a").alias("m"))
        star = large.join(first, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b")
        before, now = now, staged(star.distinct().mapInArrow(lean(local_forests), "a long, b long"), "links")
        drop_staged(before)
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).distinct().union(roots)


def is_forest_of_stars(links: DataFrame) -> bool:
    """Whether no node has two parents, and none has both a parent and a child."""
    ends = links.distinct().select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("a").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    seen = ends.select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or up = 1 and down = 1").isEmpty()

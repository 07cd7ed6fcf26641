"""k nearest neighbours of a stated set of query points, by squared Euclidean distance."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerscope.staging import staged

#: Queries of a block, and blocks that go through one pass over the points; the driver holds one pass at a time.
BLOCK_QUERIES, PASS_BLOCKS = 2048, 8
TASK_ROWS = 4096
#: Distances by a matrix product are off by at most this share of the vectors' squared lengths; what is that close is measured again.
ROUNDING = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class Best:
    """The k points nearest to each query of a block so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.squares = (vectors**2).sum(axis=1)
        self.found, self.distance = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), np.inf)

    def take(self, found: np.ndarray, rows: np.ndarray) -> None:
        """Compare some points with all queries: a matrix product rules most pairs out, the rest is measured exactly."""
        squares = (rows**2).sum(axis=1)
        rough = self.squares[:, None] + squares[None, :] - 2 * (self.vectors @ rows.T)
        rough[self.ids[:, None] == found[None, :]] = np.inf
        slack = ROUNDING * (self.squares[:, None] + squares[None, :]) + 1e-300
        limit = self.distance[:, -1]
        if len(found) > self.k:
            limit = np.minimum(limit, np.partition(rough + slack, self.k - 1, axis=1)[:, self.k - 1])
        query, point = np.nonzero((rough - slack <= limit[:, None]) & np.isfinite(rough))
        if not len(query):
            return
        exact = np.concatenate([((rows[point[a : a + TASK_ROWS]] - self.vectors[query[a : a + TASK_ROWS]]) ** 2).sum(axis=1) for a in range(0, len(query), TASK_ROWS)])
        known = np.isfinite(self.distance)
        owner = np.concatenate((np.nonzero(known)[0], query))
        ids, distance = np.concatenate((self.found[known], found[point])), np.concatenate((self.distance[known], exact))
        order = np.lexsort((ids, distance, owner))
        owner, ids, distance = owner[order], ids[order], distance[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = place < self.k
        self.found, self.distance = np.zeros_like(self.found), np.full_like(self.distance, np.inf)
        self.found[owner[keep], place[keep]], self.distance[owner[keep], place[keep]] = ids[keep], distance[keep]


def nearest_neighbours(points: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, neighbour_id, distance`` of the k points nearest to each query, itself left out.

    Every task keeps its k best for each query of a block, so what is shuffled is k rows per task and query. Ties
    go to the smaller id. Points or queries without a vector are left out.
    """
    spark = points.sparkSession
    frame = lambda x: x.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).dropna()
    asked, order = frame(queries), Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    passes = []
    for first in range(0, blocks, PASS_BLOCKS):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)).between(first, first + PASS_BLOCKS - 1)).orderBy("id").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        held = spark.sparkContext.broadcast((np.asarray(own["id"].combine_chunks()), matrix(own["v"].combine_chunks())))  # bounded by PASS_BLOCKS

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, vectors = held.value
            best = [Best(ids[a : a + BLOCK_QUERIES], vectors[a : a + BLOCK_QUERIES], k) for a in range(0, len(ids), BLOCK_QUERIES)]
            for batch in batches:
                for at in range(0, batch.num_rows, TASK_ROWS):
                    part = batch.slice(at, TASK_ROWS)
                    found, rows = np.asarray(part.column("id")), matrix(part.column("v"))
                    for block in best:
                        block.take(found, rows)
            for block in best:
                keep = np.isfinite(block.distance)
                row = np.broadcast_to(block.ids[:, None], keep.shape)
                yield pa.RecordBatch.from_arrays([pa.array(row[keep]), pa.array(block.found[keep]), pa.array(block.distance[keep])], ["query_id", "neighbour_id", "distance"])

        near = frame(points).mapInArrow(run, "query_id long, neighbour_id long, distance double")
        ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")
        if blocks > PASS_BLOCKS:
            ranked = staged(ranked, "neighbours")
            held.unpersist()
        passes.append(ranked)
    if not passes:
        return spark.createDataFrame([], "query_id long, rank int, neighbour_id long, distance double")
    return functools.reduce(DataFrame.union, passes)

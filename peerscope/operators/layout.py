"""Layout of the flow table: tagging rows with a grid cell or a tree leaf, unique addresses, pruned scans."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.operators.kdtree import KdTree
from peerscope.sources.sinks import write_partitioned

#: Points of a sample that the driver builds a tree from, at most.
SAMPLE_POINTS = 200_000
#: Leaves up to which a tree becomes nested conditions instead of an Arrow function.
CONDITION_LEAVES = 64
GRID_SIDE = 148
DAY = 86_400_000.0
#: Fixed values of the draw: a prime, and a factor for each of a row's coordinates in turn.
DRAWS, FACTORS = 1_000_003, (65_599, 31, 7)
TREE_COLUMNS = ("intipfrom", "intipto", "flow_date")


def coordinate(column: str) -> Column:
    """A column as the number the tree compares: dates as milliseconds since 1970, whatever the session's time zone."""
    return F.unix_date(F.col(column).cast("date")).cast("double") * DAY if column.endswith("date") else F.col(column).cast("double")


def even_points(side: int = GRID_SIDE) -> list[int]:
    """Split points that cut the address space into equal parts."""
    return [(k + 1) * (1 << 32) // side for k in range(side - 1)]


def grid_index(number: Column, points: list[int] | None = None, side: int = GRID_SIDE) -> Column:
    """How many split points lie below a number: an address equal to a point belongs to the part that ends there.

    Without ``points`` they are the even ones, and the answer is arithmetic.
    """
    if points is None:
        return F.greatest(F.lit(0), F.least(F.lit(side - 1), F.shiftright(number * side + ((1 << 32) - 1), 32) - 1)).cast("long")
    edges = np.array(points, np.int64)

    @F.pandas_udf("long")
    def index(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, values.to_numpy(), side="left"))

    return index(number)


def with_cell(flows: DataFrame, points: list[int] | None = None) -> DataFrame:
    """``flows`` with ``cell``: both addresses, smaller first, on a grid. Either direction of a pair has one cell."""
    low, high = F.least("intipfrom", "intipto"), F.greatest("intipfrom", "intipto")
    side = GRID_SIDE if points is None else len(points) + 1
    return flows.withColumn("cell", grid_index(low, points) * side + grid_index(high, points))


def unique_addresses(flows: DataFrame, part: str) -> DataFrame:
    """The distinct addresses of either side in each part."""
    return flows.select(part, F.explode(F.array("intipfrom", "intipto")).alias("intip")).distinct()


def write_unique_addresses(flows: DataFrame, path: str, part: str) -> None:
    """The same as one folder per part, in the order of addresses. Ranges of them are dealt out, so a large part becomes several files."""
    ordered = unique_addresses(flows, part).repartitionByRange(part, "intip").sortWithinPartitions(part, "intip")
    ordered.write.mode("overwrite").partitionBy(part).parquet(path)


def draw(columns: tuple[str, ...] = TREE_COLUMNS) -> Column:
    """A number from 0 to DRAWS - 1 by which rows are sampled; rows alike in these columns share it."""
    number = lambda c: F.unix_date(F.col(c).cast("date")).cast("long") if c.endswith("date") else F.col(c).cast("long")
    total = F.lit(0).cast("long")
    for k, c in enumerate(columns):
        total = total + F.pmod(number(c), F.lit(DRAWS)) * FACTORS[k % len(FACTORS)]
    return F.pmod(total, F.lit(DRAWS))


def sampled(flows: DataFrame, share: float, columns: tuple[str, ...] = TREE_COLUMNS) -> DataFrame:
    """About that share of the rows, the same in every run."""
    return flows.where(draw(columns) < int(DRAWS * share))


def sampled_points(flows: DataFrame, columns: tuple[str, ...], most: int = SAMPLE_POINTS) -> np.ndarray:
    """Coordinates of a sample, at most about ``most`` rows, in the order of their draws, the same in every run."""
    known = flows.dropna(subset=list(columns))
    rows = known.count()
    if rows > most:
        known = sampled(known, most / rows, columns)
    points = known.select(*(coordinate(c).alias(c) for c in columns), draw(columns).alias("__draw"))
    return points.orderBy("__draw", *columns).limit(2 * most).drop("__draw").toPandas().to_numpy(np.float64)


def build_tree(flows: DataFrame, capacity: int, columns: tuple[str, ...] = TREE_COLUMNS, most: int = SAMPLE_POINTS) -> KdTree:
    return KdTree.build(sampled_points(flows, columns, most), capacity)


def leaf_condition(tree: KdTree, columns: tuple[str, ...], node: int = 1) -> Column:
    """The leaf of a row as nested conditions."""
    if node not in tree.splits:
        return F.lit(node).cast("long")
    dim, value = tree.splits[node]
    return F.when(coordinate(columns[dim]) > value, leaf_condition(tree, columns, 2 * node)).otherwise(leaf_condition(tree, columns, 2 * node + 1))


def leaf_function(tree: KdTree, columns: tuple[str, ...]) -> Column:
    """The leaf of a row by an Arrow function over all coordinates."""

    @F.pandas_udf("long")
    def leaf(points: pd.DataFrame) -> pd.Series:
        return pd.Series(tree.route(points.to_numpy(np.float64)))

    return leaf(F.struct(*(coordinate(c).alias(f"c{k}") for k, c in enumerate(columns))))


def with_leaf(flows: DataFrame, tree: KdTree, columns: tuple[str, ...] = TREE_COLUMNS) -> DataFrame:
    """``flows`` with ``part``, the id of the tree's leaf."""
    small = len(tree.splits) < CONDITION_LEAVES
    return flows.withColumn("part", leaf_condition(tree, columns) if small else leaf_function(tree, columns))


def leaf_rank(part: Column, tree: KdTree) -> Column:
    """The rank of a leaf id among all leaf ids, from 0."""
    return F.array_position(F.array(*(F.lit(x).cast("long") for x in tree.leaves())), part) - 1


def write_layout(flows: DataFrame, path: str, tree: KdTree, columns: tuple[str, ...] = TREE_COLUMNS) -> None:
    """The flow table with one folder per leaf."""
    write_partitioned(with_leaf(flows, tree, columns), path, "part", overwrite_all=True)


@dataclass
class Box:
    """Ranges of columns, bounds included; a missing bound is open."""

    low: dict[str, object]
    high: dict[str, object]

    def limits(self, columns: tuple[str, ...]) -> tuple[list[float], list[float]]:
        as_number = lambda c, x: float(pd.Timestamp(x, tz="UTC").value // 10**6) if c.endswith("date") else float(x)
        low = [as_number(c, self.low[c]) if c in self.low else -np.inf for c in columns]
        return low, [as_number(c, self.high[c]) if c in self.high else np.inf for c in columns]

    def condition(self) -> Column:
        """The residual filter: leaves may reach beyond the box."""
        tests = [F.col(c) >= F.lit(x).cast("date" if c.endswith("date") else "long") for c, x in self.low.items()]
        tests += [F.col(c) <= F.lit(x).cast("date" if c.endswith("date") else "long") for c, x in self.high.items()]
        out = F.lit(True)
        for test in tests:
            out &= test
        return out


def prune(table: DataFrame, tree: KdTree, box: Box, columns: tuple[str, ...] = TREE_COLUMNS) -> DataFrame:
    """The rows of a box: only the folders of leaves that meet it are read."""
    leaves = tree.boxed(*box.limits(columns))
    return table.where(F.col("part").isin(leaves) if leaves else F.lit(False)).where(box.condition())


def predicate_text(tree: KdTree, box: Box, columns: tuple[str, ...] = TREE_COLUMNS) -> str:
    """The pruning predicate as SQL text."""
    return "WHERE " + (" OR ".join(f"part='{x}'" for x in tree.boxed(*box.limits(columns))) or "false")


def address_box(source: tuple[str, str] | None = None, target: tuple[str, str] | None = None, dates: tuple[str, str] | None = None) -> Box:
    """A box from dotted addresses and dates."""
    box = Box({}, {})
    number = lambda ip: int.from_bytes(bytes(map(int, ip.split("."))))
    for column, bounds in (("intipfrom", source), ("intipto", target)):
        if bounds:
            box.low[column], box.high[column] = map(number, bounds)
    if dates:
        box.low["flow_date"], box.high["flow_date"] = dates
    return box


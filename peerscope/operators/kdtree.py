"""A k-d tree over the columns that queries filter by; its leaves are the partitions of the fact table.

The root has id 1; the right child of a node has twice its id, the left child one more. A value above the
split goes right. A leaf is split when it holds ``capacity`` points: along the dimension of the widest extent
of its points (the first of equals), at their median, or at their minimum if the median is the maximum. A
leaf whose points are all alike keeps growing. The tree is built on the driver from a bounded sample.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the text format: the nominal bounds of the whole space.
LOWEST, HIGHEST = 4.9e-324, 1.7976931348623157e308


@dataclass
class KdTree:
    dims: int
    capacity: int
    splits: dict[int, tuple[int, float]] = field(default_factory=dict)

    # -- building -------------------------------------------------------------------------------

    @classmethod
    def build(cls, points: np.ndarray, capacity: int) -> KdTree:
        """The tree that results from adding the points one by one."""
        tree = cls(points.shape[1], capacity)
        waiting = [(1, np.asarray(points, np.float64))]
        while waiting:
            node, own = waiting.pop()
            if (found := split_of(own, capacity)) is not None:
                dim, value = tree.splits[node] = found
                right = own[:, dim] > value
                waiting += [(2 * node, own[right]), (2 * node + 1, own[~right])]
        return tree

    def split(self, leaf: int, points: np.ndarray) -> tuple[int, int] | None:
        """Split a leaf by its points; its new children, right first, or None if the points are all alike."""
        found = split_of(np.asarray(points, np.float64), len(points))
        if found is None:
            return None
        self.splits[leaf] = found
        return 2 * leaf, 2 * leaf + 1

    # -- questions ------------------------------------------------------------------------------

    def leaves(self) -> list[int]:
        """Leaf ids in ascending order."""
        found, waiting = [], [1]
        while waiting:
            node = waiting.pop()
            if node in self.splits:
                waiting += [2 * node, 2 * node + 1]
            else:
                found.append(node)
        return sorted(found)

    def is_leaf(self, node: int) -> bool:
        return node not in self.splits and (node == 1 or node // 2 in self.splits)

    def route(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point, level by level for all points at once."""
        points = np.asarray(points, np.float64)
        node = np.ones(len(points), np.int64)
        inner = np.array(sorted(self.splits), np.int64)
        if not len(inner):
            return node
        dims, values = (np.array([self.splits[k][j] for k in inner.tolist()]) for j in (0, 1))
        active = np.arange(len(points))
        while len(active):
            at = np.minimum(np.searchsorted(inner, node[active]), len(inner) - 1)
            inside = inner[at] == node[active]
            active, at = active[inside], at[inside]
            above = points[active, dims[at].astype(np.int64)] > values[at]
            node[active] = 2 * node[active] + ~above
        return node

    def boxed(self, low: list[float], high: list[float]) -> list[int]:
        """The leaves that may hold points of a box, bounds included."""
        found, waiting = [], [1]
        while waiting:
            node = waiting.pop()
            if node not in self.splits:
                found.append(node)
                continue
            dim, value = self.splits[node]
            if low[dim] <= value:
                waiting.append(2 * node + 1)
            if high[dim] > value:
                waiting.append(2 * node)
        return sorted(found)

    def bounds(self, leaf: int) -> list[tuple[float, float]]:
        """The region of a node: per dimension above the first and up to the second number."""
        out = [[LOWEST, HIGHEST] for _ in range(self.dims)]
        node = leaf
        while node > 1:
            parent = node // 2
            dim, value = self.splits[parent]
            side = node & 1  # odd: left
            out[dim][side] = min(out[dim][side], value) if side else max(out[dim][side], value)
            node = parent
        return [(a, b) for a, b in out]

    # -- forms ----------------------------------------------------------------------------------

    def to_text(self) -> str:
        """Header, then nodes in pre-order, left first: level, id, dimension, value, leaf or not, bounds."""
        lines, waiting = [f"{self.dims} {self.capacity}"], [1]
        while waiting:
            node = waiting.pop()
            dim, value = self.splits.get(node, (0, 0.0))
            leaf = node not in self.splits
            edges = " ".join(f"{a!r} {b!r}" for a, b in self.bounds(node))
            lines.append(f"{node.bit_length() - 1} {node} {dim} {value!r} {str(leaf).lower()} {edges}")
            if not leaf:
                waiting += [2 * node, 2 * node + 1]
        return "\n".join(lines) + "\n"

    @classmethod
    def from_text(cls, text: str) -> KdTree:
        header, *lines = text.strip().splitlines()
        tree = cls(*map(int, header.split()))
        for line in lines:
            _, node, dim, value, leaf = line.split()[:5]
            if leaf != "true":
                tree.splits[int(node)] = (int(dim), float(value))
        return tree

    def to_json(self) -> str:
        return json.dumps({"dims": self.dims, "capacity": self.capacity, "splits": {str(k): list(v) for k, v in sorted(self.splits.items())}})

    @classmethod
    def from_json(cls, text: str) -> KdTree:
        found = json.loads(text)
        return cls(found["dims"], found["capacity"], {int(k): (int(d), float(v)) for k, (d, v) in found["splits"].items()})


def split_of(points: np.ndarray, capacity: int) -> tuple[int, float] | None:
    """Where a leaf splits that gets these points one by one, or None if it never does."""
    if len(points) < capacity:
        return None
    first = points[:capacity]
    if (first == first[0]).all():  # alike so far: it grows to the first point that differs
        other = np.flatnonzero((points != points[0]).any(axis=1))
        if not len(other):
            return None
        first = points[: other[0] + 1]
    low, high = first.min(axis=0), first.max(axis=0)
    dim = int((high - low).argmax())
    value = np.sort(first[:, dim])[len(first) // 2]
    return dim, float(low[dim] if value == high[dim] else value)


def nearest(points: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k points nearest to ``query`` by squared Euclidean distance; ties by index."""
    distance = ((points - query) ** 2).sum(axis=1)
    return np.lexsort((np.arange(len(points)), distance))[:k]

"""Sorting strings by hash-compared mergesort.

Prefix polynomial hashes of every string and a binary search over their lengths give the common extension of
two strings in a logarithmic number of steps, so one comparison costs that many. The mergesort works bottom
up, all pairs of runs of a level at once, in NumPy. Common extensions of neighbours are verified on the bytes
at the end; should a hash ever have lied, the strings are sorted by their bytes instead.
"""

from __future__ import annotations

import numpy as np

from peerscope.llm.polyhash import BASES, WEIGHTS, powers


def prefix_table(rows: np.ndarray) -> np.ndarray:
    """For each row of bytes the hashes of its prefixes of 0, 1, ... bytes."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    np.take(WEIGHTS[0], rows, out=out[:, 1:])
    out[:, 1:] *= powers(BASES[0], rows.shape[1])
    np.cumsum(out[:, 1:], axis=1, out=out[:, 1:])
    return out


def common(table: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The common prefix lengths of strings ``a`` and ``b``, by binary search over the prefix hashes."""
    low = np.zeros(len(a), np.int64)
    high = np.minimum(lengths[a], lengths[b])
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) >> 1
        same = table[a, middle] == table[b, middle]
        low = np.where(same & open_, middle, low)
        high = np.where(same | ~open_, high, middle - 1)


def before(rows: np.ndarray, table: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Whether string ``a`` comes before ``b``; ``ties`` where they are equal. A prefix comes before the longer string."""
    size = common(table, lengths, a, b)
    at = np.minimum(size, rows.shape[1] - 1)
    a_ends, b_ends = size >= lengths[a], size >= lengths[b]
    less = rows[a, at] < rows[b, at]
    return np.where(a_ends & b_ends, ties, np.where(a_ends, True, np.where(b_ends, False, less)))


def sorted_in_groups(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the strings, sorted within each group, and each one's common prefix with the one before it.

    ``rows`` holds the bytes, padded; ``group`` is ascending. The first of a group has common prefix -1.
    """
    count = len(rows)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = prefix_table(rows)
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((begin, [count])))
    first, last = np.repeat(begin, size), np.repeat(begin + size, size)
    order, width = np.arange(count), 1
    while (active := np.flatnonzero(last - first > width)).size:
        order = merged(rows, table, lengths, order, first, last, active, width)
        width *= 2
    heads = np.zeros(count, bool)
    heads[begin] = True
    shared = np.full(count, -1, np.int64)
    rest = np.flatnonzero(~heads)
    a, b = order[rest - 1], order[rest]
    shared[rest] = common(table, lengths, a, b)
    if not verified(rows, lengths, a, b, shared[rest]):
        return sorted_by_bytes(rows, lengths, first, heads)
    return order, shared


def merged(rows: np.ndarray, table: np.ndarray, lengths: np.ndarray, order: np.ndarray, first: np.ndarray, last: np.ndarray, active: np.ndarray, width: int) -> np.ndarray:
    """``order`` with neighbouring runs of ``width`` merged: each element's rank in the other run by binary search."""
    run = (active - first[active]) // width
    own = first[active] + run * width
    left = (run & 1) == 0
    other = np.minimum(np.where(left, own + width, own - width), last[active])
    low, high = other.copy(), np.minimum(other + width, last[active])
    element = order[active]
    while (todo := np.flatnonzero(low < high)).size:
        middle = (low[todo] + high[todo]) >> 1
        # equal strings keep their order: those of the left run come first
        after = before(rows, table, lengths, order[middle], element[todo], ~left[todo])
        low[todo] = np.where(after, middle + 1, low[todo])
        high[todo] = np.where(after, high[todo], middle)
    out = order.copy()
    out[np.minimum(own, other) + (active - own) + (low - other)] = element
    return out


def verified(rows: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> bool:
    """Whether neighbours really share that many bytes, no more, and stand in order."""
    place = np.arange(rows.shape[1])
    limit = np.minimum(lengths[a], lengths[b])
    for at in range(0, len(a), 65536):
        part = slice(at, at + 65536)
        differ = (rows[a[part]] != rows[b[part]]) & (place < limit[part, None])
        real = np.where(differ.any(axis=1), differ.argmax(axis=1), limit[part])
        if (real != shared[part]).any():
            return False
    at = np.minimum(shared, rows.shape[1] - 1)
    ended = shared >= limit
    return bool(np.where(ended, lengths[a] <= lengths[b], rows[a, at] < rows[b, at]).all())


def sorted_by_bytes(rows: np.ndarray, lengths: np.ndarray, first: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same result without hashes."""
    strings = [rows[k, : lengths[k]].tobytes() for k in range(len(rows))]
    order = np.array(sorted(range(len(rows)), key=lambda k: (first[k], strings[k])), np.int64)
    shared = np.full(len(rows), -1, np.int64)
    for k in np.flatnonzero(~heads):
        a, b = strings[order[k - 1]], strings[order[k]]
        size = min(len(a), len(b))
        shared[k] = next((n for n in range(size) if a[n] != b[n]), size)
    return order, shared

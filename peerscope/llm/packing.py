"""Packing token sequences into fixed windows by best-fit decreasing.

A document longer than a window is first cut into full windows; what is left of it is shorter than a window.
Pieces are packed longest first, each into the open window with the least room that still holds it. A segment
tree over the remaining capacities finds that window: a node counts the open windows in its range of
capacities, so the tightest capacity of at least n is one walk up and down.

The pieces are dealt to bins of a bounded number of pieces by a hash, and each bin is packed by one task. A
bin leaves at most a few part-filled windows, so padding stays a fraction of a percent at any input size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.blocks import lean, utf8_column
from peerscope.llm.bpe import id_bytes, worker_encoder
from peerscope.llm.rows import free_name
from peerscope.staging import staged

WINDOW = 4096
END_ID = 2
#: Pieces that one task packs together.
BIN_PIECES = 40_000


class CapacityTree:
    """Counts of open windows by remaining capacity, with the smallest capacity of at least n."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, change: int) -> None:
        node = capacity + self.width
        while node:
            self.count[node] += change
            node >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` with an open window, or -1."""
        node = least + self.width
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return -1
            node += 1
            while node < self.width:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.width


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """For each piece its sequence, numbered from 0, and its offset there. Ties go to the earlier piece and the later window."""
    tree, open_windows, used = CapacityTree(window), {}, []
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for piece in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size = lengths[piece]
        capacity = tree.tightest(size)
        if capacity < 0:
            capacity, own = window, len(used)
            used.append(0)
        else:
            own = open_windows[capacity].pop()
            tree.add(capacity, -1)
        sequence[piece], offset[piece] = own, used[own]
        used[own] += size
        if capacity > size:
            open_windows.setdefault(capacity - size, []).append(own)
            tree.add(capacity - size, 1)
    return sequence, offset


def token_pieces(documents: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces of every document's ids followed by ``end_id``: full windows, then the rest.

    Columns ``doc_id, start, length, ids_crc32, doc_tokens``. A null or empty text is the single id ``end_id``.
    Repeated rows are documents of their own.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(path, id_bytes), id_bytes([end_id])
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            out, owner = [], []
            for row, values in enumerate(encoder.rows(data, offsets)):
                ids = b"".join(values) + end
                for at in range(0, len(ids), 4 * window):
                    part = ids[at : at + 4 * window]
                    owner.append(row)
                    out.append((at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
            table = np.array(out, np.int64).reshape(-1, 4)
            arrays = [batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(table[:, k]) for k in range(4))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(pieces: DataFrame, window: int = WINDOW, bin_pieces: int = BIN_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` is read twice, so give a written table.

    Every piece is placed once; the offsets of a sequence run from 0 without gaps to at most ``window``. Rows
    that are alike in all columns are separate pieces, dealt to all bins. Pieces of equal length are taken in the
    order of their ids and starts. An empty table stays empty.
    """
    bins, bin_name = max(1, -(-pieces.count() // bin_pieces)), free_name(pieces, "bin")
    # the row's number deals out rows that are alike, too; reading the same files again gives the same numbers
    dealt = pieces.withColumn(bin_name, F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(bins)).cast("long"))

    def run(group: pa.Table) -> pa.Table:
        order = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        sequence, offset = best_fit_decreasing(order["length"].to_pylist(), window)
        first = order[bin_name][0].as_py() << 32
        return order.drop_columns([bin_name]).append_column("sequence_id", pa.array(np.array(sequence, np.int64) + first)).append_column("offset", pa.array(offset, pa.int64()))

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in pieces.schema)
    return dealt.groupBy(bin_name).applyInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(documents: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, bin_pieces: int = BIN_PIECES) -> DataFrame:
    """Pieces of all documents with their place in padded sequences of ``window`` ids.

    Null and empty texts are the single id ``end_id``; null and repeated ids are documents of their own; texts of any
    length are cut into full windows; other columns are left out.
    """
    return pack(staged(token_pieces(documents, path, window, end_id), "pieces"), window, bin_pieces)

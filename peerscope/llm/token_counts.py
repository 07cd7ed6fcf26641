"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks whose tokens carry their offsets. Two neighbouring chunks
are spliced where both have a token that begins at the same offset and at a place that parts tokens in any text:
behind white space, or for other tokenizers at a space between letters or digits. From there on both encodings
are those of the whole text. Where an overlap holds no such place, it is widened until one is found or the next
chunk is used up. A tokenizer without proven places encodes texts whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.blocks import lean, row_ranges, utf8_column
from peerscope.llm.bpe import FragmentEncoder, LibraryEncoder, worker_encoder

CHUNK_BYTES = 32 << 10
OVERLAP_BYTES = 1 << 10


def chunk_spans(size: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of about ``chunk`` bytes, each sharing ``overlap`` bytes with the next."""
    spans, at = [], 0
    while True:
        spans.append((at, min(size, at + chunk)))
        if at + chunk >= size:
            return spans
        at += chunk - overlap


def on_characters(data: np.ndarray, at: int) -> int:
    """``at`` moved back to the first byte of a UTF-8 character."""
    while at > 0 and at < len(data) and (data[at] & 0xC0) == 0x80:
        at -= 1
    return at


class Counter:
    def __init__(self, encoder: FragmentEncoder | LibraryEncoder, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES):
        self.encoder, self.chunk, self.overlap = encoder, chunk, overlap

    def spliced(self, text: np.ndarray) -> tuple[int, int, int]:
        """Tokens, chunks and widened overlaps of one text."""
        spans = [(on_characters(text, a), on_characters(text, b)) for a, b in chunk_spans(len(text), self.chunk, self.overlap)]
        total = widened = 0
        begin, end = spans[0]
        now = self.encoder.counted(text, begin, end)
        left, at = 0, 1  # tokens that begin before ``left`` are counted
        while at < len(spans):
            # where no place was found for long, a later chunk is tried: what is encoded again grows with what it adds
            at = min(len(spans) - 1, at + (end - left) // (4 * self.chunk))
            begin, stop = spans[at]
            new = self.encoder.counted(text, begin, stop)
            more = max(self.overlap, begin - end + self.overlap)
            while True:
                start, _, stable, anew = now
                # the last word of a span may go on behind it, so a place must lie before its end
                common = np.intersect1d(start[stable & (start >= begin)], new[0][new[2] & (new[0] < end)])
                if len(common) or end >= stop:
                    break
                end, more, widened = on_characters(text, min(stop, end + more)), more * 2, widened + 1
                kept = (start < begin) & anew & (start >= left)
                base = int(start[kept][-1]) if kept.any() else left
                same = start < base
                now = tuple(np.concatenate((x[same], y)) for x, y in zip(now, self.encoder.counted(text, base, end), strict=True))
            if len(common):
                place = int(common[0])
                total += int(now[1][(start >= left) & (start < place)].sum())
                now, left, end = new, place, stop
            else:  # widened over the whole next chunk
                end = stop
            at += 1
        return total + int(now[1][now[0] >= left].sum()), len(spans), widened

    def count(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Tokens, chunks and widened overlaps of every row."""
        for first, last in row_ranges(offsets):
            sizes = np.diff(offsets[first : last + 1])
            long = (sizes > self.chunk) & self.encoder.divisible
            bounds = np.concatenate(([0], np.cumsum(np.where(long, 0, sizes))))
            if long.any():
                block = np.concatenate([data[offsets[first + r] : offsets[first + r + 1]] for r in np.flatnonzero(~long)] or [np.zeros(0, np.uint8)])
            else:
                block = data[offsets[first] : offsets[last]]
            tokens = self.encoder.row_counts(block, bounds)
            for r in range(last - first):
                yield self.spliced(data[offsets[first + r] : offsets[first + r + 1]]) if long[r] else (int(tokens[r]), 1, 0)


def count_tokens(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """Token counts of every whole text, as the library counts them without added special tokens.

    Returns one row per input row: ``doc_id``, ``n_bytes``, ``n_tokens``, ``n_chunks``, ``n_widened``. Null and
    empty texts have no bytes and no tokens; repeated rows and null ids are counted each; other columns are left out;
    an empty table gives no rows. ``path`` names a tokenizers ``.json`` or a sentencepiece ``.model``.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(worker_encoder(path, len), chunk, overlap).count
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            out = np.array(list(count(data, offsets)), np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), *(pa.array(out[:, k]) for k in range(3))], ["doc_id", "n_bytes", "n_tokens", "n_chunks", "n_widened"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, n_chunks bigint, n_widened bigint")

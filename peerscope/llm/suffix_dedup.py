"""Suffix-array deduplication: removal of byte strings that occur earlier in the corpus.

A byte is removed if a string of ``span`` bytes that covers it also starts earlier (smaller id, or same
document and earlier start). The suffix array is sparse. Among the grams (strings of GRAM bytes) of any span
the one with the smallest hash is an *anchor*; equal spans have equal anchors at the same place, so it is
enough to compare the suffixes and the reversed prefixes at anchors:

1. Anchors of all documents, with the hash of their gram and of their context (all bytes of the spans that
   hold the gram). Within a batch, of equal contexts all but the first are covered at once and leave as a span.
2. By gram, in sorted order and constant memory: of equal contexts all but the first are covered; where a gram
   has several contexts, their first occurrences are candidates.
3. Candidates get the bytes of their context and are sorted by what follows and, reversed, by what precedes
   the anchor (``suffix_sort``). Two occurrences share a span that starts l bytes before the anchor exactly if
   they have l bytes before and span - l bytes after in common: runs of neighbours with long enough
   extensions in both orders. All but the first occurrence of such a class are covered.
4. A gram with more contexts than one task should sort is refined: spans that start at most half as far before the
   anchor as any may, and the others, become groups of their own. A group's key is the hash of the bytes that all its
   spans have in common, and its contexts are that much narrower; of equal ones all but the first are covered, by a
   grouped minimum over their bytes. What is left is sorted, or refined again, down to single starts.
5. The covered spans are united, meet their documents and are cut out.

Ids must tell rows apart; where they don't, rows are numbered first, so that each stays a document of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.blocks import lean, utf8_column
from peerscope.llm.polyhash import PrefixHash, mixed
from peerscope.llm.rows import free_name, numbered, told_apart
from peerscope.llm.suffix_sort import sorted_in_groups
from peerscope.staging import scratch, staged

SPAN, GRAM = 100, 32
#: Bytes of text hashed at once, and the bytes around a part of a long document that its anchors depend on.
PART_BYTES, HALO = 1 << 19, 256
#: Contexts of one gram beyond which it is refined instead of being sorted in one task.
MOST_CONTEXTS = 5_000
#: Contexts that are sorted together; their prefix hashes and byte matrices take about 5 KB each.
SORTED_TOGETHER = 12_000
PLACE_BITS = 40
CONTEXTS = "gram long, low int, high int, id long, place long, before int, context binary"


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each window of ``width`` values, by doubling."""
    out, done = values, 1
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return pick(out[: len(values) - width + 1], out[width - done :]) if done < width else out


def parts(offsets: np.ndarray, span: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, begin, end) that cover all rows of at least ``span`` bytes; a group has about PART_BYTES."""
    group, size = [], 0
    for row, length in enumerate(np.diff(offsets).tolist()):
        for at in range(0, length if length >= span else 0, PART_BYTES):
            group.append((row, at, min(length, at + PART_BYTES)))
            size += group[-1][2] - at
            if size >= PART_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def anchors(data: np.ndarray, offsets: np.ndarray, group: list[tuple[int, int, int]], span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row, gram hash and context hash of the anchors in a group of parts."""
    reach = span - gram
    pieces, lead, bounds = [], [], [0]
    for row, begin, end in group:
        low, high = max(0, begin - HALO), min(int(offsets[row + 1] - offsets[row]), end + HALO)
        pieces.append(data[offsets[row] + low : offsets[row] + high])
        lead.append(begin - low)
        bounds.append(bounds[-1] + high - low)
    block, edges = np.concatenate(pieces), np.array(bounds, np.int64)
    hashes = PrefixHash(block)
    grams = mixed(hashes.grams(gram))
    order = np.minimum(grams >> np.uint64(32), 0xFFFFFFFE).astype(np.uint32)
    for edge in bounds[1:-1]:  # grams across two pieces never win
        order[max(0, edge - gram + 1) : edge] = 0xFFFFFFFF
    least = sliding(order, reach + 1, np.minimum)
    padded = np.concatenate((np.zeros(reach, np.uint32), least, np.zeros(reach, np.uint32)))
    places = np.flatnonzero((sliding(padded, reach + 1, np.maximum) == order) & (order != 0xFFFFFFFF))
    piece = np.searchsorted(edges, places, side="right") - 1
    rows, begins, ends = (np.array(x, np.int64) for x in zip(*group, strict=True))
    local = places - edges[piece] - np.array(lead, np.int64)[piece] + begins[piece]
    own = (local >= begins[piece]) & (local < ends[piece])
    places, piece, local = places[own], piece[own], local[own]
    row = rows[piece]
    before = np.minimum(local, reach)
    after = np.minimum((offsets[row + 1] - offsets[row]) - local, span)
    context = PrefixHash(block, 1).spans(places - before, places + after)
    context = mixed(context + (before * (span + 1) + after).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row, local, grams[places].view(np.int64), context.view(np.int64)


def united(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of the same row joined."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    # rows far apart on one axis, so that one running maximum serves all
    shift = (np.cumsum(np.concatenate(([0], row[1:] != row[:-1])))) * (int(end.max()) + 2)
    reached = np.maximum.accumulate(end + shift)
    first = np.concatenate(([True], start[1:] + shift[1:] > reached[:-1]))
    at = np.flatnonzero(first)
    return row[at], start[at], (reached - shift)[np.concatenate((at[1:] - 1, [len(row) - 1]))]


def anchor_rows(batch: pa.RecordBatch, span: int, gram: int) -> pa.RecordBatch | None:
    """The anchors of a batch, and as rows with a length the spans that repeat an earlier row of the batch."""
    data, offsets = utf8_column(batch.column("text"))
    ids = np.asarray(batch.column("id"))
    found = [anchors(data, offsets, group, span, gram) for group in parts(offsets, span)]
    if not found:
        return None
    row, place, key, context = (np.concatenate(x) for x in zip(*found, strict=True))
    both = mixed(key.view(np.uint64) ^ mixed(context.view(np.uint64)))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    again = np.zeros(len(order), bool)
    if same.any():
        member = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        member = member[np.lexsort((place[member], ids[row[member]], context[member], key[member]))]
        new = np.concatenate(([True], (key[member[1:]] != key[member[:-1]]) | (context[member[1:]] != context[member[:-1]])))
        again[member] = ~new
    sizes = np.diff(offsets)
    covered = united(row[again], np.maximum(0, place[again] - (span - gram)), np.minimum(sizes[row[again]], place[again] + span))
    limit = (1 << (63 - PLACE_BITS)) - 1  # a longer span leaves in parts
    if len(covered[0]) and int((covered[2] - covered[1]).max()) > limit:
        split = [(r, a, min(b, a + limit)) for r, s, b in zip(*covered, strict=True) for a in range(int(s), int(b), limit)]
        covered = tuple(np.array(x, np.int64) for x in zip(*split, strict=True))
    row, place, key, context = row[~again], place[~again], key[~again], context[~again]
    spread = mixed((np.arange(len(covered[0]), dtype=np.uint64) << np.uint64(32)) ^ ids[covered[0]].view(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((key, spread))),
            pa.array(np.concatenate((context, np.zeros(len(spread), np.int64)))),
            pa.array(ids[np.concatenate((row, covered[0]))]),
            pa.array(np.concatenate((place, ((covered[2] - covered[1]) << PLACE_BITS) + covered[1]))),
        ],
        ["gram", "context", "id", "place"],
    )


def matched(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """From anchors sorted by gram, context, id and place: covered spans and candidates, in constant memory.

    ``held`` is the first row of the running gram as long as it has one context only.
    """
    running = (None, None)
    held: tuple[int, int] | None = None
    reach = span - gram
    for batch in batches:
        columns = [np.asarray(batch.column(k)) for k in ("gram", "context", "id", "place")]
        ready = columns[3] >> PLACE_BITS > 0
        out = [(columns[2][ready], columns[3][ready] & ((1 << PLACE_BITS) - 1), columns[3][ready] >> PLACE_BITS, None)]
        key, context, ids, place = (x[~ready] for x in columns)
        if len(key):
            new_key = np.concatenate(([key[0] != running[0]], key[1:] != key[:-1]))
            new = new_key | np.concatenate(([context[0] != running[1]], context[1:] != context[:-1]))
            start = np.maximum(0, place[~new] - reach)
            out.append((ids[~new], start, place[~new] + span - start, None))
            group = np.cumsum(new_key)  # 0: goes on from the batch before
            firsts = np.bincount(group[new], minlength=group[-1] + 1)
            if not new_key[0]:
                # a held row counts for the running gram; without one it has several contexts already
                firsts[0] += 1 if held is not None else 2
            several = new & (firsts[group] > 1)
            if held is not None and not new_key[0] and firsts[0] > 1:
                out.append((np.array([held[0]]), np.array([held[1]]), np.zeros(1, np.int64), np.array([running[0]])))
                held = None
            out.append((ids[several], place[several], np.zeros(int(several.sum()), np.int64), key[several]))
            if group[-1] > 0:
                last = np.flatnonzero(new_key)[-1]
                held = (int(ids[last]), int(place[last])) if firsts[group[-1]] == 1 else None
            running = (key[-1], context[-1])
        for owner, start, length, grams in out:
            if len(owner):
                keys = pa.nulls(len(owner), pa.int64()) if grams is None else pa.array(grams)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(start), pa.array(length), keys], ["id", "start", "length", "gram"])


def context_rows(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The context bytes of the candidates of each document."""
    reach = span - gram
    for batch in batches:
        data, offsets = utf8_column(batch.column("text"))
        ids, marks = np.asarray(batch.column("id")), batch.column("marks")
        bounds = np.asarray(marks.offsets)
        values = marks.values
        place, keys = np.asarray(values.field("start")), np.asarray(values.field("gram"))
        for first in range(0, batch.num_rows, 256):
            last = min(batch.num_rows, first + 256)
            row = np.repeat(np.arange(first, last), np.diff(bounds[first : last + 1]))
            at, key = place[bounds[first] : bounds[last]], keys[bounds[first] : bounds[last]]
            size = (offsets[1:] - offsets[:-1])[row]
            before, after = np.minimum(at, reach), np.minimum(size - at, span)
            begin = offsets[row] + at - before
            width = before + after
            if not len(row):
                continue
            ends = np.concatenate(([0], np.cumsum(width)))
            flat = data[np.repeat(begin - ends[:-1], width) + np.arange(ends[-1])]
            yield context_batch(key, np.zeros(len(row)), np.full(len(row), reach), ids[row], at, before, flat, ends)


def context_batch(key: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, place: np.ndarray, before: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Contexts as rows of CONTEXTS; ``low`` and ``high`` bound how far before the anchor a span of the group starts."""
    context = pa.BinaryArray.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
    small = [pa.array(x.astype(np.int32)) for x in (low, high, before)]
    return pa.RecordBatch.from_arrays([pa.array(key), *small[:2], pa.array(ids), pa.array(place), small[2], context], ["gram", "low", "high", "id", "place", "before", "context"])


def context_matrices(context: pa.Array, before: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes behind each anchor, bytes before it in reverse, and how many there are behind it."""
    data, offsets = utf8_column(context)
    size = np.diff(offsets)
    after = size - before
    anchor = offsets[:-1] + before
    right, left = np.arange(span), np.arange(span - gram)
    behind = np.take(data, anchor[:, None] + right, mode="clip")
    ahead = np.take(data, anchor[:, None] - 1 - left, mode="clip")
    behind[right >= after[:, None]] = 0
    ahead[left >= before[:, None]] = 0
    return behind, ahead, after


def repeated_contexts(key: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray, context: pa.Array, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose spans occur in an earlier row with the same key, and their covered bytes relative to the anchor.

    Rows come sorted by key, id and place; only spans that start ``low`` to ``high`` bytes before the anchor count.
    """
    behind, ahead, after = context_matrices(context, before, span, gram)
    count = len(key)
    orders = [sorted_in_groups(behind, after, key), sorted_in_groups(ahead, before, key)]
    earliest, latest = np.full(count, span, np.int64), np.full(count, -1, np.int64)  # bytes before the anchor
    for ahead_bytes in range(int(low.min()), int(high.max()) + 1):
        classes = []
        for (order, shared), least in zip(orders, (span - ahead_bytes, ahead_bytes), strict=True):
            own = np.empty(count, np.int64)
            own[order] = np.cumsum(shared < least)
            classes.append(own)
        fits = np.flatnonzero((before >= ahead_bytes) & (after >= span - ahead_bytes) & (low <= ahead_bytes) & (high >= ahead_bytes))
        if not len(fits):
            continue
        pair = classes[0][fits] * (count + 1) + classes[1][fits]
        order = np.argsort(pair, kind="stable")  # rows keep their order within a class: the first stays
        again = fits[order[1:][pair[order[1:]] == pair[order[:-1]]]]
        earliest[again] = np.minimum(earliest[again], ahead_bytes)
        latest[again] = np.maximum(latest[again], ahead_bytes)
    rows = np.flatnonzero(latest >= 0)
    return rows, -latest[rows], span - earliest[rows]


def sorted_contexts(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Covered spans found by sorting the contexts of whole groups, SORTED_TOGETHER rows or one group at a time."""
    waiting: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        key, low, high, ids, place, before = (np.asarray(table[k].combine_chunks()).astype(np.int64) for k in ("gram", "low", "high", "id", "place", "before"))
        rows, begin, end = repeated_contexts(key, low, high, before, table["context"].combine_chunks(), span, gram)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(place[rows] + begin), pa.array(end - begin)], ["id", "start", "length"])

    for batch in batches:
        waiting.append(batch)
        if sum(x.num_rows for x in waiting) >= SORTED_TOGETHER:
            table = pa.Table.from_batches(waiting)
            keys = np.asarray(table["gram"].combine_chunks())
            whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if whole:
                yield from done(table.slice(0, whole))
                waiting = table.slice(whole).to_batches()
    if waiting and sum(x.num_rows for x in waiting):
        yield from done(pa.Table.from_batches(waiting))


def halved(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Each context once for either half of its group's starts, cut down to the bytes of those spans.

    The new key is the hash of the bytes that all spans of the half hold, so those who share a span share the key.
    """
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            part = batch.slice(first, 4096)
            data, offsets = utf8_column(part.column("context"))
            low, high, ids, place, before = (np.asarray(part.column(k)).astype(np.int64) for k in ("low", "high", "id", "place", "before"))
            after, middle = np.diff(offsets) - before, (low + high) // 2
            hashes, base = PrefixHash(data[offsets[0] : offsets[-1]]), int(offsets[0])
            for least, most in ((low, middle), (middle + 1, high)):
                row = np.flatnonzero((least <= most) & (before >= least) & (after >= span - most))
                if not len(row):
                    continue
                own_low, own_high, anchor = least[row], most[row], offsets[row] + before[row]
                core = hashes.spans(anchor - own_low - base, anchor + span - own_high - base)
                key = mixed(core + (own_low * (span + 1) + own_high).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                left = np.minimum(before[row], own_high)
                width = left + np.minimum(after[row], span - own_low)
                ends = np.concatenate(([0], np.cumsum(width)))
                flat = data[np.repeat(anchor - left - ends[:-1], width) + np.arange(ends[-1])]
                yield context_batch(key, own_low, own_high, ids[row], place[row], left, flat, ends)


def span_lists(spans: DataFrame) -> DataFrame:
    """One row per id with its spans (start, end) united, in order. A task holds the spans of one document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            ids, start, length = (np.asarray(batch.column(k)) for k in ("id", "start", "length"))
            if not len(ids):
                continue
            ids, start, end = united(*(np.concatenate(x) for x in zip(held, (ids, start, start + length), strict=True)))
            last = int(np.searchsorted(ids, ids[-1]))  # the last document may go on
            yield from listed(ids[:last], start[:last], end[:last])
            held = (ids[last:], start[last:], end[last:])
        yield from listed(*held)

    def listed(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(ids):
            at = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            pairs = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pairs)], ["id", "spans"])

    return spans.repartition("id").sortWithinPartitions("id", "start").mapInArrow(lean(run), "id long, spans array<struct<start:long,end:long>>")


def repeated_spans(documents: DataFrame, span: int = SPAN, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """Spans ``id, start, length`` whose bytes all lie in a string that occurs earlier; they may overlap.

    Ids must be integers, different and not null. Texts under ``span`` bytes, empty and null ones have none.
    """
    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (x for b in batches if (x := anchor_rows(b, span, gram)) is not None)

    def by_sorting(contexts: DataFrame) -> DataFrame:
        ordered = contexts.repartition("gram").sortWithinPartitions("gram", "id", "place")
        return ordered.mapInArrow(lean(lambda b: sorted_contexts(b, span, gram)), "id long, start long, length long")

    keys = texts.mapInArrow(lean(first), "gram long, context long, id long, place long")
    ordered = keys.repartition("gram").sortWithinPartitions("gram", "context", "id", "place")
    found = staged(ordered.mapInArrow(lean(lambda b: matched(b, span, gram)), "id long, start long, length long, gram long"), "matches")
    covered = found.where("gram is null").select("id", "start", "length")
    candidates = found.where("gram is not null")
    marks = candidates.groupBy("id").agg(F.collect_list(F.struct("start", "gram")).alias("marks"))
    contexts = texts.join(marks, "id").mapInArrow(lean(lambda b: context_rows(b, span, gram)), CONTEXTS)
    large = candidates.groupBy("gram").count().where(F.col("count") > most_contexts).select("gram")
    if not large.isEmpty():
        contexts = staged(contexts, "contexts")
    while not large.isEmpty():
        large = staged(large, "large")
        covered = covered.union(by_sorting(contexts.join(large, "gram", "left_anti")))
        halves = staged(contexts.join(large, "gram", "left_semi").mapInArrow(lean(lambda b: halved(b, span)), CONTEXTS), "halves")
        alike = ["gram", "low", "high", "before", "context"]
        # written, so that the join reads both sides by plain shuffles and a large group can be split among tasks
        firsts = staged(halves.groupBy(*alike).agg(F.min(F.struct("id", "place")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
        again = halves.join(firsts.where("n > 1"), alike).where("id <> first.id or place <> first.place")
        covered = covered.union(again.select("id", (F.col("place") - F.col("before")).alias("start"), F.length("context").cast("long").alias("length")))
        contexts = firsts.select("gram", "low", "high", "first.id", "first.place", "before", "context")
        large = contexts.groupBy("gram").count().where(F.col("count") > most_contexts).select("gram")
    return covered.union(by_sorting(contexts))


def cut_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes outside the spans, which are in order and apart."""
    keep = np.ones(len(data), bool)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        keep[a:b] = False
    return data[keep]


def whole_characters(data: np.ndarray, start: int, end: int) -> tuple[int, int]:
    """The part of a span that holds whole UTF-8 characters."""
    while start < end and (data[start] & 0xC0) == 0x80:
        start += 1
    while start < end and end < len(data) and (data[end] & 0xC0) == 0x80:
        end -= 1
    return start, end


def remove_repeats(documents: DataFrame, span: int = SPAN, id_column: str = "doc_id", text_column: str = "text", most_contexts: int = MOST_CONTEXTS, keep_columns: bool = False) -> DataFrame:
    """Documents without the bytes that repeat an earlier string of ``span`` bytes.

    Returns ``doc_id, n_bytes, n_removed, n_spans, spans, kept``: the maximal removed runs as (start, end) and the
    remaining bytes put together. With ``keep_columns`` instead the input's columns, with the text cut at whole
    characters only, and without documents of which nothing is left. Null and empty texts lose nothing (they
    are kept as they are). Every row is a document: rows of equal ids come in the order of their texts' digests,
    rows that are alike in the order in which they are read, and a null id comes before any other. Texts may be as
    long as a row can be; other columns may have any name. An empty table gives no rows.
    """
    rows, key = documents, id_column
    if not told_apart(documents, id_column):
        key = free_name(documents, "__row")
        rows = numbered(documents, id_column, text_column, key, nulls_first=True)
    with scratch():
        found = staged(span_lists(repeated_spans(rows, span, GRAM, key, text_column, most_contexts)), "spans", outlive=True)
    own_id, own_spans = free_name(rows, "__id"), free_name(rows, "__spans")
    lists = found.select(F.col("id").alias(own_id), F.col("spans").alias(own_spans))
    joined = rows.join(lists, F.col(key) == F.col(own_id), "left")
    joined = joined.drop(own_id, *([key] if key != id_column else []))
    if keep_columns:
        text_name = text_column
    else:
        joined, text_name = joined.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(own_spans).alias("spans")), "text"
        own_spans = "spans"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_column(batch.column(text_name))
            spans = batch.column(own_spans)
            bounds = np.asarray(spans.offsets).astype(np.int64)
            size = np.diff(offsets)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            start, end = (np.asarray(spans.values.field(k))[bounds[0] : bounds[-1]] for k in ("start", "end"))
            end = np.minimum(end, size[row])  # the bytes that a context lacks at the end of its text
            limits = bounds - bounds[0]
            if keep_columns:
                texts = batch.column(text_name).to_pylist()
                kept = np.ones(batch.num_rows, bool)
                for k in np.unique(row).tolist():
                    own = data[offsets[k] : offsets[k + 1]]
                    parts_ = [whole_characters(own, a, b) for a, b in zip(start[limits[k] : limits[k + 1]].tolist(), end[limits[k] : limits[k + 1]].tolist(), strict=True)]
                    left = cut_spans(own, *np.array(parts_, np.int64).T)
                    texts[k], kept[k] = left.tobytes().decode("utf-8", "replace"), len(left) > 0
                columns = [pa.array(texts, pa.string()) if name == text_name else batch.column(name) for name in batch.schema.names if name != own_spans]
                yield pa.RecordBatch.from_arrays(columns, [x for x in batch.schema.names if x != own_spans]).filter(pa.array(kept))
                continue
            for first in range(0, batch.num_rows, 1024):
                last = min(batch.num_rows, first + 1024)
                left = [cut_spans(data[offsets[k] : offsets[k + 1]], start[limits[k] : limits[k + 1]], end[limits[k] : limits[k + 1]]).tobytes() for k in range(first, last)]
                part = slice(limits[first], limits[last])
                pairs = pa.StructArray.from_arrays([pa.array(start[part]), pa.array(end[part])], ["start", "end"])
                listed = pa.ListArray.from_arrays(pa.array((limits[first : last + 1] - limits[first]).astype(np.int32)), pairs)
                removed = size[first:last] - np.array([len(x) for x in left], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(size[first:last]), pa.array(removed), pa.array(np.diff(limits[first : last + 1]).astype(np.int64)), listed, pa.array(left, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
                )

    if keep_columns:
        return joined.mapInArrow(lean(run), documents.schema)
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")

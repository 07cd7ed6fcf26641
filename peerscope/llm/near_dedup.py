"""Near-duplicate linking with HyperMinHash sketches.

A document's set are its distinct word shingles. The sketch has REGISTERS buckets; each keeps of the smallest
hash that falls into it the number of leading zeros and the first mantissa bits, packed into 16 bits, or 0 if
it is empty. Bands of registers give keys, with wider registers where a band's others are empty; documents with a
key in common are candidates. The share of equal
registers, less the collisions expected by chance, estimates the Jaccard similarity; what may reach the
threshold is verified on the full sets. Links make components.

No bucket is expanded into all its pairs. Equal sets are one class from the start. Then every member is
compared with the smallest member of its bucket, which joins nearly all that belongs together. Only where a
bucket still holds several components are members of different components compared, by sketch and then, for
those with a similar sketch, by set; what comes out are links, not pairs. A large bucket is dealt to blocks, by the
sizes of the sets and a hash, and a task compares two blocks: all pairs whose sizes allow the threshold meet once,
however large the bucket, and no task holds more than two blocks of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.llm.blocks import lean, row_ranges, utf8_column
from peerscope.llm.components import components
from peerscope.llm.polyhash import PrefixHash, mixed
from peerscope.llm.rows import free_name, numbered, told_apart
from peerscope.staging import scratch, staged

REGISTERS, BANDS = 128, 32
MANTISSA = 10
VALUE_BITS = 64 - 7  # what is left of a hash after the bucket's number
#: Mantissa bits of a band's registers in its key, by how many of them are filled: 64 bits in all, 6 of each for the zeros.
BAND_MANTISSA = np.array([0, 51, 26, 15, MANTISSA])
#: A sketch estimate this far below the threshold rules a pair out; over five standard deviations at 0.8.
MARGIN = 0.2
#: Members of a block; a bucket of up to two blocks is compared in one piece.
BLOCK = 500
#: Members, and bytes of theirs, that a task takes up before it compares the buckets that are complete.
HELD_ROWS, HELD_BYTES = 4000, 16 << 20
PART_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
STEPS = mixed(np.arange(1, 65, dtype=np.uint64))
#: The side that a member's partners in a pair of blocks are on; side 0 is that of a block compared with itself.
PARTNER = np.array([0, 2, 1])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending, one row after the other, and their n + 1 bounds."""
    held, counts = [], []
    for first, last in row_ranges(offsets, PART_BYTES):
        block = LOWER[data[offsets[first] : offsets[last]]]
        bounds = offsets[first : last + 1] - offsets[first]
        if not len(block):
            counts += [0] * (last - first)
            continue
        solid = ~SPACE[block]
        edge = np.zeros(len(block) + 1, bool)
        edge[1:-1] = solid[1:] != solid[:-1]
        edge[bounds] = True
        places = np.flatnonzero(edge)
        start, end = places[:-1], places[1:]
        own = solid[start]
        start, end = start[own], end[own]
        word = mixed(PrefixHash(block).spans(start, end) + (end - start).astype(np.uint64))
        limits = np.searchsorted(start, bounds)
        many = np.diff(limits)
        size = max(0, len(word) - words + 1)
        shingle = np.zeros(len(word), np.uint64)
        for k in range(words):
            shingle[:size] += word[k : k + size] * STEPS[k]
        shingle = mixed(shingle)
        for row in range(last - first):
            a, n = int(limits[row]), int(many[row])
            if n >= words:
                own_set = np.sort(shingle[a : a + n - words + 1])
                own_set = own_set[np.concatenate(([True], own_set[1:] != own_set[:-1]))]
            elif n:  # the whole sequence, told apart from shingles by its length
                own_set = mixed((word[a : a + n] * STEPS[:n]).sum(dtype=np.uint64, keepdims=True) + STEPS[32 + n])
            else:
                own_set = shingle[:0]
            held.append(own_set)
            counts.append(len(own_set))
    return np.concatenate(held or [np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def minima(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set the smallest hash of each bucket, its first 53 bits; 0 where the bucket is empty."""
    rows = len(bounds) - 1
    out = np.zeros((rows, REGISTERS), np.uint64)
    cell = np.repeat(np.arange(rows), np.diff(bounds)) * REGISTERS + (sets >> np.uint64(VALUE_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    value = (sets[first] & np.uint64((1 << VALUE_BITS) - 1)) >> np.uint64(VALUE_BITS - 53)
    out.ravel()[cell[first]] = np.maximum(value, np.uint64(1))
    return out


def compressed(values: np.ndarray, mantissa: np.ndarray | int) -> np.ndarray:
    """Leading zeros, plus one, and that many bits behind the first one of each value; 0 for an empty bucket."""
    exponent = np.frexp(values.astype(np.float64))[1]  # exact: 53 bits
    keep = np.asarray(mantissa, np.int64)
    shift = np.maximum(exponent - 1 - keep, 0).astype(np.uint64)
    bits = (values >> shift) & ((np.uint64(1) << keep.astype(np.uint64)) - np.uint64(1))
    return np.where(values == 0, np.uint64(0), ((54 - exponent).astype(np.uint64) << keep.astype(np.uint64)) | bits)


def sketches(least: np.ndarray) -> np.ndarray:
    """The 16-bit registers of each row of minima."""
    return compressed(least, MANTISSA).astype(np.uint16)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of each row of minima; 0 where all of a band's buckets are empty.

    A band has 64 bits for its registers. Where some are empty, as in small sets, the others are wider, so that sets
    without a common shingle don't share keys, however few registers they fill.
    """
    width = REGISTERS // BANDS
    grouped = least.reshape(len(least), BANDS, width)
    filled = (grouped != 0).sum(axis=2)
    packed = compressed(grouped, BAND_MANTISSA[filled][:, :, None])
    keys = mixed((mixed(packed) * STEPS[48 : 48 + width]).sum(axis=2, dtype=np.uint64) ^ STEPS[:BANDS])
    return np.where(filled == 0, 0, keys).view(np.int64)


def cell_chances(size: float) -> np.ndarray:
    """For a set of that size the chance of each register value in one bucket."""
    exponents = np.arange(0, 54)
    edges = np.concatenate(([0.0], (2.0 ** -exponents[::-1, None] * (0.5 + np.arange(1 << MANTISSA) / (2 << MANTISSA))[None, :]).ravel(), [1.0]))
    return -np.diff(np.exp((size / REGISTERS) * np.log1p(-np.minimum(edges, 1 - 1e-12))))


_chance: list[np.ndarray] = []


def collision_share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of registers of unrelated sets of those sizes that are equal by chance."""
    if not _chance:
        cells = np.stack([cell_chances(2.0**k) for k in range(25)])
        _chance.append(cells @ cells.T)
    place = [np.clip(np.rint(np.log2(np.maximum(x, 1))), 0, 24).astype(int) for x in (a, b)]
    return _chance[0][place[0], place[1]]


def estimated(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketches, corrected for registers that are equal by chance."""
    some = (a != 0) | (b != 0)
    both = some.sum(axis=-1)
    equal = ((a == b) & some).sum(axis=-1) / np.maximum(both, 1)
    chance = collision_share(size_a, size_b)
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def summaries(documents: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """``id, n_shingles, digest, registers, keys`` of each document."""
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            for first in range(0, batch.num_rows, 512):
                last = min(batch.num_rows, first + 512)
                sets, bounds = shingle_sets(data, offsets[first : last + 1], words)
                least = minima(sets, bounds)
                registers = sketches(least)
                # equal sets have equal sums of hashes, and equal sums of remixed hashes
                sums = [np.concatenate(([0], np.cumsum(x, dtype=np.uint64))) for x in (mixed(sets ^ STEPS[40]), mixed(sets ^ STEPS[41]))]
                digest = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], axis=1)
                keys = band_keys(least)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, last - first),
                        pa.array(np.diff(bounds)),
                        pa.array([x.tobytes() for x in digest], pa.binary()),
                        pa.array([x.tobytes() for x in registers], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel())),
                    ],
                    ["id", "n_shingles", "digest", "registers", "keys"],
                )

    return rows.mapInArrow(lean(run), "id long, n_shingles long, digest binary, registers binary, keys array<long>")


def register_matrix(column: pa.Array) -> np.ndarray:
    data, offsets = utf8_column(column)
    return data[offsets[0] : offsets[-1]].view(np.uint16).reshape(-1, REGISTERS)


def likely(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose sketches let them reach the threshold."""
    side = lambda k: sketched.select(F.col("id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    least = percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                guess = estimated(register_matrix(batch.column("r_a")), register_matrix(batch.column("r_b")), np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b")))
                yield batch.select(["a", "b"]).filter(pa.array(guess >= least))

    return both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(lean(run), "a long, b long")


def squeezed(documents: DataFrame, wanted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id`` and compressed ``text`` of the wanted documents."""
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).join(wanted.hint("merge"), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            texts = [pack(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary())], ["id", "text"])

    return rows.mapInArrow(lean(run), "id long, text binary")


class SetCache:
    """Shingle sets of compressed texts; a few thousand are remembered."""

    def __init__(self, words: int, most: int = 2000):
        self.words, self.most, self.unpack = words, most, zstandard.ZstdDecompressor().decompress
        self.known: dict[bytes, np.ndarray] = {}

    def sets(self, packed: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > self.most:
            self.known.clear()
        new = [x for x in dict.fromkeys(packed) if x not in self.known]
        for at in range(0, len(new), 200):
            texts = [self.unpack(x) for x in new[at : at + 200]]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
            found, bounds = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offsets, self.words)
            self.known.update((x, found[a:b]) for x, a, b in zip(new[at : at + 200], bounds[:-1], bounds[1:], strict=True))
        return [self.known[x] for x in packed]


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose full sets have ``100 * common >= percent * union``."""
    first = texts.select(F.col("id").alias("a"), F.col("text").alias("t_a"))
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("t_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = SetCache(words)
        for batch in batches:
            for first_row in range(0, batch.num_rows, 500):
                part = batch.slice(first_row, 500)
                keep = []
                for x, y in zip(cache.sets(part.column("t_a").to_pylist()), cache.sets(part.column("t_b").to_pylist()), strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(len(x) > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(first, "a").join(second, "b").mapInArrow(lean(run), "a long, b long")


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole buckets from rows sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= HELD_ROWS or sum(x.nbytes for x in held) >= HELD_BYTES:
            table = pa.Table.from_batches(held)
            keys = np.asarray(table["key"].combine_chunks())
            whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if whole:
                yield table.slice(0, whole).combine_chunks()
                held = table.slice(whole).to_batches()
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


class Members:
    """The members of some buckets as arrays, and for each which later ones of its bucket may be similar."""

    def __init__(self, table: pa.Table, percent: int):
        self.keys, self.bands, self.sides, self.ids, self.labels, self.sizes = (np.asarray(table[k].combine_chunks()).copy() for k in ("key", "band", "side", "id", "label", "n_shingles"))
        self.registers = register_matrix(table["registers"].combine_chunks())
        self.percent, self.least = percent, percent / 100 - MARGIN
        self.edges = np.concatenate(([0], np.flatnonzero(self.keys[1:] != self.keys[:-1]) + 1, [len(self.keys)]))

    def buckets(self) -> Iterator[range]:
        return (range(a, b) for a, b in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True))

    def similar(self, k: int, end: int) -> np.ndarray:
        """Later members of other components that may reach the threshold; a pair counts in its first common full band only.

        Bands with an empty register have wider registers in their keys, so only of full ones do equal registers tell
        that the pair meets there.
        """
        later = slice(k + 1, end)
        other = np.arange(k + 1, end)[(self.labels[later] != self.labels[k]) & (self.sides[later] == PARTNER[self.sides[k]])]
        other = other[100 * np.minimum(self.sizes[other], self.sizes[k]) >= self.percent * np.maximum(self.sizes[other], self.sizes[k])]
        if not len(other):
            return other
        theirs, own = self.registers[other], self.registers[k]
        near = estimated(theirs, own[None, :], self.sizes[other], np.full(len(other), self.sizes[k])) >= self.least
        same = (theirs == own).reshape(len(other), BANDS, -1).all(axis=2) & (own.reshape(BANDS, -1) != 0).all(axis=1)
        near &= ~same.any(axis=1) | (same.argmax(axis=1) == self.bands[k])
        return other[near]


def promising(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From members sorted by bucket those that have a similar sketch of another component in their bucket."""
    for table in whole_buckets(batches):
        members = Members(table, percent)
        wanted = np.zeros(len(members.keys), bool)
        for bucket in members.buckets():
            for k in bucket:
                if len(other := members.similar(k, bucket.stop)):
                    wanted[k] = wanted[other] = True
        yield from table.select(["key", "band", "side", "id", "label"]).filter(pa.array(wanted)).to_batches()


def links_across(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """From members sorted by bucket, with their texts: links on full sets that join components of a bucket.

    Members that a link has joined are one component from then on, so a bucket gives fewer links than members.
    """
    cache = SetCache(words)
    for table in whole_buckets(batches):
        members = Members(table, percent)
        sets = cache.sets(table["text"].combine_chunks().to_pylist())
        found: list[tuple[int, int]] = []
        for bucket in members.buckets():
            numbers, place = np.unique(np.concatenate([sets[k] for k in bucket]), return_inverse=True)
            bounds = np.concatenate(([0], np.cumsum([len(sets[k]) for k in bucket])))
            mark = np.zeros(len(numbers), bool)
            for k in bucket:
                other = members.similar(k, bucket.stop)
                if not len(other):
                    continue
                own = place[bounds[k - bucket.start] : bounds[k - bucket.start + 1]]
                mark[own] = True
                begin, size = bounds[other - bucket.start], members.sizes[other]
                ends = np.cumsum(size)
                flat = place[np.repeat(begin - ends + size, size) + np.arange(ends[-1])]
                common = np.add.reduceat(mark[flat].astype(np.int64), ends - size)
                mark[own] = False
                linked = other[100 * common >= percent * (members.sizes[k] + size - common)]
                for partner in linked.tolist():
                    if members.labels[partner] != members.labels[k]:
                        found.append((int(members.ids[k]), int(members.ids[partner])))
                        part = slice(bucket.start, bucket.stop)
                        members.labels[part][members.labels[part] == members.labels[partner]] = members.labels[k]
        if found:
            links = np.array(found, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links.min(axis=1)), pa.array(links.max(axis=1))], ["a", "b"])


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id`` and ``label`` (its component) of all nodes."""
    found = components(links)
    return nodes.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("label"))


def grade(percent: int) -> Column:
    """The size of a set in steps of the threshold: sets that can reach it are at most one grade apart."""
    step = float(np.log(max(100 / max(percent, 1), 1.05)))
    return F.floor(F.log("n_shingles") / step + 1e-9).cast("int")


def dealt_buckets(members: DataFrame, labels: DataFrame, percent: int, block: int) -> DataFrame:
    """Members ``key, band, side, id, label`` of the buckets that hold several components, dealt to what a task compares.

    ``members`` has ``key, band, id, grade``. A bucket of over two blocks becomes several: one for every block and one
    for every pair of blocks that are at most a grade apart. In those of a pair, sides 1 and 2 are to be compared.
    """
    known = members.join(labels, "id")
    several = staged(known.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size")).where("x < y").select("key", "size"), "several")
    blended = staged(known.join(several, "key").select("key", "band", "id", "label", "grade", "size"), "mixed")
    small = blended.where(F.col("size") <= 2 * block).select("key", "band", F.lit(0).alias("side"), "id", "label")
    large = blended.where(F.col("size") > 2 * block)
    grades = large.groupBy("key", "grade").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    blocks = staged(grades.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("grade", "blocks"))).alias("blocks")), "blocks")
    place = lambda g, h: F.struct(g.alias("grade"), h.cast("int").alias("block"))
    own = large.join(blocks, "key").withColumn("own", place(F.col("grade"), F.pmod(F.xxhash64("id"), F.col("blocks")[F.col("grade")])))
    near = F.filter(F.map_entries("blocks"), lambda e: F.abs(e["key"] - F.col("grade")) <= 1)
    others = F.flatten(F.transform(near, lambda e: F.transform(F.sequence(F.lit(0), e["value"] - 1), lambda h: place(e["key"], h))))
    pairs = own.withColumn("other", F.explode(others))
    task = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return small.union(pairs.select(task.alias("key"), "band", side.alias("side"), "id", "label"))


def near_groups(documents: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Words are what lies between ASCII white space, with A-Z lower-cased; a text with fewer than ``words`` words has
    one shingle, a null or empty one or one without words has none and is linked with nothing. Documents are
    linked if 100 * common >= percent * union; ``component_id`` is the smallest id reachable. Rows that repeat
    an id are one document, linked by each of its texts. A null id is linked with nothing and is its own component.
    Ties have no part in it, texts may be as long as a row can be, other columns may have any name, and an empty
    table gives no rows.
    """
    if told_apart(documents.where(F.col(id_column).isNotNull()), id_column):
        return linked_rows(documents, words, percent, id_column, text_column, block)
    known, key = F.col(id_column).isNotNull(), free_name(documents, "__row")
    rows = numbered(documents.select(id_column, text_column), id_column, text_column, key).withColumn(key, F.when(known, F.col(key)))
    found = staged(linked_rows(rows, words, percent, key, text_column, block).select(F.col("doc_id").alias("node"), "n_shingles", F.col("component_id").alias("own")), "rows")
    ids = rows.where(known).select(F.col(key).alias("node"), F.col(id_column).alias("doc_id"))
    firsts = ids.groupBy("doc_id").agg(F.min("node").alias("a"))
    same = ids.join(firsts, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    joined = components(same.union(found.where("own <> node").select(F.col("own").alias("a"), F.col("node").alias("b"))))
    names = ids.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id"))
    whole = found.join(ids, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return whole.join(names, "component", "left").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def linked_rows(documents: DataFrame, words: int, percent: int, id_column: str, text_column: str, block: int = BLOCK) -> DataFrame:
    """``near_groups`` of rows whose ids are different integers or null."""
    kind = documents.schema[id_column].dataType
    with scratch():
        sketched = staged(summaries(documents, words, id_column, text_column), "sketches", outlive=True)
        filled = sketched.where("n_shingles > 0 and id is not null")
        classes = staged(filled.groupBy("digest").agg(F.min("id").alias("first")), "classes", outlive=True)
        firsts = classes.select(F.col("first").alias("id"))
        whole = staged(filled.join(firsts, "id", "left_semi").select("id", "n_shingles", "registers", "keys"), "sketches")

        keys = whole.select("id", grade(percent).alias("grade"), F.posexplode("keys").alias("band", "key")).where("key <> 0")
        centres = staged(keys.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "centre"), "centres")
        members = staged(keys.join(centres, "key").select("key", "band", "id", "grade", "centre"), "members")
        texts = staged(squeezed(documents, members.select("id").distinct(), id_column, text_column), "texts")
        pairs = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
        links = staged(verified(staged(likely(pairs, whole, percent), "pairs"), texts, words, percent), "verified")
        labels = staged(labelled(whole, links), "labels", outlive=True)

        dealt = dealt_buckets(members.drop("centre"), labels, percent, block)
        sketch = whole.select("id", "n_shingles", "registers")
        by_bucket = lambda x: x.repartition("key").sortWithinPartitions("key", "side", "id")
        close = by_bucket(dealt.join(sketch, "id")).mapInArrow(lean(lambda b: promising(b, percent)), "key long, band int, side int, id long, label long")
        close = staged(close, "promising")
        if not close.isEmpty():
            detailed = by_bucket(close.join(sketch, "id").join(texts, "id"))
            more = staged(detailed.mapInArrow(lean(lambda b: links_across(b, words, percent)), "a long, b long"), "verified")
            if not more.isEmpty():
                stars = labels.where("id <> label").select(F.col("label").alias("a"), F.col("id").alias("b"))
                labels = staged(labelled(whole, stars.union(more)), "labels", outlive=True)

    own = classes.join(labels.withColumnRenamed("id", "first"), "first").select("digest", "label")
    out = sketched.drop("registers", "keys").join(own, "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("label")).otherwise(F.col("id"))
    return out.select(F.col("id").cast(kind).alias("doc_id"), "n_shingles", F.coalesce(component, "id").cast(kind).alias("component_id")).select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(documents: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``documents`` with one row of each component, the one with the smallest id, nulls last.

    Where ids are null or repeat, every row is linked by its own text, rows of the same id and text among them. Null
    and empty texts all stay. Other columns may have any name; an empty table gives no rows.
    """
    rows, key = documents, id_column
    if not told_apart(documents, id_column):
        key = free_name(documents, "__row")
        rows = numbered(documents, id_column, text_column, key)
    own = free_name(rows, "__id")
    kept = linked_rows(rows, words, percent, key, text_column).where("kept").select(F.col("doc_id").alias(own))
    out = rows.join(kept, F.col(key) == F.col(own), "left_semi")
    return out if key == id_column else out.drop(key)

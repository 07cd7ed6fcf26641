"""Document fingerprints: a canonical exact digest.

A text is made canonical (Unicode compatibility normalisation, case folding, white space folded to single
spaces), and its fingerprint is the 128-bit XXH3 hash of that form. Documents are grouped by it, and inside a
group the canonical bytes are compared: were two different texts ever to share a hash, SHA-256 takes its
place. Two fingerprints are alike (1.0) if they are equal, else not (0.0).
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.blocks import lean, utf8_column
from peerscope.llm.rows import free_name, numbered, told_apart

#: Ranges of ids per shuffle partition when neighbours are brought together.
RANGES_PER_PARTITION = 4


def canonical(text: str) -> bytes:
    """The canonical form of a text in UTF-8."""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "replace")


DIGESTS: dict[str, Callable[[bytes], str]] = {
    "xxh3_128": lambda x: xxhash.xxh3_128_hexdigest(x),
    "sha256": lambda x: hashlib.sha256(x).hexdigest(),
}


def text_of(data: np.ndarray, a: int, b: int) -> str:
    return data[a:b].tobytes().decode("utf-8", "replace")


def digests(documents: DataFrame, digest: str, text_column: str = "text") -> DataFrame:
    """``digest`` and the compressed ``canonical`` form of each text."""
    name = digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, hashed = zstandard.ZstdCompressor(level=1).compress, DIGESTS[name]
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            for first in range(0, batch.num_rows, 512):
                forms = [canonical(text_of(data, a, b)) for a, b in zip(offsets[first : first + 512], offsets[first + 1 : first + 513], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([hashed(x) for x in forms]), pa.array([pack(x) for x in forms], pa.binary())], ["digest", "canonical"])

    return documents.select(F.col(text_column).cast("string").alias("text")).mapInArrow(lean(run), "digest string, canonical binary")


def trusted_digest(documents: DataFrame, text_column: str = "text") -> str:
    """The first digest under which no two different canonical texts of the table are equal."""
    for name in DIGESTS:
        shared = digests(documents, name, text_column).distinct().groupBy("digest").count().where("count > 1")
        if shared.isEmpty():
            return name
    raise ValueError("two different texts share a SHA-256 digest")


def fingerprint(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each row; null texts count as empty."""
    name = trusted_digest(documents, text_column)
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = DIGESTS[name]
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            prints = [hashed(canonical(text_of(data, a, b))) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def neighbours(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Compressed texts, dealt and sorted so that each row is followed by the next in descending order of ids.

    Ids must be integers, different and not null. Columns ``part, ghost, id, text``. The ids are dealt to ranges; the
    first row of a range also goes, as a ghost, behind the last one of the range before, and the very first behind the
    very last. Only range bounds and first ids, a few per partition, pass through the driver.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    ids = rows.select("id")
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = ids.approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    bounds = np.unique(np.array(points, np.float64).astype(np.int64)) if points else np.zeros(0, np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("id"))
            yield pa.RecordBatch.from_arrays([pa.array(-np.searchsorted(bounds, own, side="right")), pa.array(own)], ["part", "id"])

    heads = {r["part"]: r["first"] for r in ids.mapInArrow(lean(dealt), "part long, id long").groupBy("part").agg(F.max("id").alias("first")).collect()}
    order = sorted(heads)  # parts are numbered so that higher ids come first
    before = {heads[part]: order[k - 1] for k, part in enumerate(order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            own = np.asarray(batch.column("id"))
            data, offsets = utf8_column(batch.column("text"))
            part = -np.searchsorted(bounds, own, side="right")
            for first in range(0, batch.num_rows, 1024):
                last = min(batch.num_rows, first + 1024)
                texts = [pack(data[a:b].tobytes()) for a, b in zip(offsets[first:last], offsets[first + 1 : last + 1], strict=True)]
                ghosts = [k for k in range(last - first) if int(own[first + k]) in before]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*part[first:last].tolist(), *(before[int(own[first + k])] for k in ghosts)], pa.int64()),
                        pa.array([0] * (last - first) + [1] * len(ghosts), pa.int32()),
                        pa.array([*own[first:last].tolist(), *(int(own[first + k]) for k in ghosts)], pa.int64()),
                        pa.array(texts + [texts[k] for k in ghosts], pa.binary()),
                    ],
                    ["part", "ghost", "id", "text"],
                )

    spread = rows.mapInArrow(lean(run), "part long, ghost int, id long, text binary")
    return spread.repartition("part").sortWithinPartitions("part", "ghost", F.col("id").desc())


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many of the first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they and the next document's are.

    The next document is the one with the next smaller id, after the last the first; rows that repeat an id
    follow each other in descending order of their texts' digests, and a null id comes last. Null and empty texts
    are empty and stay empty when edited; other columns are left out. Columns ``doc_id, n_chars, edited, fingerprint,
    edited_fingerprint, near_edited, near_next``.
    """
    name, rows, key = trusted_digest(documents, text_column), documents, id_column
    if not told_apart(documents, id_column):
        key = free_name(documents, "__row")
        rows = numbered(documents.select(id_column, text_column), id_column, text_column, key, nulls_first=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, hashed = zstandard.ZstdDecompressor().decompress, DIGESTS[name]
        waiting: tuple | None = None
        names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                out = []
                for part, ghost, own, packed in zip(*(batch.column(k).slice(first, 256).to_pylist() for k in range(4)), strict=True):
                    text = unpack(packed).decode("utf-8", "replace")
                    form = canonical(text)
                    now = (part, own, text, form, hashed(form))
                    if waiting is not None and waiting[0] == part:
                        change = edited(waiting[2], text)
                        changed = canonical(change)
                        out.append((waiting[1], len(waiting[2]), change, waiting[4], hashed(changed), float(changed == waiting[3]), float(form == waiting[3])))
                    waiting = None if ghost else now
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = neighbours(rows, key, text_column).mapInArrow(lean(run), kinds)
    if key == id_column:
        return out.withColumn("doc_id", F.col("doc_id").cast(documents.schema[id_column].dataType))
    own = rows.select(F.col(key).alias("row"), F.col(id_column).alias("own"))
    return out.join(own, F.col("doc_id") == F.col("row")).withColumn("doc_id", F.col("own")).drop("row", "own")

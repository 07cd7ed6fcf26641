"""Language identification by error-correcting output codes.

Every language gets a codeword. For each bit of the code a binary logistic classifier over hashed character
n-grams learns which languages have that bit set. A text's bit scores are decoded by the loss to each
codeword, each bit weighted by how well its classifier does on that language; the nearest codeword wins (of
equally near ones the first in the order of names), and a small distance to the runner-up marks the answer as
ambiguous. Every language that occurs is learned; codewords grow with the logarithm of their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peerscope.llm.blocks import lean, row_ranges, utf8_column
from peerscope.staging import staged

BINS = 4096
UNDETERMINED = "und"
#: The bound of the training sample, which the driver holds at 16 KB a document while it fits the classifiers: documents of
#: each language, in the order of a hash of id and text, and in all. With more than 16 languages each has an equal share
#: of the latter, one document at least.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 500, 8_000
STEPS, RATE, DECAY = 150, 4.0, 1e-4
#: Scores below this mark a text as ambiguous.
AMBIGUOUS = 0.1
#: A model's margin is the score that all but this share of its sample's rightly decoded documents reach.
LOST = 0.001
PART_BYTES, ROWS = 1 << 19, 128
SIZES = (1, 2, 3)
#: Odd multipliers that mix the bytes of an n-gram.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
FOLD = np.full(256, 0x20, np.uint8)
FOLD[LETTER] = np.flatnonzero(LETTER) | 0x20
FOLD[0x80:] = np.arange(0x80, 256)


def parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about PART_BYTES and at most ROWS rows, each of which has BINS counts."""
    for first, last in row_ranges(offsets, PART_BYTES):
        for at in range(first, last, ROWS):
            yield at, min(last, at + ROWS)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: CRC-32 of its id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language: every split of the languages in two, as far as there are few, else a spread of random ones."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        splits = np.arange(1, 1 << (languages - 1))  # the last language never has the bit
        return np.where((splits[None, :] >> np.arange(languages)[:, None]) & 1, 1.0, -1.0)
    bits, random = 4 * int(np.ceil(np.log2(languages))) + 7, np.random.default_rng(1)
    tries = [np.where(random.random((languages, bits)) < 0.5, 1.0, -1.0) for _ in range(200 if languages <= 100 else 20)]
    apart = lambda code: ((bits - code @ code.T) / 2 + bits * np.eye(languages)).min()
    return max((c for c in tries if (np.abs(c.sum(axis=0)) < languages).all()), key=apart)


def profiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the n-gram shares of each row, of unit length; all zero without a letter or foreign byte."""
    rows = len(offsets) - 1
    block = FOLD[data[offsets[0] : offsets[-1]]]
    bounds = offsets - offsets[0]
    second = np.flatnonzero((block[1:] >= 0x80) & (block[1:] <= 0x9E) & (block[:-1] == 0xC3)) + 1
    block[second] += 0x20  # capital letters of Latin-1
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(bounds)) * BINS
    counts = np.zeros(rows * BINS, np.float64)
    solid = block != 0x20
    for size in SIZES:
        if len(block) < size:
            break
        count = len(block) - size + 1
        mix = np.full(count, size * 0x27D4EB2F, np.uint32)
        some = np.zeros(count, bool)
        for k in range(size):
            mix += block[k : k + count] * MULTIPLIERS[k]
            some |= solid[k : k + count]
        mix ^= mix >> np.uint32(15)
        mix *= np.uint32(0x2C1B3C6D)
        some &= row[:count] == row[size - 1 :]
        place = row[:count][some] + (mix >> np.uint32(20)).astype(np.int64)[some]
        counts += np.bincount(place, minlength=rows * BINS)
    out = np.sqrt(counts.reshape(rows, BINS)).astype(np.float32)
    out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)
    return out


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    margin: float = 1.0

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest codeword of each row of bit scores, and a score from 0 (a tie) to 1."""
        loss = np.logaddexp(0, -self.code[None, :, :] * margins[:, None, :])
        total = (loss * self.trust[None, :, :]).sum(axis=2)
        best = total.argmin(axis=1)
        ordered = np.sort(total, axis=1)
        score = 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1e-12) if len(self.languages) > 1 else np.ones(len(total))
        return best, np.clip(score, 0, 1)

    def predict(self, profile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.decode(profile @ self.weights + self.bias)


def fit(profile: np.ndarray, own: np.ndarray, languages: list[str]) -> Model:
    """Logistic regression for all bits at once by gradient descent with momentum."""
    code = codewords(len(languages))
    target = code[own].astype(np.float32)
    share = (1 / np.bincount(own, minlength=len(languages)))[own, None].astype(np.float32) / len(languages)
    weights, bias = np.zeros((BINS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    speed, speed_bias = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(STEPS):
        margin = target * (profile @ weights + bias)
        slope = -target * share / (1 + np.exp(np.clip(margin, -30, 30)))
        speed = 0.9 * speed - RATE * (profile.T @ slope + DECAY * weights)
        speed_bias = 0.9 * speed_bias - RATE * slope.sum(axis=0)
        weights, bias = weights + speed, bias + speed_bias
    right = target * (profile @ weights + bias) > 0
    trust = np.stack([right[own == k].mean(axis=0) for k in range(len(languages))])
    model = Model(languages, code, weights, bias, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9))
    model.margin = margin_of(model, profile, own)
    return model


def margin_of(model: Model, profile: np.ndarray, own: np.ndarray) -> float:
    """The score that all but LOST of the rightly decoded documents reach."""
    found = [model.predict(profile[at : at + ROWS]) for at in range(0, len(profile), ROWS)]
    best, score = (np.concatenate(x) for x in zip(*found, strict=True))
    right = score[best == own]
    return float(np.quantile(right, LOST, method="lower")) if len(right) else 0.0


def drawn(documents: DataFrame, per_language: int, most: int, id_column: str, text_column: str, lang_column: str) -> DataFrame:
    """``id, lang, text, draw`` of the sample: labelled rows with a text that are not held out, copies of a row once."""
    labelled = documents.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull() & ~held_out(F.col(id_column)))
    rows = labelled.select(F.col(id_column).cast("string").alias("id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    rows = rows.withColumn("draw", F.xxhash64("id", "text"))
    counts = staged(rows.groupBy("lang").count(), "languages")
    share = max(1, min(per_language, most // max(1, counts.count())))
    # the share of a language's rows that holds its sample with room to spare, so that few rows are ranked
    near = rows.join(counts, "lang").where(F.pmod("draw", F.lit(1 << 20)) * F.col("count") < (1 << 20) * (4 * share + 64))
    once = near.drop("count").dropDuplicates(["id", "lang", "draw"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    return once.withColumn("place", place).where(F.col("place") <= share).drop("place")


def train(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", most: int = SAMPLE_ROWS) -> Model | None:
    """A model from labelled documents that are not held out; None without any.

    Rows without a label or a text teach nothing; rows that repeat an id are rows of their own, by their own label, and
    rows alike in id, label and text count once. A null id is not held out. Texts are profiled whole, however long.
    """
    sample = drawn(documents, per_language, most, id_column, text_column, lang_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            for first, last in parts(offsets):
                found = [x.astype(np.float16).tobytes() for x in profiles(data, offsets[first : last + 1])]
                yield pa.RecordBatch.from_arrays([batch.column("draw").slice(first, last - first), batch.column("lang").slice(first, last - first), pa.array(found, pa.binary())], ["draw", "lang", "profile"])

    held = sample.select("draw", "lang", "text").mapInArrow(lean(run), "draw long, lang string, profile binary").toArrow().sort_by([("lang", "ascending"), ("draw", "ascending")])
    if not held.num_rows:
        return None
    names = held["lang"].to_pylist()
    languages = sorted(set(names))
    number = {x: k for k, x in enumerate(languages)}
    profile = np.stack([np.frombuffer(x.as_py(), np.float16) for x in held["profile"]]).astype(np.float32)
    return fit(profile, np.array([number[x] for x in names]), languages)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def identify(documents: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score, ambiguous``.

    A null, empty or letterless text is ``und`` with score 0, as is every text without a model. Repeated rows get
    the same answer each; texts count whole, however long; other columns are left out; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BINS weights for each bit, whatever the input
    rows = documents.select(F.col(id_column).alias("doc_id"), held_out(F.col(id_column)).alias("held_out"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            names, scores = [], []
            for first, last in parts(offsets):
                if own is None:
                    best, score = np.zeros(last - first, int), np.zeros(last - first)
                else:
                    best, score = own.predict(profiles(data, offsets[first : last + 1]))
                for k in range(first, last):
                    piece = data[offsets[k] : offsets[k + 1]]
                    known = own is not None and (bool(LETTER[piece].any()) or has_letter(piece.tobytes()))
                    names.append(own.languages[best[k - first]] if known else UNDETERMINED)
                    scores.append(float(score[k - first]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
    return found.withColumn("ambiguous", (F.col("score") < AMBIGUOUS) & (F.col("lang_pred") != UNDETERMINED))


def keep_identified(documents: DataFrame, least_score: float = 0.0, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``documents`` without those whose language can't be told.

    These are null, empty and letterless texts, with or without a model, and those whose score is below
    ``least_score``, or below the model's margin where that is less. Without a labelled row nothing else goes. Rows that
    repeat an id are judged each; other columns may have any name.
    """
    model = train(documents, id_column=id_column, text_column=text_column, lang_column=lang_column)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        least = min(least_score, own.margin) if own else 0.0
        for batch in batches:
            data, offsets = utf8_column(batch.column(text_column))
            keep = np.zeros(batch.num_rows, bool)
            for first, last in parts(offsets):
                score = own.predict(profiles(data, offsets[first : last + 1]))[1] if own else np.ones(last - first)
                for k in range(first, last):
                    piece = data[offsets[k] : offsets[k + 1]]
                    keep[k] = (bool(LETTER[piece].any()) or has_letter(piece.tobytes())) and score[k - first] >= least
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(lean(run), documents.schema)

"""BPE encoding and decoding by forced boundaries.

A merge only ever builds a token of the vocabulary. So where two adjacent bytes occur side by side in no
token, no merge crosses: the text can be cut there, the fragments encoded on their own and the ids put
together again. The table of such byte pairs comes from the vocabulary itself. Fragments repeat a lot, so
each distinct one is encoded once and its ids are looked up afterwards.

A cut inside a word of the pre-tokenizer leaves a left part that isn't the end of a word: it is *open* and
is encoded without the end-of-word mark. Words that the byte rules here don't cover (with characters beyond
Latin-1, control characters, special strings) go to the library one by one. So do whole texts where the
tokenizer is of another kind, cut only where a space between two letters or digits is proven to part them.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.blocks import BLOCK_BYTES, lean, row_of, row_ranges, utf8_column

#: Fixed values of the tokenizer's file format: the normalizer and the split that the byte rules reproduce.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Distinct fragments that each of the two generations of a worker's memory holds.
REMEMBERED = 200_000

SPACE, LETTER, DIGIT, OTHER, FOREIGN = range(5)
CUT, OPEN_CUT = 1, 2
MARK = "\u2581"  # a space in the pieces of a model
OPEN_MARK = b" "  # no fragment holds white space
ALNUM = np.zeros(256, bool)
ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True
LEAD = 0xC3  # the first byte of U+00C0 to U+00FF in UTF-8


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE uses for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def byte_classes() -> np.ndarray:
    out = np.full(256, FOREIGN, np.uint8)
    for b in range(0x21, 0x7F):
        out[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else OTHER
    out[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
    out[0x80:0xC0] = LETTER  # second bytes; whether they stand behind LEAD is tested apart
    out[LEAD] = LETTER
    return out


#: Lower-case fragments that are one word of the pre-tokenizer: letters, other signs without quotes, or a digit.
ONE_WORD = re.compile(rb"[a-z\x80-\xc3]+|[!-&(-/:-@\[-`{-~]+|[0-9]")
CLASS = byte_classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LOWER[CLASS == SPACE] = 0x20


def covered(path: str) -> bool:
    """Whether the byte rules here hold for a tokenizer: its normalizer, split, special strings and kind of model."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    parts = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [x["pattern"].get("Regex") for x in split if x["type"] == "Split"]
    exact = all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) and len(x["content"].encode()) > 1 for x in spec["added_tokens"])
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    return parts == NORMALIZERS and splits == [SPLIT] and [x["type"] for x in split] == ["Split", "ByteLevel"] and bool(model.get("end_of_word_suffix")) and exact and plain


@dataclass
class Fragments:
    """Fragments of a block in order: where each begins and ends, its row, and its value's number."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    code: np.ndarray
    values: list


class FragmentEncoder:
    """Encodes texts as the tokenizers library does; ``render`` turns the ids of a fragment into what is kept of it.

    For tokenizers that the byte rules cover (``covered``).
    """

    def __init__(self, path: str, render: Callable[[list[int]], object]):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.render = render
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        self.known: dict[bytes, object] = {}
        self.older: dict[bytes, object] = {}
        self.foreign_known: dict[bytes, object] = {}
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.closed_model = models.BPE(model["vocab"], merges, end_of_word_suffix=self.suffix)
        self.open_model = models.BPE(model["vocab"], merges)
        self.alphabet = dict(enumerate(byte_alphabet()))
        special = {x["content"] for x in spec["added_tokens"]}
        self.cut_kind = self.boundary_table([x for x in model["vocab"] if x not in special])
        self.special_pairs = {tuple(x.encode()[:2]) for x in special}

    def boundary_table(self, tokens: list[str]) -> np.ndarray:
        """By first byte * 256 + second byte: 0, or CUT, or OPEN_CUT for a cut inside a word."""
        byte = {c: b for b, c in enumerate(self.alphabet.values())}
        inside = np.zeros((256, 256), bool)
        for token in tokens:
            own = [byte[c] for c in token.removesuffix(self.suffix)]
            inside[own[:-1], own[1:]] = True
        same = (CLASS[:, None] == CLASS[None, :]) & np.isin(CLASS, (LETTER, OTHER))[:, None]
        cut = ~inside
        cut[:, 0x80:0xC0] = False  # never inside a character
        return np.where(cut, np.where(same, OPEN_CUT, CUT), 0).astype(np.uint8).ravel()

    # -- blocks ---------------------------------------------------------------------------------

    def foreign_spans(self, block: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the words, between white space or row bounds, with bytes that the rules here don't cover."""
        bad = CLASS[block] == FOREIGN
        second = (block & 0xC0) == 0x80
        after = np.zeros(len(block), bool)
        after[1:] = block[:-1] == LEAD
        bad |= second != after
        bad |= after & ((block == 0x97) | (block == 0xB7))  # the two signs among the letters
        for a, b in self.special_pairs:
            bad[:-1] |= (block[:-1] == a) & (block[1:] == b)
        bad &= CLASS[block] != SPACE
        places = np.flatnonzero(bad)
        if not len(places):
            return places, places
        edge = np.zeros(len(block) + 1, bool)
        edge[offsets] = True
        space = CLASS[block] == SPACE
        edge[:-1] |= space
        edge[1:] |= space
        edges = np.flatnonzero(edge)
        word = np.unique(np.searchsorted(edges, places, side="right") - 1)
        return edges[word], edges[word + 1]

    def scan(self, block: np.ndarray, offsets: np.ndarray) -> Fragments:
        """The fragments of all rows of a block; its rows must be covered by the byte rules."""
        low = LOWER[block]
        upper = np.flatnonzero((block[1:] >= 0x80) & (block[1:] <= 0x9E) & (block[:-1] == LEAD)) + 1
        low[upper] += 0x20
        pair = low[:-1].astype(np.uint16)
        pair <<= 8
        pair |= low[1:]
        kind = np.zeros(len(low) + 1, np.uint8)
        kind[1:-1] = self.cut_kind[pair]
        space = low == 0x20
        quotes = np.flatnonzero(low == 0x27)
        if len(quotes):  # a contraction ends up to three bytes behind its quote
            near = (quotes[:, None] + np.arange(4)).ravel()
            near = near[(near > 0) & (near < len(low))]
            keep = space[near] | space[near - 1] | ((low[near] == 0x27) & (CLASS[low[near - 1]] != OTHER))
            kind[near[~keep]] = 0
        kind[offsets] = CUT
        edges = np.flatnonzero(kind)
        start, end = edges[:-1], edges[1:]
        words = ~space[start]
        start, end = start[words], end[words]
        packed = low[~space]
        bounds = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=bounds[1:])
        arrow = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(packed)])
        coded = arrow.dictionary_encode()
        code = np.asarray(coded.indices).astype(np.int64) * 2 + (kind[end] == OPEN_CUT)
        used = np.zeros(2 * len(coded.dictionary), bool)
        used[code] = True
        number = np.cumsum(used) - 1
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
        return Fragments(start, end, row, number[code], self.look_up(byte_strings(coded.dictionary), np.flatnonzero(used)))

    def look_up(self, distinct: list[bytes], used: np.ndarray) -> list:
        if len(self.known) > REMEMBERED:  # what is still in use comes back from the older half
            self.known, self.older = {}, self.known
        known, older, out = self.known, self.older, []
        for key in used.tolist():
            fragment = distinct[key >> 1] if not key & 1 else distinct[key >> 1] + OPEN_MARK
            value = known.get(fragment)
            if value is None:
                value = older.get(fragment)
                if value is None:
                    value = self.render(self.encode_fragment(distinct[key >> 1], key & 1))
                known[fragment] = value
            out.append(value)
        return out

    def encode_fragment(self, fragment: bytes, is_open: int) -> list[int]:
        model = self.open_model if is_open else self.closed_model
        if ONE_WORD.fullmatch(fragment):
            return [t.id for t in model.tokenize(fragment.decode("latin-1").translate(self.alphabet))]
        words = [x for x, _ in self.whole.pre_tokenizer.pre_tokenize_str(fragment.decode())]
        ids = [t.id for w in words[:-1] for t in self.closed_model.tokenize(w)]
        return ids + [t.id for t in model.tokenize(words[-1])]

    # -- any rows -------------------------------------------------------------------------------

    def encode_text(self, text: bytes) -> list[int]:
        return self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids

    def foreign_words(self, block: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Fragments:
        """White space always ends a token, so the library gets such words one by one."""
        if len(self.foreign_known) > REMEMBERED:
            self.foreign_known = {}
        values = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            word = block[a:b].tobytes()
            value = self.foreign_known.get(word)
            if value is None:
                value = self.foreign_known[word] = self.render(self.encode_text(word))
            values.append(value)
        return Fragments(starts, ends, row_of(starts, bounds), np.arange(len(values)), values)

    def fragments(self, block: np.ndarray, bounds: np.ndarray) -> Fragments:
        """The fragments of all rows of a block, in order."""
        if not len(block):
            none = np.zeros(0, np.int64)
            return Fragments(none, none, none, none, [])
        starts, ends = self.foreign_spans(block, bounds)
        if not len(starts):
            return self.scan(block, bounds)
        others = self.foreign_words(block, bounds, starts, ends)
        mark = np.zeros(len(block) + 1, np.int8)
        mark[starts] += 1
        mark[ends] -= 1
        own = self.scan(np.where(np.cumsum(mark[:-1]) > 0, np.uint8(0x20), block), bounds)
        order = np.argsort(np.concatenate((own.start, others.start)), kind="stable")
        merged = [np.concatenate((getattr(own, k), getattr(others, k)))[order] for k in ("start", "end", "row")]
        return Fragments(*merged, np.concatenate((own.code, others.code + len(own.values)))[order], own.values + others.values)

    def counted(self, text: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the fragments of a span: offsets, token counts, which follow white space, and where encoding may begin anew."""
        found = self.fragments(text[begin:end], np.array([0, end - begin], np.int64))
        counts = np.array(found.values, np.int64)[found.code] if len(found.code) else np.zeros(0, np.int64)
        start = found.start + begin
        return start, counts, (start > begin) & (CLASS[text[np.maximum(start - 1, 0)]] == SPACE), np.ones(len(start), bool)

    def row_counts(self, block: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each row of a block."""
        found = self.fragments(block, bounds)
        counts = np.array(found.values, np.int64)[found.code] if len(found.code) else np.zeros(0, np.int64)
        return np.bincount(found.row, counts, len(bounds) - 1).astype(np.int64)

    def decoder(self) -> Callable[[pa.ListArray], pa.Array]:
        """Decodes lists of ids as the library does, special tokens included."""
        whole = self.whole
        if whole.decoder is not None:
            return lambda ids: pa.array([whole.decode(x, skip_special_tokens=False) for x in ids.to_pylist()], pa.string())
        tokens = pa.array([whole.id_to_token(i) for i in range(whole.get_vocab_size())], pa.string())
        return lambda ids: pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens.take(ids.values)), " ")

    #: Any text can be cut.
    divisible = True

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[list]:
        """For each row its rendered fragments in order. Rows over the block size are cut behind white space."""
        cuts, owner = [int(offsets[0])], []
        for row in range(len(offsets) - 1):
            at, stop = int(offsets[row]), int(offsets[row + 1])
            while stop - at > BLOCK_BYTES and (behind := behind_space(data, at + BLOCK_BYTES // 2, stop)) < stop:
                cuts.append(behind)
                owner.append(row)
                at = behind
            cuts.append(stop)
            owner.append(row)
        bounds, held = np.array(cuts, np.int64), []
        for first, last in row_ranges(bounds):
            found = self.fragments(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
            limits = np.searchsorted(found.row, np.arange(last - first + 1)).tolist()
            values, codes = found.values, found.code.tolist()
            for piece in range(last - first):
                held += [values[c] for c in codes[limits[piece] : limits[piece + 1]]]
                if first + piece + 1 == len(owner) or owner[first + piece + 1] != owner[first + piece]:
                    yield held
                    held = []


class LibraryEncoder:
    """Encodes texts by a tokenizer's own library: ``.json`` of any kind, and sentencepiece ``.model``.

    A text is encoded whole unless the tokenizer is ``divisible``. Then a space between two ASCII letters or digits
    parts tokens in any text: the split of byte-level BPE always begins a word there, and in a piece model no piece
    holds a space mark behind another character, so no merge crosses it.
    """

    def __init__(self, path: str, render: Callable[[list[int]], object]):
        self.render, self.pieces = render, path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
            self.divisible = not any(MARK in x.lstrip(MARK) for x in names) and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")
        else:
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as file:
                spec = json.load(file)
            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            split = spec.get("pre_tokenizer") or {}
            plain = spec.get("normalizer") is None and not any(x["lstrip"] or x["rstrip"] or " " in x["content"] for x in spec["added_tokens"])
            self.divisible = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]

    def part(self, text: np.ndarray, begin: int, end: int) -> tuple[bytes, int]:
        """The bytes to encode for a span, and how many were left out: the model's mark stands for a space cut off."""
        skip = int(self.pieces and 0 < begin < end and text[begin] == 0x20)
        return text[begin + skip : end].tobytes(), skip

    def encode_text(self, text: bytes) -> list[int]:
        if self.pieces:
            return self.model.encode(text.decode("utf-8", "replace"))
        return self.model.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids

    def counted(self, text: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens of a span: offsets, ones, which begin at a parting space, and the same again."""
        part, skip = self.part(text, begin, end)
        if self.pieces:
            start = np.array([x.begin for x in self.model.encode(part.decode("utf-8", "replace"), return_type="proto").pieces], np.int64)
        else:
            found = self.model.encode(part.decode("utf-8", "replace"), add_special_tokens=False).offsets
            characters = np.flatnonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80)
            start = characters[np.array([a for a, _ in found], np.int64)] if found else np.zeros(0, np.int64)
        start = start + begin + skip
        start[:1] = begin
        stable = (start > 0) & (start + 1 < len(text))
        at = start[stable]
        stable[stable] = (text[at] == 0x20) & ALNUM[text[at - 1]] & ALNUM[text[at + 1]] & (at > begin)
        return start, np.ones(len(start), np.int64), stable, stable

    def row_counts(self, block: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.array([len(self.encode_text(block[a:b].tobytes())) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[list]:
        """For each row the rendered ids of its parts in order: the whole text, or parts of about BLOCK_BYTES."""
        for row in range(len(offsets) - 1):
            text, at, held = data[offsets[row] : offsets[row + 1]], 0, []
            while at < len(text):
                stop = len(text)
                if self.divisible and stop - at > BLOCK_BYTES:
                    stop = parting_space(text, at + BLOCK_BYTES // 2)
                held.append(self.render(self.encode_text(self.part(text, at, stop)[0])))
                at = stop
            yield held

    def decoder(self) -> Callable[[pa.ListArray], pa.Array]:
        if self.pieces:
            return lambda ids: pa.array([self.model.decode(x) for x in ids.to_pylist()], pa.string())
        return lambda ids: pa.array([self.model.decode(x, skip_special_tokens=False) for x in ids.to_pylist()], pa.string())


def parting_space(text: np.ndarray, at: int) -> int:
    """The first place from ``at`` on of a space between two ASCII letters or digits; the end of the text if there is none."""
    at = max(at, 1)
    while at < len(text) - 1:
        end = min(len(text) - 1, at + 65536)
        found = np.flatnonzero((text[at:end] == 0x20) & ALNUM[text[at - 1 : end - 1]] & ALNUM[text[at + 1 : end + 1]])
        if len(found):
            return at + int(found[0])
        at = end
    return len(text)


def behind_space(data: np.ndarray, at: int, stop: int) -> int:
    """The first place from ``at`` on that follows white space; ``stop`` if there is none."""
    while at < stop:
        found = np.flatnonzero(CLASS[data[at : min(stop, at + 65536)]] == SPACE)
        if len(found):
            return at + int(found[0]) + 1
        at += 65536
    return stop


def byte_strings(array: pa.BinaryArray) -> list[bytes]:
    """The values of a binary array without nulls; several times faster than ``to_pylist``."""
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].tolist()
    held = data.to_pybytes() if data is not None else b""
    return [held[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[tuple, FragmentEncoder | LibraryEncoder] = {}


def worker_encoder(path: str, render: Callable[[list[int]], object]) -> FragmentEncoder | LibraryEncoder:
    """One encoder for each worker process, vocabulary and rendering."""
    key = (path, render.__module__, render.__qualname__)
    if key not in _encoders:
        _encoders[key] = FragmentEncoder(path, render) if covered(path) else LibraryEncoder(path, render)
    return _encoders[key]


def encode_documents(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every whole text, and the text that the ids decode to.

    Returns one row per input row: ``doc_id``, ``ids`` array<int> and ``decoded`` string. A null or empty text has no
    ids and decodes to the empty text; repeated rows and null ids of documents stay rows; a text may be as long as a
    row can be; other columns are left out; an empty table gives no rows. ``path`` names a tokenizers ``.json`` or a
    sentencepiece ``.model``.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, id_bytes)
        decode = encoder.decoder()
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            held, lengths, at = [], [], 0
            for row, values in enumerate(encoder.rows(data, offsets)):
                held.append(b"".join(values))
                lengths.append(len(held[-1]) // 4)
                if row + 1 == batch.num_rows or offsets[row + 1] - offsets[at] > BLOCK_BYTES // 2:
                    flat = pa.array(np.frombuffer(b"".join(held), "<i4"))
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), flat)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, row + 1 - at), ids, decode(ids)], ["doc_id", "ids", "decoded"])
                    held, lengths, at = [], [], row + 1

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, ids array<int>, decoded string")

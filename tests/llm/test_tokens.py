import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peerscope.llm import packing
from peerscope.llm.bpe import FragmentEncoder, LibraryEncoder, covered, encode_documents, worker_encoder
from peerscope.llm.queries import op2_token_counts, op8_packing, op9_bpe, tokenizer_path
from peerscope.llm.token_counts import Counter, count_tokens

PATH = tokenizer_path()
PIECES = ["a", "b", "the", "q", "z", "x", "'", " ", "  ", "\n", "\t", "1", "29", "!", "!!", "'s", "'ll", "'lly", "'ve", "é", "É", "ß", "À", "th", "ing", "-", "...", "@", "zq", "qg", "=", "$"]
ODD = ["×", "÷", "日本", "İ", "Σς", "e\u0301", "<|endoftext|>", "<|", "\u00a0", "\x0b", "\x1f", "😀", "\u0130", "\x85"]
texts = st.lists(st.sampled_from(PIECES + ODD), max_size=40).map("".join)
LATIN = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)


@pytest.fixture(scope="module")
def encoder():
    return FragmentEncoder(PATH, tuple)


@pytest.fixture(scope="module")
def counter():
    return FragmentEncoder(PATH, len)


def flat(rows):
    data = [x.encode() for x in rows]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)


def library(encoder, text):
    return encoder.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(texts, LATIN), max_size=8))
def test_fragments_give_the_librarys_ids(encoder, rows):
    got = [[i for part in row for i in part] for row in encoder.rows(*flat(rows))]
    assert got == [library(encoder, x) for x in rows]


def test_long_rows_are_cut_behind_white_space(encoder, monkeypatch):
    import peerscope.llm.bpe as bpe

    monkeypatch.setattr(bpe, "BLOCK_BYTES", 40)
    draw = random.Random(1)
    rows = ["".join(draw.choice(PIECES + ODD) for _ in range(n)) for n in (0, 300, 5, 900)] + ["x" * 200]
    assert [[i for part in row for i in part] for row in encoder.rows(*flat(rows))] == [library(encoder, x) for x in rows]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (200, 20), (1000, 64)])
def test_spliced_counts(counter, chunk, overlap):
    draw = random.Random(chunk)
    rows = ["".join(draw.choice(kind) for _ in range(draw.randint(0, 1500))) for kind in (PIECES, PIECES + ODD) for _ in range(20)]
    rows += ["a" * 3000 + " b" + "c" * 4000, "", "x" * 2000, " " * 500, "é" * 700]
    found = list(Counter(counter, chunk, overlap).count(*flat(rows)))
    assert [x[0] for x in found] == [len(library(counter, x)) for x in rows]
    assert max(x[1] for x in found) > 1 and sum(x[2] for x in found) > 0


ROWS = [(1, "Hello, World! it's", "en"), (2, None, "x"), (3, "", None), (3, "", None), (None, "déjà vu <|endoftext|> 123", "fr"), (9, "z" * 9000 + " word " * 3000, "q")]
SCHEMA = "doc_id bigint, text string, n_tokens string"


def test_counts_of_odd_rows(spark, counter):
    got = count_tokens(spark.createDataFrame(ROWS, SCHEMA), PATH).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted((repr(i), len((t or "").encode()), len(library(counter, t or ""))) for i, t, _ in ROWS)
    assert count_tokens(spark.createDataFrame([], SCHEMA), PATH).count() == 0


OTHERS = ["byte_bpe_50k.json", "piece_bpe_32k.model"]
SPACED = PIECES + ODD + ["a b", "word 1 two", " x y", "\u2581", "\r\n", "   "]


@pytest.mark.parametrize("name", OTHERS)
def test_other_tokenizers_give_the_librarys_result(spark, name):
    path, draw = tokenizer_path(name), random.Random(7)
    rows = [*ROWS, *((100 + k, "".join(draw.choice(SPACED) for _ in range(draw.randint(0, 80))), None) for k in range(60))]
    whole = LibraryEncoder(path, tuple)
    ids = [whole.encode_text((t or "").encode()) for _, t, _ in rows]
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        assert ids == [model.encode(t or "") for _, t, _ in rows]
        decoded = [model.decode(x) for x in ids]
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        assert ids == [model.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
        decoded = [model.decode(x, skip_special_tokens=False) for x in ids]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = count_tokens(frame, path, chunk=100, overlap=20).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted((repr(i), len((t or "").encode()), len(x)) for (i, t, _), x in zip(rows, ids))
    assert any(r.n_chunks > 1 for r in got)
    got = encode_documents(frame, path).collect()
    assert sorted((repr(r.doc_id), list(r.ids), r.decoded) for r in got) == sorted((repr(i), x, d) for (i, _, _), x, d in zip(rows, ids, decoded))
    assert not covered(path) and covered(PATH) and whole.divisible


@pytest.mark.parametrize("name", OTHERS)
@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (300, 40)])
def test_spliced_counts_of_other_tokenizers(monkeypatch, name, chunk, overlap):
    import peerscope.llm.bpe as bpe

    encoder, draw = worker_encoder(tokenizer_path(name), len), random.Random(chunk)
    rows = ["".join(draw.choice(kind) for _ in range(draw.randint(0, 900))) for kind in (SPACED, ["ab ", "c d", " e", "  "]) for _ in range(25)]
    rows += ["x" * 1500 + " y " + "z" * 900, "", " " * 400, "日本語" * 300, "a b " * 200]
    want = [len(encoder.encode_text(x.encode())) for x in rows]
    assert [x[0] for x in Counter(encoder, chunk, overlap).count(*flat(rows))] == want
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 50)
    assert [sum(x) for x in encoder.rows(*flat(rows))] == want


def test_a_tokenizer_without_proven_places_encodes_whole(tmp_path):
    import json

    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = json.load(file)
    spec["normalizer"] = {"type": "Strip", "strip_left": True, "strip_right": True}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    encoder = LibraryEncoder(str(path), len)
    rows = [" a b c " * 50, "", "  x "]
    assert not encoder.divisible
    assert [x[:2] for x in Counter(encoder, 20, 5).count(*flat(rows))] == [(len(encoder.encode_text(x.encode())), 1) for x in rows]


def test_round_trip_of_odd_rows(spark, encoder):
    got = encode_documents(spark.createDataFrame(ROWS, SCHEMA), PATH).collect()
    want = [(repr(i), library(encoder, t or ""), encoder.whole.decode(library(encoder, t or ""), skip_special_tokens=False)) for i, t, _ in ROWS]
    assert sorted((repr(r.doc_id), list(r.ids), r.decoded) for r in got) == sorted(want)
    assert encode_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_queries_equal_the_library(spark, encoder):
    from conftest import DATA

    texts_ = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = {k: library(encoder, v) for k, v in texts_.items()}
    for r in op2_token_counts(spark, DATA).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts_[r.doc_id].encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 2048)
    for r in op9_bpe(spark, DATA).collect():
        decoded = encoder.whole.decode(ids[r.doc_id], skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest() and r.n_tokens == len(ids[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    check_packing(op8_packing(spark, DATA).collect(), ids, 4096)


def check_packing(rows, ids, window, most_padding=0.2):
    held, sequences = {}, {}
    for r in rows:
        own = [*ids[r.doc_id], 2]
        piece = own[r.start : r.start + r.length]
        assert r.length == len(piece) > 0 and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        held.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert held.keys() == ids.keys()
    for k, spans in held.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids[k]) + 1
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    total = sum(len(x) + 1 for x in ids.values())
    assert len(sequences) * window <= total * (1 + most_padding) + window


def test_packing_of_odd_rows(spark, encoder):
    rows = [(k, t, None) for k, t in enumerate([None, "", "a", "a b c " * 50, "word " * 64, "x " * 127, "q"])]
    ids = {k: library(encoder, t or "") for k, t, _ in rows}
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), PATH, window=64).collect()
    check_packing(got, ids, 64, 1.0)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_packing_in_several_bins(spark, encoder):
    rows = [(k, "w " * (k % 60), None) for k in range(300)]
    ids = {k: library(encoder, t) for k, t, _ in rows}
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), PATH, window=64, bin_pieces=50).collect()
    check_packing(got, ids, 64, 0.4)


def test_like_rows_are_dealt_to_all_bins(spark):
    frame = spark.createDataFrame([(None, None, None)] * 400, SCHEMA).repartition(3)
    got = packing.pack_documents(frame, PATH, window=64, bin_pieces=50).collect()
    bins = {}
    for r in got:
        bins[r.sequence_id >> 32] = bins.get(r.sequence_id >> 32, 0) + 1
    assert len(got) == 400 and len(bins) == 8 and max(bins.values()) < 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_decreasing(lengths):
    """The tree picks what a search over all open windows picks."""
    sequence, offset = packing.best_fit_decreasing(lengths, 16)
    rooms: list[int] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [r for r in rooms if r >= lengths[k]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[k])
        else:
            rooms.append(16 - lengths[k])
    used = {}
    for s, o, n in sorted(zip(sequence, offset, lengths)):
        assert o == used.get(s, 0)
        used[s] = o + n
    assert sorted(16 - x for x in used.values()) == sorted(rooms)

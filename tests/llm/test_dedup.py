import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peerscope.llm import components, exact_dedup, near_dedup, suffix_dedup
from peerscope.llm.queries import ORACLE_SQL, op1_suffix_dedup, op3_near_dedup, op6_exact_dedup
from peerscope.llm.suffix_sort import sorted_by_bytes, sorted_in_groups

SCHEMA = "doc_id bigint, text string, id string"  # a further column with a clashing name
UPPER = {i: i + 32 for i in range(65, 91)}


# -- suffix array ------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.text("ab", max_size=8)), min_size=1, max_size=40))
def test_hash_compared_mergesort(rows):
    rows.sort(key=lambda x: x[0])
    matrix = np.zeros((len(rows), 8), np.uint8)
    for k, (_, text) in enumerate(rows):
        matrix[k, : len(text)] = np.frombuffer(text.encode(), np.uint8)
    lengths, group = np.array([len(t) for _, t in rows]), np.array([g for g, _ in rows])
    order, shared = sorted_in_groups(matrix, lengths, group)
    assert order.tolist() == sorted(range(len(rows)), key=lambda k: rows[k])
    heads = np.concatenate(([True], group[1:] != group[:-1]))
    first = np.maximum.accumulate(np.where(heads, np.arange(len(rows)), 0))
    want = sorted_by_bytes(matrix, lengths, first, heads)
    assert order.tolist() == want[0].tolist() and shared.tolist() == want[1].tolist()


def test_lying_hashes_are_noticed(monkeypatch):
    import peerscope.llm.suffix_sort as suffix_sort

    monkeypatch.setattr(suffix_sort, "prefix_table", lambda rows: np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64))
    matrix = np.array([[2, 1], [1, 2], [1, 1]], np.uint8)
    order, shared = sorted_in_groups(matrix, np.array([2, 2, 2]), np.zeros(3, int))
    assert order.tolist() == [2, 1, 0] and shared.tolist() == [-1, 1, 0]


def brute_repeats(rows, span):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        data = (text or "").encode()
        removed = np.zeros(len(data), bool)
        for k in range(len(data) - span + 1):
            window = data[k : k + span]
            if window in seen:
                removed[k : k + span] = True
            seen.add(window)
        runs = int((np.diff(np.concatenate(([0], removed.astype(int)))) == 1).sum())
        out[key] = (len(data), int(removed.sum()), runs, bytes(np.frombuffer(data, np.uint8)[~removed]) if data else b"")
    return out


def repeated_rows(seed):
    draw = random.Random(seed)
    text = lambda n, alphabet="abcdefgh é": "".join(draw.choice(alphabet) for _ in range(n))
    base, rows = [text(draw.randint(50, 500)) for _ in range(6)], []
    for k in range(50):
        made = ""
        for _ in range(draw.randint(0, 4)):
            piece = draw.choice(base)
            at = draw.randint(0, len(piece))
            made += piece[at : at + draw.randint(0, 300)] if draw.random() < 0.6 else text(draw.randint(0, 150), draw.choice(["abcdefgh é", "a", "ab"]))
        rows.append((k * 7 % 1009, made or None))
    return rows + [(2000, "x" * 700), (2001, "y" + "x" * 350), (2002, base[0]), (2003, base[0]), (2004, "ab" * 200), (2005, base[1][:99]), (2006, ""), (None, base[2])]


@pytest.mark.parametrize(("seed", "most"), [(0, 20_000), (1, 3), (2, 1)])
def test_removed_repeats_equal_brute_force(spark, seed, most):
    rows = repeated_rows(seed)
    frame = spark.createDataFrame([(k, t, "x") for k, t in rows], SCHEMA).repartition(5)
    got = suffix_dedup.remove_repeats(frame, most_contexts=most).collect()
    want = brute_repeats(rows, 100)
    assert len(got) == len(want)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


@pytest.mark.parametrize("part", [400, 1 << 30])
def test_every_span_has_its_anchor(monkeypatch, part):
    """The least gram of every span is an anchor, however the documents are cut into parts."""
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part)
    data = [(t or "").encode() for _, t in repeated_rows(5)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8)
    found = [suffix_dedup.anchors(flat, offsets, g, 100, 32) for g in suffix_dedup.parts(offsets, 100)]
    have = {(int(r), int(p)): (int(k), int(c)) for rows, places, keys, contexts in found for r, p, k, c in zip(rows, places, keys, contexts)}
    by_context = {}
    for row, text in enumerate(data):
        grams = suffix_dedup.mixed(suffix_dedup.PrefixHash(np.frombuffer(text, np.uint8)).grams(32))
        order = grams >> np.uint64(32)
        for start in range(len(text) - 99):
            window = order[start : start + 69]
            for place in np.flatnonzero(window == window.min()) + start:
                key, context = have[row, int(place)]
                assert key == int(grams[place].view(np.int64))
                seen = by_context.setdefault((key, context), text[max(0, place - 68) : place + 100])
                assert seen == text[max(0, place - 68) : place + 100]


def test_rows_of_repeated_and_null_ids_stay_documents(spark):
    draw = random.Random(4)
    text = lambda: "".join(draw.choices("abcdefgh", k=300))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a, "1"), (5, a + b, "2"), (5, c + d, "3"), (None, c + c, "4"), (None, d, "5"), (None, None, "6"), (7, b, "7"), (7, b, "8"), (8, "", "9")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # in the order of ids, null ones first, then of digests; of equal rows either loses all
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256((x[1] or "").encode()).hexdigest() if x[1] is not None else ""))
    want = brute_repeats([(k, t) for k, (_, t, _) in enumerate(order)], 100)
    got = suffix_dedup.remove_repeats(frame).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted((repr(order[k][0]), *x) for k, x in want.items())
    kept = {r.id: r.text for r in suffix_dedup.remove_repeats(frame, keep_columns=True).collect()}
    assert kept["1"] == a and kept["2"] == b and "3" not in kept and kept["4"] == c and kept["5"] == d and kept["6"] is None
    assert not {"7", "8"} & kept.keys() and kept["9"] == ""
    assert suffix_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_clashing_names_do_no_harm(spark):
    names = ["doc_id", "text", "__id", "__spans", "__row", "spans", "id", "__tie", "copies"]
    text = "".join(random.Random(4).choices("abcdefgh", k=300))
    for last in (2, None):
        frame = spark.createDataFrame([(1, text, 1, 2, 3, "s", "i", 4, 5), (last, text, 6, 7, 8, "t", "j", 9, 10)], "doc_id bigint, text string, __id int, __spans int, __row int, spans string, id string, __tie int, copies int")
        for stage in (lambda f: suffix_dedup.remove_repeats(f, keep_columns=True), exact_dedup.drop_copies, near_dedup.drop_near_copies):
            out = stage(frame)
            assert out.columns == names and len(out.collect()) == 1


def test_a_gram_of_very_many_contexts_is_refined(spark):
    """One passage in very many different surroundings, some of which share more than it."""
    draw = random.Random(11)
    text = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    passage, ends = text(104), [text(60) for _ in range(7)]
    rows = [(k, text(80) + passage + (draw.choice(ends) if k % 2 else text(60))) for k in range(400)]
    rows += [(1000 + k, text(70) + passage[:99] + text(50)) for k in range(100)]
    want = brute_repeats(rows, 100)
    frame = spark.createDataFrame([(k, t, "x") for k, t in rows], SCHEMA).repartition(4)
    for r in suffix_dedup.remove_repeats(frame, most_contexts=20).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_texts_are_cut_at_characters(spark):
    shared = "é" * 30 + "".join(random.Random(8).choices("abcdefgh", k=100))
    frame = spark.createDataFrame([(1, shared, None), (2, "\u00c9\u00e8" + shared + "!", None), (3, None, None)], SCHEMA)
    kept = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(frame, keep_columns=True).collect()}
    assert kept == {1: shared, 2: "\u00c9\u00e8!", 3: None}


def test_suffix_query(spark):
    from conftest import DATA

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = brute_repeats(rows, 100)
    for r in op1_suffix_dedup(spark, DATA).collect():
        size, removed, runs, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, removed, runs, hashlib.sha256(kept).hexdigest())


# -- near copies -------------------------------------------------------------------------------------


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))) if found else frozenset()


def brute_near(rows, words, percent):
    sets = {k: shingles(t, words) for k, t in rows}
    keys = sorted(k for k in sets if k is not None)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k) if k is not None else None) for k in sets}


def near_rows(seed, count=260):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [[draw.choice(words) for _ in range(draw.choice([1, 2, 3, 4, 5, 8, 9, 20, 60, 200]))] for _ in range(20)]
    rows = []
    for k in range(count):
        own = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            own[draw.randrange(len(own))] = draw.choice(words)
        rows.append((k * 37 % 100003, " ".join(own) if draw.random() < 0.9 else "\t ".join(own).upper()))
    return rows + [(200001, None), (200002, ""), (200003, " \n"), (200004, "a"), (200005, "A "), (None, "a")]


@pytest.mark.parametrize(("words", "block"), [(4, 2000), (5, 4)])
def test_near_groups_equal_brute_force(spark, words, block):
    rows = near_rows(words)
    frame = spark.createDataFrame([(k, t, "x") for k, t in rows], SCHEMA).repartition(4)
    got = near_dedup.near_groups(frame, words=words, percent=80, block=block).collect()
    want = brute_near(rows, words, 80)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_groups_of_repeated_ids_and_no_rows(spark):
    frame = spark.createDataFrame([(5, "a b c d e f", "x"), (5, "a b c d e f", "x"), (7, "a b c d e f", "x")], SCHEMA)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(frame).collect()) == [(5, 5, True), (5, 5, True), (7, 5, False)]
    assert near_dedup.near_groups(frame.limit(0)).count() == 0
    assert [r.doc_id for r in near_dedup.drop_near_copies(frame).collect()] == [5]


def test_large_buckets_of_unlinked_look_alikes(spark, monkeypatch):
    """Blocks hold two at a time, rows don't multiply, and the few links among the look-alikes are found."""
    draw = random.Random(21)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(90):  # a third of their words differ, so that they share bands, but no link
        own = list(base)
        for at in range(k % 3, 300, 24):
            own[at] = f"x{k}y{at}"
        rows.append((k, " ".join(own)))
        if k % 10 == 5:  # a link with the one before, and one of a set that is much smaller
            own[draw.randrange(300)] = "z"
            rows += [(1000 + k, " ".join(own)), (2000 + k, " ".join(own[:120]))]
    want, seen, deal = brute_near(rows, 4, 80), [], near_dedup.dealt_buckets

    def dealt(members, labels, percent, block):
        out = deal(members, labels, percent, block)
        seen.append((members.count(), out.count(), out.groupBy("key").count().agg(F.max("count")).first()[0]))
        return out

    monkeypatch.setattr(near_dedup, "dealt_buckets", dealt)
    got = near_dedup.near_groups(spark.createDataFrame([(k, t, "x") for k, t in rows], SCHEMA), words=4, block=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len({c for _, c in want.values()}) > 80
    members, out, largest = seen[0]
    assert largest <= 40 and out <= members * (len(rows) // 8 + 3)


def test_recall_of_the_bands(spark):
    """Pairs at the threshold that share no band, of sets of all sizes."""
    draw = np.random.default_rng(5)
    missed = 0
    for size in (5, 10, 25, 100, 1000):
        both = size * 4 // 5  # the smaller set is part of the larger one: 80 %
        pools = [np.unique(draw.integers(0, 1 << 63, 2 * size, dtype=np.uint64) * np.uint64(2))[:size] for _ in range(400)]
        parts = [x for pool in pools for x in (pool, np.sort(draw.permutation(pool)[:both]))]
        keys = near_dedup.band_keys(near_dedup.minima(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))))
        missed += int((~((keys[::2] == keys[1::2]) & (keys[::2] != 0)).any(axis=1)).sum())
    assert missed == 0


def test_small_unrelated_sets_share_no_key(spark):
    draw = np.random.default_rng(6)
    sets = [np.sort(draw.integers(0, 1 << 64, draw.integers(1, 12), dtype=np.uint64)) for _ in range(20_000)]
    keys = near_dedup.band_keys(near_dedup.minima(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets])))))
    filled = keys[keys != 0]
    assert len(np.unique(filled)) == len(filled)


def test_estimates_are_close(spark):
    draw = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        size, both = 4000, int(4000 * share)
        pool = np.sort(draw.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        sets = [np.sort(pool[: (size + both) // 2]), np.sort(pool[(size - both) // 2 :])]
        registers = near_dedup.sketches(near_dedup.minima(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])))
        real = len(np.intersect1d(*sets)) / size
        guess = near_dedup.estimated(registers[:1], registers[1:], np.array([len(sets[0])]), np.array([len(sets[1])]))[0]
        assert abs(guess - real) < 0.15
    apart = near_dedup.sketches(near_dedup.minima(np.concatenate([np.sort(draw.integers(0, 1 << 63, 1000, dtype=np.uint64)) for _ in range(2)]), np.array([0, 1000, 2000])))
    assert near_dedup.estimated(apart[:1], apart[1:], np.array([1000]), np.array([1000]))[0] < 0.1


def test_rows_of_null_and_repeated_ids_are_told_apart(spark):
    text = lambda k: " ".join(f"{k}w{n}" for n in range(30))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " more"), (1, text("c")), (1, text("d")), (1, text("d")), (2, text("d") + " more"), (3, text("c") + " more"), (None, text("c") + " end"), (4, None), (None, "")]
    frame = spark.createDataFrame([(k, t, "x") for k, t in rows], SCHEMA).repartition(3)
    kept = [(r.doc_id, r.text) for r in near_dedup.drop_near_copies(frame).collect()]
    copies = [t for k, t in kept if t and t.startswith("bw")]
    assert len(copies) == 1 and copies[0] in (text("b"), text("b") + " more")
    rest = [(k, t) for k, t in kept if not (t and t.startswith("bw"))]
    assert sorted(rest, key=repr) == sorted([(None, text("a")), (1, text("c")), (1, text("d")), (4, None), (None, "")], key=repr)
    got = near_dedup.near_groups(frame).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True)]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)


def test_near_query(spark):
    from conftest import DATA

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = brute_near(rows, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op3_near_dedup(spark, DATA).collect()} == want


@pytest.mark.parametrize("links", [[], [(1, 2), (3, 2), (3, 4), (9, 8), (8, 8)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)]])
def test_components(spark, monkeypatch, links):
    monkeypatch.setattr(components, "FOREST_LINKS", 3)
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(4)
    got = {r.node: r.component for r in components.components(frame).collect()}
    parent = {x: x for pair in links for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(parent[a], parent[b])
            changed |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
    assert got == {k: v for k, v in parent.items() if k in got} and {x for a, b in links if a != b for x in (a, b)} == set(got)


# -- exact copies ------------------------------------------------------------------------------------


def test_chunks_are_the_text(spark):
    draw = random.Random(2)
    rows = [("".join(draw.choice(["a", "b. ", "\n", "c", "é", "😀"]) for _ in range(n)),) for n in (0, 1, 500, 5000, 30000)] + [("x" * 20000,)]
    found = spark.createDataFrame(rows, "text string").select("text", exact_dedup.chunks(exact_dedup.F.col("text")).alias("c")).collect()
    for r in found:
        assert "".join(r.c) == r.text and all(0 < len(x) <= 2 * exact_dedup.MOST_CHARS for x in r.c)


def test_shifted_copies_share_their_chunks(spark):
    draw = random.Random(3)
    text = " ".join("".join(draw.choice("abcdefghl") for _ in range(draw.randint(1, 7))) for _ in range(5000))
    rows = [(text,), ("some words put in front " + text,)]
    a, b = (r.c for r in spark.createDataFrame(rows, "text string").select(exact_dedup.chunks(F.col("text")).alias("c")).collect())
    assert len(a) > 20 and a[1:] == b[-len(a) + 1 :]


def test_exact_groups_of_odd_rows(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a ", "x"), (4, None, "x"), (5, "", "x"), (None, "b", "x"), (7, "b", "x"), (8, "c", "x"), (8, "c", "x")]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    keep = {"a": 2, "a ": 3, "": 5, "b": 7, "c": 8}
    size = {"a": 2, "a ": 1, "": 2, "b": 2, "c": 2}
    want = [(i, keep[t or ""], size[t or ""], i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 5, 7, 8]
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_colliding_identifiers_fall_back(spark, monkeypatch):
    monkeypatch.setitem(exact_dedup.IDENTIFIERS, "xxhash64_pair", lambda c: exact_dedup.F.length(c).cast("bigint"))
    rows = [(1, "ab", None), (2, "cd", None), (3, "ab", None)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(1, 3), (2, 2), (3, 3)]


def test_exact_query_has_no_python(spark, duck):
    from conftest import DATA, as_rows

    got = op6_exact_dedup(spark, DATA)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    assert as_rows(got.toPandas()) == as_rows(duck.execute(ORACLE_SQL["op6_exact_dedup"]).df())

import hashlib
import math
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from conftest import DATA, as_rows
from pyspark.sql import functions as F

from peerscope.llm import chat, fingerprints, langid, url_filter
from peerscope.llm.queries import ORACLE_SQL, QUERIES, URL_RULES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert as_rows(QUERIES[name](spark, DATA).toPandas()) == as_rows(duck.execute(ORACLE_SQL[name]).df())


# -- URLs --------------------------------------------------------------------------------------------


def brute_rule(host, path, rules):
    fits = [r for r in rules if (not r[0] or host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: (len(r[0].split(".")) if r[0] else 0, len(r[1]), r[2] == "block")) if fits else None


def test_trie_equals_brute_force():
    draw = random.Random(6)
    host = lambda: ".".join(draw.choice(["a", "b", "com", "x"]) for _ in range(draw.randint(1, 4)))
    path = lambda: "".join(draw.choice(["/", "/a", "b", "/ab", "c"]) for _ in range(draw.randint(0, 5)))
    rules = [(host() if draw.random() < 0.9 else "", p if (p := path()).startswith("/") else "", draw.choice(["allow", "block"])) for _ in range(60)]
    trie = url_filter.UrlTrie(rules)
    for _ in range(2000):
        h, p = host(), path()
        p = p if p.startswith("/") else ""
        want = brute_rule(h, p, rules)
        got = trie.find(h, p)
        assert (got and got[2]) == (want and want[2]) and (got and got[0] + got[1]) == (want and want[0] + want[1])


def test_urls_of_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/712?x#y", "http://sub.Example.COM/en/", "https://example.com", "x://com/en/?a://b", "http://notcom/en/1", "http://a.net/de/", "http://a.example.net/de/8x", "http://b.org/es", "http://b.org/es/", "http://É.org/es/#", "http://example.com#/en/"]
    frame = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(None, None, None)], "page_id bigint, url string, host string")
    want = {}
    for k, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        rule = brute_rule(host, path, URL_RULES)
        want[k] = (host, path, rule and rule[0] + rule[1], rule[2] if rule else "allow")
    for more in (100_000, 2):
        got = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(frame, URL_RULES, rules_per_trie=more).collect()}
        assert got.pop(None) == ("", "", None, "allow") and got == want
    assert url_filter.judge_urls(frame.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(frame, [], "block").collect()} == {"block"}


def test_rules_are_cleaned(spark):
    frame = spark.createDataFrame([(1, "http://a.example.com/en/x"), (2, "http://example.com/"), (3, None)], "page_id bigint, url string")
    rules = [("EXAMPLE.com", "en/", "block"), (None, None, "allow")]
    for more in (100_000, 1):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(frame, rules, "block", rules_per_trie=more).collect()}
        assert got == {1: ("example.com/en/", "block"), 2: ("", "allow"), 3: ("", "allow")}
    with pytest.raises(ValueError, match="verdict"):
        url_filter.judge_urls(frame, [("a", "/", "deny")])


# -- chats -------------------------------------------------------------------------------------------


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "ok")]
    logged = {1: talk[:2], 2: talk, 3: talk[:3], 4: talk, 5: [("user", "hi")], 6: [("user", "other")], 7: [("user", "hi"), ("assistant", "else")], 8: [(None, None)], 9: [("", "")]}
    rows = [(k, n, role, text, 1) for k, turns in logged.items() for n, (role, text) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place int").repartition(3)
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.format_chats(frame).collect()}
    assert sorted(got) == [2, 6, 7, 8]
    assert got[2] == (4, "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in talk))
    assert chat.format_chats(frame.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, 0, "user", "a"), (None, None, "user", "b"), (3, 1, "u", "x"), (3, 1, "u", "x")], "conv_id bigint, turn bigint, role string, text string")
    assert sorted((repr(r.conv_id), r.n_turns) for r in chat.format_chats(odd).collect()) == [("3", 2), ("None", 1), ("None", 1)]


def test_turns_without_a_conversation_stand_alone(spark):
    rows = [(None, 0, "user", "a"), (None, 5, "user", "a"), (None, 1, "user", "b"), (None, 1, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "user", "x"), (2, 0, "user", "b"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted((repr(r.conv_id), r.rendered) for r in chat.format_chats(frame).collect())
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    # a is there twice, b also under an id, hi begins a longer one
    want = sorted([("None", line("user", "a")), ("None", line("user", "b")), ("None", line("", "")), ("1", line("user", "hi") + line("user", "x"))])
    assert got == want
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted((repr(r[0]), r[2]) for r in con.execute(ORACLE_SQL["op4_chat_formatting"]).fetchall()) == want


# -- fingerprints ------------------------------------------------------------------------------------


def test_canonical_forms():
    same = [" Straße\n\tÉtude ", "strasse e\u0301tude", "STRASSE  ÉTUDE", "ſtrasse étude"]
    assert len({fingerprints.canonical(x) for x in same}) == 1
    assert fingerprints.canonical("a") != fingerprints.canonical("b") and fingerprints.canonical(" \n") == b""


def brute_edits(rows):
    rows = sorted(rows, key=lambda x: -x[0])
    for k, (key, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1] or ""
        text = text or ""
        half = len(text) // 2
        change = text[: len(text) - half] + following[:half]
        form = fingerprints.canonical
        yield key, len(text), change, float(form(change) == form(text)), float(form(following) == form(text))


def test_edits_equal_brute_force(spark):
    draw = random.Random(9)
    texts = ["", None, "é", "Same text", "same  TEXT", "x" * 300] + ["".join(draw.choice("ab é😀\n") for _ in range(draw.randint(0, 60))) for _ in range(150)]
    rows = [(k * 13 - 500, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id bigint, text string, part string").repartition(6)
    got = {r.doc_id: r for r in fingerprints.edit_likeness(frame).collect()}
    assert len(got) == len(rows)
    for key, size, change, near, following in brute_edits(rows):
        r = got[key]
        assert (r.n_chars, r.edited, r.near_edited, r.near_next) == (size, change, near, following)
        assert r.edited_fingerprint == fingerprints.DIGESTS["xxh3_128"](fingerprints.canonical(change))
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(frame).collect()}
    assert prints == {k: r.fingerprint for k, r in got.items()}


def test_edits_of_odd_rows(spark):
    frame = spark.createDataFrame([(5, "ab c"), (None, "xy"), (5, "ab c"), (7, None)], "doc_id bigint, text string")
    got = sorted((repr(r.doc_id), r.edited) for r in fingerprints.edit_likeness(frame).collect())
    assert got == [("5", "abab"), ("5", "abxy"), ("7", ""), ("None", "x")]
    assert fingerprints.edit_likeness(frame.limit(0)).count() == 0
    assert [r.edited for r in fingerprints.edit_likeness(frame.limit(1)).collect()] == ["abab"]


def test_equal_hashes_of_different_texts_are_noticed(spark, monkeypatch):
    monkeypatch.setitem(fingerprints.DIGESTS, "xxh3_128", lambda x: str(len(x)))
    frame = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "AB")], "doc_id bigint, text string")
    assert fingerprints.trusted_digest(frame.where("doc_id <> 2")) == "xxh3_128"
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(frame).collect()}
    assert got[1] == got[3] != got[2]


def test_fingerprint_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, DATA).collect()}
    for key, size, change, near, following in brute_edits(rows):
        r = got[key]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (size, hashlib.sha256(change.encode()).hexdigest(), near, following)


# -- languages ---------------------------------------------------------------------------------------


def test_codewords_are_apart():
    for count in (2, 3, 4, 5, 9, 30):
        code = langid.codewords(count)
        apart = (code[:, None, :] != code[None, :, :]).sum(axis=2)
        assert (apart[~np.eye(count, dtype=bool)] >= max(1, 2 ** (min(count, 5) - 2) if count <= 5 else 4)).all()
        assert (np.abs(code.sum(axis=0)) < count).all()


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op7_language_id"](spark, DATA).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in own) >= 0.97 * len(own)


def brute_profile(text):
    """Shares of hashed n-grams of 1 to 3 bytes, counted one by one."""
    own = bytearray()
    data = text.encode()
    for k, b in enumerate(data):
        if b >= 0x80:
            own.append(b + 0x20 if b <= 0x9E and k and data[k - 1] == 0xC3 else b)
        else:
            own.append(b | 0x20 if chr(b).isalpha() else 0x20)
    counts = {}
    for size in (1, 2, 3):
        for k in range(len(own) - size + 1):
            gram = own[k : k + size]
            if gram.strip(b" "):
                mix = size * 0x27D4EB2F
                for b, m in zip(gram, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)):
                    mix += b * m
                mix &= 0xFFFFFFFF
                mix ^= mix >> 15
                mix = mix * 0x2C1B3C6D & 0xFFFFFFFF
                counts[mix >> 20] = counts.get(mix >> 20, 0) + 1
    norm = sum(counts.values()) ** 0.5
    return {k: n**0.5 / norm for k, n in counts.items()}


def brute_language(model, text):
    """The decoder's answer, bit by bit and language by language."""
    own, total = brute_profile(text), []
    margins = [model.bias[j] + sum(v * model.weights[k, j] for k, v in own.items()) for j in range(len(model.bias))]
    for word, trust in zip(model.code, model.trust):
        total.append(sum(t * math.log1p(math.exp(-c * m)) for c, t, m in zip(word, trust, margins)))
    best = min(range(len(total)), key=lambda k: (total[k], k))
    return model.languages[best], 1 - sorted(total)[0] / sorted(total)[1]


def test_predictions_equal_brute_force(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(documents)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in QUERIES["op7_language_id"](spark, DATA).collect():
        lang, score = brute_language(model, texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert abs(r.score - score) < 1e-4 and (r.lang_pred == lang or score < 1e-4)


def test_only_labelled_rows_that_are_not_held_out_teach(spark):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    base = documents.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").limit(60)
    first = base.where("lang is not null").first()
    held = next(k for k in range(10**6, 10**6 + 99) if zlib.crc32(str(k).encode()) % 5 == 0)
    odd = [(held, "zzz qqq xxx", "en"), (first.doc_id, "zzz qqq xxx", None), (10**6 + 500, None, "de"), (first.doc_id, first.text, first.lang)]
    a, b = (langid.train(x) for x in (base, base.union(spark.createDataFrame(odd, documents.schema)).repartition(3)))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)
    own = spark.createDataFrame([(first.doc_id, "zzz qqq xxx " * 9, "own")], documents.schema)
    assert "own" in langid.train(base.union(own)).languages  # by its own label, though the id repeats


def test_more_than_64_languages(spark):
    draw = random.Random(4)
    words = {f"l{k:02}": ["".join(draw.choices("abcdefghijklmnop", k=3)) + chr(0x61 + k % 26) * 3 + chr(0x61 + k // 26) * 2 for _ in range(12)] for k in range(70)}
    rows = [(n, " ".join(draw.choices(own, k=40)), lang) for n, (lang, own) in enumerate((x for x in words.items() for _ in range(12)))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(frame)
    assert len(model.languages) == 70
    truth = {k: lang for k, _, lang in rows}
    got = langid.identify(frame, model).collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in got if r.held_out) >= 0.95 * sum(r.held_out for r in got)
    few = langid.drawn(frame, 500, 140, "doc_id", "text", "lang").groupBy("lang").count().collect()
    assert len(few) == 70 and all(r["count"] == 2 for r in few)


def test_languages_of_odd_rows(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "", None), (9003, "123 !? \n", "fr"), (9004, "日本", None), (None, "the and of", "en")], base.schema)
    frame = base.union(odd).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in langid.identify(frame, langid.train(frame)).where("doc_id is null or doc_id > 9000").collect()}
    assert [got[k].lang_pred for k in (9001, 9002, 9003)] == ["und"] * 3 and got[9004].lang_pred != "und" and not got[None].held_out
    kept = {r.doc_id for r in langid.keep_identified(frame).where("doc_id is null or doc_id > 9000").collect()}
    assert kept == {9004, None}
    empty = base.limit(0)
    assert langid.train(empty) is None and langid.identify(empty, None).count() == 0 and langid.keep_identified(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(base, None).collect()} == {"und"}


def test_ambiguous_and_letterless_texts_are_dropped(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = [(900001, "mary.smith@example.com bob@x.org", None), (900002, "xkcd 9 qq ## zz", None), (900003, "12 34 !!", None), (900004, "lorem ipsum dolor sit amet", None), (900005, "http://www.example.com/a/b?c=d", None)]
    frame = base.union(spark.createDataFrame(odd, base.schema))
    model = langid.train(frame)
    verdict = {r.doc_id: r for r in langid.identify(frame, model).collect()}
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, frame, DATA).collect()}
    least = min(langid.AMBIGUOUS, model.margin)
    assert least > 0
    gone = {k for k, r in verdict.items() if r.lang_pred == "und" or r.score < least}
    assert kept == set(verdict) - gone and 900003 in gone and len(gone & {r[0] for r in odd}) > 1
    assert all(verdict[k].ambiguous or verdict[k].lang_pred == "und" for k in gone)
    assert sum(r.doc_id not in kept for r in base.collect()) <= langid.LOST * base.count()
    unlabelled = frame.where("doc_id > 900000")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, unlabelled, DATA).collect()} == {900001, 900002, 900004, 900005}


def test_ambiguity_is_flagged():
    model = langid.Model(["a", "b"], np.array([[1.0], [-1.0]]), np.zeros((langid.BINS, 1)), np.zeros(1), np.ones((2, 1)))
    best, score = model.decode(np.array([[0.0], [4.0], [-4.0]]))
    assert score[0] == 0 and best.tolist()[1:] == [0, 1] and (score[1:] > 0.9).all()

import random

import corpus_pipeline
from conftest import DATA

from peerscope.llm.bpe import FragmentEncoder
from peerscope.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect_on_planted_cases(spark):
    """Exact and near copies, shared passages and letterless texts go; clean documents stay as they are."""
    from test_dedup import brute_near, brute_repeats
    from test_tokens import check_packing

    draw = random.Random(12)
    base = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(120).collect()
    rows = [tuple(r[c] for c in COLUMNS) for r in base]
    long = next(r for r in rows if len(r[1].split()) > 150)
    words = long[1].split(" ")
    words[70] = "changed"
    passage = " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    own = [" ".join("".join(draw.choice("ijklmnop") for _ in range(6)) for _ in range(80)) for _ in range(2)]
    planted = [(9000, long[1], "en", "s", 1), (9001, " ".join(words), "en", "s", 1), (9002, "12 34 !!", "en", "s", 8), (9003, None, None, None, None), (9004, f"First {own[0]} {passage} begin.", "en", "s", 1), (9005, f"Second text with {own[1]} {passage} and more words.", "en", "s", 1)]
    docs = spark.createDataFrame(rows + planted, spark.read.parquet(f"{DATA}/documents.parquet").schema)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == COLUMNS
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    everything = {r[0]: r[1] for r in rows + planted}
    assert set(everything) - set(seen["language_id"]) == {9002, 9003}
    last = {}
    for key in sorted(seen["language_id"]):
        last[everything[key]] = key
    assert set(seen["exact_dedup"]) == set(last.values()) and 9000 in seen["exact_dedup"]
    groups = brute_near([(k, everything[k]) for k in seen["exact_dedup"]], 5, 80)
    assert set(seen["near_dedup"]) == {k for k, (_, c) in groups.items() if c == k} and 9001 not in seen["near_dedup"]
    want = {k: x[3].decode("utf-8", "replace") for k, x in brute_repeats([(k, everything[k]) for k in seen["near_dedup"]], 100).items()}
    left = seen["suffix_dedup"]
    assert passage in left[9004] and passage not in left[9005] and left[9005].startswith("Second text with")
    assert {k for k, v in want.items() if v} == set(left) and all(abs(len(left[k]) - len(v)) <= 4 for k, v in want.items() if v)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    encoder = FragmentEncoder(tokenizer_path(), tuple)
    check_packing(packed, {k: encoder.whole.encode(v, add_special_tokens=False).ids for k, v in left.items()}, 4096, 1.0)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]


def written(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], schema)).count() == 0


def test_rows_of_null_and_repeated_ids_extra_columns_and_long_texts(spark, tmp_path):
    draw = random.Random(5)
    text = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(n))
    a, b, c, d, long = text(60), text(60), text(60), text(60), text(40_000)
    near = b + " and one more word"
    rows = [(None, a), (None, b), (7, c), (7, d), (8, c), (9, near), (10, None), (11, ""), (12, "12 34"), (13, long), (14, long)]
    schema = "doc_id bigint, text string, lang string, __id int, __row string, part string, ids int"
    folder = written(spark, tmp_path, [(k, t, None, 1, "r", "p", 2) for k, t in rows], schema)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "__id", "__row", "part", "ids"], name
    kept = sorted((repr(r.doc_id), r.text) for r in docs.collect())
    # of c the larger id stays, of the near copies the smaller, which a null id is not
    assert kept == sorted([("None", a), ("7", d), ("8", c), ("9", near), ("14", long)])
    encoder = FragmentEncoder(tokenizer_path(), tuple)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.length for r in packed if r.doc_id != 14) == sorted(len(encoder.whole.encode(t, add_special_tokens=False).ids) + 1 for k, t in kept if k != "14")
    assert sum(r.length for r in packed if r.doc_id == 14) == len(encoder.whole.encode(long, add_special_tokens=False).ids) + 1

"""A pipeline over ``documents``: each stage works on what its predecessor kept.

Language ID drops texts without letters, null and empty ones among them, and those whose language is ambiguous. The two
deduplication stages keep one document of each group: of equal texts the largest id, of near copies the smallest; rows
that are alike in id and text count as copies. The suffix stage cuts repeated passages out of the texts, and documents
of which nothing is left go. Packing places the tokens of what is left.

Rows of null and repeated ids are documents of their own throughout. Texts may be as long as a row can be; further
columns, of any name, are carried along up to packing. An empty table gives no rows. Ties are stated by each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerscope.llm import exact_dedup, langid, near_dedup, packing, suffix_dedup
from peerscope.llm.queries import tokenizer_path
from peerscope.staging import drop_staged, scratch, staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.AMBIGUOUS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs, keep_columns=True)
    if "n_chars" not in cut.columns:
        return cut
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast(cut.schema["n_chars"].dataType), "n_chars"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("suffix_dedup", repeated_passages),
    ("packing", packed_sequences),
]

#: SQL has neither the classifier nor the suffix array; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = staged(stage(spark, docs, sf_dir), name, outlive=True)
        if read is not None:
            drop_staged(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)

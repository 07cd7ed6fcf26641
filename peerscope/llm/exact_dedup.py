"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its content says so: between words that end and begin with certain letters, and after 8,192
characters without such a place.
A chunk's identifier is a pair of 64-bit hashes. Before it is used, the distinct chunk texts are brought together
once and compared: an identifier that stands for two texts is not used, and the wider SHA-256 takes its
place (checked the same way). A document then is its recipe, the ordered list of identifiers, and equal
documents have equal recipes. Only recipes are shuffled from there on, however long the documents are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.llm.rows import free_name, numbered, told_apart
from peerscope.staging import staged

MOST_CHARS = 8192
#: A place to cut: white space between one of two letters and one of two others, about one character in a thousand.
#: It depends on three characters only, so copies of a passage are cut alike wherever they stand.
PLACE = r"(?<=[hlHL]\s)(?=[dgDG])"


def chunks(text: Column, most: int = MOST_CHARS) -> Column:
    """The chunks of a text in order; together they are the text, and the empty text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{most}}}?(?:{PLACE}|\z)|.{{1,{most}}}"), F.lit(0))


#: Of 10^12 chunks two share a pair of 64-bit hashes with a chance below 10^-14.
IDENTIFIERS = {"xxhash64_pair": lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b")), "sha256": lambda c: F.sha2(c, 256)}


def colliding(texts: DataFrame, identifier: str) -> bool:
    """Whether two different chunks of column ``text`` share an identifier."""
    distinct = texts.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(IDENTIFIERS[identifier]("chunk").alias("id"), "chunk").distinct()
    return not distinct.groupBy("id").count().where("count > 1").isEmpty()


def exact_groups(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when all their bytes are; null counts as empty. Of equal texts the row with the largest
    id stays; a null id is below any other. Rows that repeat id and text share one answer, and
    ``group_size`` counts each of them. A null id that is its group's largest stays. An empty table gives no rows.
    """
    texts = documents.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    identifier = next((k for k in IDENTIFIERS if not colliding(texts, k)), None)
    if identifier is None:
        raise ValueError("two different chunks share a SHA-256 digest")
    recipe = F.transform(chunks(F.col("text")), IDENTIFIERS[identifier])
    recipes = staged(texts.select("doc_id", recipe.alias("recipe"), F.sha2("text", 256).alias("text_sha256")), "recipes")
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("largest"), F.count(F.lit(1)).alias("copies"))
    # written, so that the join reads both sides by plain shuffles and a large group can be split among tasks
    shared = staged(groups.where("copies > 1"), "groups")
    alone = F.col("copies").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("largest"))
    out = recipes.join(shared, "recipe", "left").select("doc_id", keep.alias("keep_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``documents`` without the rows whose text another row with a larger id has; of rows alike in id and text one stays.

    A null id is below any other. Other columns may have any name; an empty table gives no rows.
    """
    rows, key = documents, id_column
    if not told_apart(documents, id_column):
        key = free_name(documents, "__row")
        rows = numbered(documents, id_column, text_column, key, nulls_first=True)
    own = free_name(rows, "__id")
    kept = exact_groups(rows, key, text_column).where("kept").select(F.col("doc_id").alias(own))
    out = rows.join(kept, F.col(key) == F.col(own), "left_semi")
    return out if key == id_column else out.drop(key)

"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation several times, as it was after each turn. A rolling hash over the turns
gives every prefix of a conversation a key. A conversation whose whole key is a proper prefix key of another
one is a snapshot; an anti-join drops it. Of conversations that are alike in all turns one stays. The rest
are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"


def prefix_keys(conversations: DataFrame) -> DataFrame:
    """Turns with their place in the conversation (from 1) and the key of the prefix that ends there.

    The key is the running exclusive-or of two 64-bit hashes of (place, role, text): a frame that grows row by
    row, so a conversation is streamed and never held. A turn without a ``conv_id`` is a conversation of its own.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = lambda x: x.withColumn("a", F.xxhash64("place", "role", "text")).withColumn("b", F.xxhash64("text", F.lit("|"), "role", "place"))
    placed = hashed(turns.where("conv_id is not null").withColumn("place", F.row_number().over(order).cast("long")))
    joined = placed.withColumn("key_a", F.bit_xor("a").over(running)).withColumn("key_b", F.bit_xor("b").over(running)).drop("a", "b")
    single = hashed(turns.where("conv_id is null").withColumn("place", F.lit(1).cast("long")))
    return joined.unionByName(single.withColumnsRenamed({"a": "key_a", "b": "key_b"}))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, key_a, key_b`` of the conversations that are not a prefix of a longer one.

    Of conversations with the same turns the smallest id stays, a null one before any other. Null roles and texts count
    as empty; equal turn numbers are ordered by role and text, null ones first.
    """
    own = Window.partitionBy("conv_id")
    ends = prefix_keys(conversations)
    named = ends.where("conv_id is not null").select("conv_id", F.max("place").over(own).alias("n_turns"), "place", "key_a", "key_b")
    ends = named.unionByName(ends.where("conv_id is null").select("conv_id", F.col("place").alias("n_turns"), "place", "key_a", "key_b"))
    whole = ends.where("place = n_turns").groupBy("n_turns", "key_a", "key_b").agg(F.min(F.struct("conv_id")).alias("first"))
    proper = ends.where("place < n_turns").select("place", "key_a", "key_b").distinct()
    same = (F.col("w.n_turns") == F.col("p.place")) & (F.col("w.key_a") == F.col("p.key_a")) & (F.col("w.key_b") == F.col("p.key_b"))
    return whole.alias("w").join(proper.alias("p"), same, "left_anti").select(F.col("first.conv_id").alias("conv_id"), "n_turns", "key_a", "key_b")


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``rendered`` of every maximal conversation; extra columns are left out.

    A conversation is rendered into one row, so it must fit there; texts may be as long as that allows. Turns that are
    repeated count each. An empty table gives no rows.
    """
    kept = maximal_conversations(conversations)
    line = F.concat(F.lit(BEGIN), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    turns = prefix_keys(conversations).withColumn("line", line)
    named = turns.where("conv_id is not null").select("conv_id", "place", "line").join(kept.select("conv_id", "n_turns"), "conv_id")
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    whole = named.groupBy("conv_id", "n_turns").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("rendered"))
    single = turns.where("conv_id is null").groupBy("key_a", "key_b").agg(F.first("line").alias("rendered"))
    alone = kept.where("conv_id is null").join(single, ["key_a", "key_b"]).select("conv_id", "n_turns", "rendered")
    return whole.union(alone)

"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums

ROW_BYTES = 16
#: A group of equal texts of at most this part of a shard is not cut.
WHOLE = 100


def text_size(text: str = "text") -> F.Column:
    """UTF-8 bytes of the text (null: none) and a fixed 16 for the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot.

    Rows stand in the order of (CRC-32 of the text, id), so equal texts are neighbours. The order's byte prefix sum is
    cut at ``shards`` equal targets: a row belongs to the shard in which its middle byte falls, so each cut is off by at
    most half a document. A small group of equal texts (1 % of a shard or less) follows its own middle and stays whole;
    larger ones are split, or a frequent text would make one shard too large. Shards are contiguous; slot counts their rows from 0.

    A null text has size 16 and CRC-32 0, as the empty text has; rows with equal ids or texts, and null ids, are kept as rows
    of their own; an empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_size(text_col).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    placed, totals = prefix_sums(rows, ["text_crc32", "doc_id"], "size")
    total = max(1, totals.get(0, (0, 0))[0])

    def shard_at(before: str, size: str) -> F.Column:
        return F.expr(f"int(least({shards - 1}, ((2 * {before} + {size}) * {shards}) div {2 * total}))")

    placed = placed.withColumn("shard", shard_at("_before", "size"))
    cut = placed.groupBy("text_crc32").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"), F.min("_before").alias("b"), F.sum("size").alias("s"))
    cut = cut.where((F.col("lo") < F.col("hi")) & (F.col("s") * shards * WHOLE <= total))  # each holds a cut, so there are fewer than shards
    placed = placed.join(F.broadcast(cut.select("text_crc32", shard_at("b", "s").alias("whole"))), "text_crc32", "left")
    placed = placed.withColumn("shard", F.coalesce("whole", "shard"))
    first = placed.groupBy("shard").agg(F.min("_index").alias("first"))
    out = placed.join(F.broadcast(first), "shard")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_index") - F.col("first")).alias("slot"))

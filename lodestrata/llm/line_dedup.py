"""Exact line dedup over a corpus that returns bitmaps of kept lines; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE, ascii_lower, stored, tasks

MIN_CHARS = 10
#: Lines of the sample (about) that tells frequent lines, the share of it that makes one frequent, and so at most how many there are.
SAMPLE, FREQUENT = 100_000, 1000


def lines_of(text: F.Column) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: F.Column) -> F.Column:
    """Stripped and lower-cased; trimming by a set of characters is slow, so only lines that begin or end with one go there."""
    ends = [F.ascii(F.substring(line, i, 1)) for i in (1, -1)]
    edge = (ends[0] == 32) | ends[0].between(9, 13) | (ends[1] == 32) | ends[1].between(9, 13)
    return ascii_lower(F.when(edge, F.btrim(line, F.lit(SPACE))).otherwise(line))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and ``drops`` of each document that loses lines.

    ``drops`` is a sparse bitmap: a map from a word's number to 64 bits, where bit i of word w is set if line 64 * w + i
    goes; words without such a line aren't stored, so a document that keeps all its lines has no row.

    A line's key is the line stripped of SPACE with A-Z lower-cased; keys of at least min_chars code points that two or
    more documents hold keep only their lines in the smallest id. Two 64-bit hashes stand for a key. The hashes are
    range-partitioned, and each partition streams its rows in the order of hash, document and position: the first row of a hash
    names the document that keeps it, and rows of later documents go. Lines that a sample shows to be frequent, FREQUENT at
    most, would each be one task's; their first documents come from partial sums instead, and meet their rows by a broadcast of that size.
    What the sample misses is streamed as any other line: it decides where a line is settled, never how.

    A null or empty text is one empty line. Null ids count as one document after all others. Rows that share an id are
    one document; the text's hash tells their bitmaps apart. An empty table gives no rows.
    """
    lines = docs.select(doc_key(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"), F.posexplode(lines_of(F.col(text_col))).alias("_pos", "_line"))
    lines = lines.select("_id", "_th", "_pos", line_key(F.col("_line")).alias("_key")).where(F.char_length("_key") >= min_chars)
    hashed = lines.select(F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(1), "_key").alias("_g"), "_id", "_th", "_pos")
    hashed = stored(hashed, "lines")  # counted, sampled and ranged; texts are split and hashed only once
    frequent = stored(frequent_lines(hashed), "frequent")
    rest = hashed.join(F.broadcast(frequent), ["_h", "_g"], "left_anti").repartitionByRange(tasks(docs.sparkSession), "_h", "_g")
    gone = rest.withColumn("_first", F.first("_id").over(Window.partitionBy("_h", "_g").orderBy("_id", "_pos"))).where("_id > _first")
    gone = gone.unionByName(hashed.join(F.broadcast(frequent), ["_h", "_g"]).where("_id > _first"))
    words = gone.groupBy("_id", "_th", F.shiftright("_pos", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, _pos & 63)")).alias("bits"))
    return words.groupBy("_id", "_th").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("drops"))


def frequent_lines(hashed: DataFrame) -> DataFrame:
    """_h, _g, _first of the lines that make over one in FREQUENT of a sample, and so FREQUENT at most: the smallest document that holds each."""
    bound = int(min(1.0, SAMPLE / max(1, hashed.count())) * 2**63) - 1
    some = hashed.where(F.xxhash64("_id", "_pos", F.lit(9)).bitwiseAND(F.lit(2**63 - 1)) <= bound)
    least = max(8, some.count() // FREQUENT)
    hot = some.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).orderBy(F.desc("n"), "_h", "_g").limit(FREQUENT).select("_h", "_g")
    return hashed.join(F.broadcast(hot), ["_h", "_g"]).groupBy("_h", "_g").agg(F.min("_id").alias("_first"))


def doc_key(id_col: str) -> F.Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the other lines, joined) of each row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), doc_key(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"))
    rows = rows.join(bitmaps, ["_id", "_th"], "left").withColumn("_lines", lines_of(F.col("_text")))
    word = lambda i: F.coalesce(F.element_at("drops", F.shiftright(i, 6)), F.lit(0).cast("long"))
    kept = F.filter("_lines", lambda _, i: F.getbit(word(i), i.bitwiseAND(F.lit(63))) == 0)
    dropped = F.coalesce(F.aggregate(F.map_values("drops"), F.lit(0), lambda n, bits: n + F.bit_count(bits)), F.lit(0))
    whole = F.coalesce(F.col("_text"), F.lit(""))
    return rows.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), F.when(F.col("drops").isNull(), whole).otherwise(F.array_join(kept, "\n")).alias("kept"))

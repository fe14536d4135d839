"""Readers of the engine's inputs; all are Spark scans with a fixed schema, so nothing is inferred and columns are pruned."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked

CHUNK = "chunk_id string, doc_id string, source_file string, title string, section string, page_start long, page_end long, chunk_index string, token_count long, text string, quality_score double, section_path array<string>, block_types array<string>"
BLOCK = "struct<block_id:string,type:string,text:string,section_path:array<string>,page:long>"
PARSED = f"doc_id string, source_file string, total_pages long, parser_stage string, pages array<struct<page:long,text:string,blocks:array<{BLOCK}>>>"
SAMPLE = "id string, question string, reference string, tags array<string>, scenario string, ability string, difficulty string, risk_level string, expected_behavior string, expected_doc_ids array<string>, expected_sections array<string>, expected_route string, expected_min_citations long"
SPEC = "id string, query string, expected_doc_id string, expected_keywords array<string>, expected_block_types array<string>, category string, exclude_from_primary_metrics boolean, notes string"


def stem(path: str = "_metadata.file_name") -> F.Column:
    return F.regexp_replace(F.col(path), r"\.[^.]*$", "")


def parsed_json(spark: SparkSession, path: str) -> DataFrame:
    """One row for each parsed document: doc_id (the file's stem if absent), raw_text (pages joined), has_blocks."""
    return parsed_rows(spark.read.schema(PARSED).json(path, multiLine=True), stem())


def parsed_rows(x: DataFrame, name: F.Column) -> DataFrame:
    """parsed_json of rows that are read already; name stands for an absent doc_id."""
    x = x.withColumn("_stem", name)
    blocks = F.flatten(F.transform("pages", lambda p: F.coalesce(p["blocks"], F.array().cast(f"array<{BLOCK}>"))))
    return x.select(F.coalesce("doc_id", "_stem").alias("doc_id"), "source_file", "total_pages", "pages", F.array_join(F.transform("pages", lambda p: F.coalesce(p["text"], F.lit(""))), "\n").alias("raw_text"), (F.size(blocks) > 0).alias("has_blocks"), blocks.alias("blocks"))


def block_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.posexplode("blocks").alias("ord", "b")).select("doc_id", F.col("ord").cast("long").alias("ord"), "b.block_id", F.col("b.type").alias("kind"), "b.text", "b.section_path", "b.page")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's stem), source_file, raw_text of each file."""
    return spark.read.text(path, wholetext=True).select(stem().alias("doc_id"), F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("raw_text"))


def binary_pages(spark: SparkSession, path: str, pages: Callable[[bytes], list[tuple[int, str]]]) -> DataFrame:
    """doc_id, page, text of binary files through ``pages``, a parser that the caller brings (no PDF library is needed here); a
    file that it can't read gives one row with page null and the error as text."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, content in zip(b["doc_id"], b["content"], strict=True):
                try:
                    rows += [(d, n, t, None) for n, t in pages(bytes(content))]
                except Exception as e:  # noqa: BLE001  the parser is foreign code; its failure is a row of the result
                    rows.append((d, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "error"]).astype({"page": "Int64"})

    return spark.read.format("binaryFile").load(path).select(stem().alias("doc_id"), "content").mapInPandas(parse, "doc_id string, page long, text string, error string")


def preferred(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The documents of first and those of each next reader whose doc_id came in none before it."""
    cols = ["doc_id", "source_file", "raw_text"]
    out = first.select(cols)
    for o in others:
        out = out.unionByName(o.select(cols).join(out.select("doc_id"), "doc_id", "left_anti").select(cols))
    return out


def lines_of(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed lines) of a JSON-lines file; blank lines and lines that begin with # are neither."""
    raw = spark.read.text(path).where("trim(value) != '' and not startswith(trim(value), '#')")
    fields = [f.name for f in spark.createDataFrame([], schema).schema]
    read = raw.select("value", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return read.where("r._bad is null").select(*[F.col(f"r.{c}").alias(c) for c in fields]), read.where("r._bad is not null").select(F.col("value").alias("line"))


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines: empty strings for absent texts, the line's place for an index that is no number; rows without ids are left out."""
    rows, _ = lines_of(spark, path, CHUNK)
    rows = rows.where("chunk_id is not null and doc_id is not null")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("source_file", "title", "section", "text")}).withColumn("_o", F.monotonically_increasing_id())
    return rows.withColumn("chunk_index", F.coalesce(F.expr("try_cast(chunk_index as long)"), F.col("_o"))).drop("_o")


def chunks_or_else(spark: SparkSession, path: str, fallback: DataFrame) -> DataFrame:
    """The chunks at path, or the table if there is nothing there; decided when the plan is made."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return chunk_lines(spark, path) if there else fallback


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples from JSON lines, a JSON list, or an object with samples, items or data."""
    if path.endswith(".jsonl"):
        return lines_of(spark, path, SAMPLE)[0]
    item = f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in SAMPLE.split(','))}>>"
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", item)
    wrapped = F.from_json("value", f"samples {item}, items {item}, data {item}")
    x = raw.select(F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(wrapped["samples"], wrapped["items"], wrapped["data"])).alias("s"))
    return x.select(F.explode("s").alias("s")).select("s.*")


def query_specs(spark: SparkSession, path: str) -> DataFrame:
    return lines_of(spark, path, SPEC)[0].withColumn("exclude_from_primary_metrics", F.coalesce("exclude_from_primary_metrics", F.lit(False)))


def name_map(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, old_name, new_name from CSV with a header (a byte-order mark is no part of it) or JSON lines."""
    if path.endswith(".csv"):
        x = spark.read.csv(path, header=True)
        x = x.toDF(*[c.lstrip("﻿") for c in x.columns])
        return x.select("doc_id", "old_name", "new_name")
    return lines_of(spark, path, "doc_id string, old_name string, new_name string")[0]


def turns(spark: SparkSession, path: str) -> DataFrame:
    """session_id, turn_no, role, content from an object of lists by session id."""
    return turn_rows(spark.read.text(path, wholetext=True))


def turn_rows(objects: DataFrame) -> DataFrame:
    """turns of JSON objects in a column ``value``."""
    x = objects.select(F.from_json("value", "map<string,array<struct<role:string,content:string>>>").alias("m"))
    x = x.select(F.explode("m").alias("session_id", "t")).select("session_id", F.posexplode("t").alias("turn_no", "x"))
    return x.select("session_id", F.col("turn_no").cast("long").alias("turn_no"), "x.role", "x.content")


def section_index(chunk_rows: DataFrame) -> DataFrame:
    """doc_id, sections (in order), distinct sections."""
    x = ranked(chunk_rows, ["doc_id"], [F.col("chunk_index"), F.col("chunk_id")], "_r")
    per = x.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("_r", "section"))).alias("s"), F.array_sort(F.collect_set("section")).alias("distinct_sections"))
    return per.select("doc_id", F.transform("s", lambda v: v["section"]).alias("sections"), "distinct_sections")

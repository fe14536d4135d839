"""Writers and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ranking import global_rank, top


def upserted(table: DataFrame, fresh: DataFrame, key: str = "chunk_id") -> DataFrame:
    """table with fresh rows in the place of those of the same key; a null page becomes -1. The last of repeated fresh keys (by all columns) counts."""
    pages = {c: F.coalesce(c, F.lit(-1)) for c in ("page_start", "page_end") if c in fresh.columns}
    both = table.withColumn("_new", F.lit(0)).unionByName(fresh.withColumns(pages).withColumn("_new", F.lit(1)))
    rest = [F.desc(F.col(c).cast("string")) for c in table.columns if c != key]
    return top(both, [key], [F.desc("_new"), *rest], 1, "_n").drop("_new", "_n")


def without(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """table without the rows of the ids (an anti join)."""
    return table.join(ids.select(key), key, "left_anti")


def rebuilt(table: DataFrame, fresh: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with the documents of ids replaced by their rows in fresh, doc_id with old and new counts)."""
    new = fresh.join(ids.select("doc_id"), "doc_id", "left_semi")
    count = lambda df, name: df.join(ids.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    change = ids.select("doc_id").distinct().join(count(table, "old"), "doc_id", "left").join(count(new, "new"), "doc_id", "left")
    return without(table, ids).unionByName(new), change.select("doc_id", F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).alias("new"))


def checked(rows: DataFrame, limits: dict[str, int], dim: int | None = None, vector: str = "embedding") -> DataFrame:
    """The rows that break the collection's schema: a string above its length, a null key, a vector of another length; with why."""
    why = [F.when(F.char_length(c) > n, f"{c}_too_long") for c, n in limits.items()] + [F.when(F.col(next(iter(limits))).isNull(), "null_key")]
    if dim is not None:
        why.append(F.when(F.coalesce(F.size(vector), F.lit(-1)) != dim, "wrong_dimension"))
    return rows.withColumn("why", F.array_compact(F.array(*why))).where(F.size("why") > 0)


def write_parsed(blocks: DataFrame, path: str) -> None:
    """A JSON line for each document with its pages and blocks."""
    pages = blocks.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("ord", F.col("kind").alias("type"), "text"))).alias("blocks"))
    docs = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "blocks"))).alias("pages"), F.max("page").alias("total_pages"))
    docs.withColumn("parser_stage", F.lit("parsed_clean_v1")).write.mode("overwrite").json(path)


def preview(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown: headings and paragraphs in order, table text in a code block."""
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), "text")).when(F.col("kind") == "table_text", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    per = blocks.where("kind != 'noise'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("l")))).alias("p"))
    return per.select("doc_id", F.array_join(F.transform("p", lambda v: v["l"]), "\n\n").alias("markdown"))


def audit_events(rows: DataFrame, kind: str, payload: list[str]) -> DataFrame:
    """timestamp_utc, event_type, payload (JSON) for an audit log; append it with write.mode('append')."""
    return rows.select(F.current_timestamp().alias("timestamp_utc"), F.lit(kind).alias("event_type"), F.to_json(F.struct(*payload)).alias("payload"))


def last_turns(turns: DataFrame, n: int = 12, key: str = "session_id", order: str = "turn_no") -> DataFrame:
    """The last n turns of each session."""
    return top(turns, [key], [F.desc(order)], n, "_n").drop("_n")


def rename_plan(names: DataFrame) -> DataFrame:
    """old_name, new_name (doc_0001.pdf by name), problem: a number for each file and what would collide."""
    placed = global_rank(names.select("old_name"), [F.lower(F.substring("old_name", 1, 1)), F.col("old_name")], "_n")
    out = placed.select("old_name", F.format_string("doc_%04d.pdf", "_n").alias("new_name"))
    repeats = names.groupBy("old_name").agg(F.count(F.lit(1)).alias("_c"))
    return out.join(repeats, "old_name").select("old_name", "new_name", F.when(F.col("_c") > 1, "repeated_name").alias("problem"))


def report_lines(metrics: DataFrame) -> DataFrame:
    """A markdown row for each metric."""
    return metrics.select("metric", F.concat(F.lit("| "), "metric", F.lit(" | "), F.coalesce(F.format_string("%.4f", "value"), F.lit("-")), F.lit(" |")).alias("line"))


def fitted_name(name: F.Column) -> F.Column:
    """A readable name: white space squeezed, signs that file systems refuse replaced, 120 characters at most."""
    return F.substring(F.regexp_replace(T.squeezed(name, 10_000), r'[\\/:*?"<>|]', "_"), 1, 120)

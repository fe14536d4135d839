"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding, each over what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontam, langid, mixing, sharding, similar, simhash
from lodestrata.llm.common import removed, stored
from lodestrata.llm.queries import language_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words have a language; text without letters, or of no learned language, goes."""
    return langid.keep_known(docs.select(COLUMNS), language_model(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates by fingerprint alone, as in op5: the first half of the stage."""
    return simhash.one_of_each_group(docs.select(COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same, and of what is left one document of each group linked by an exact Jaccard similarity of 0.8 or more of their 5-word runs."""
    return similar.one_of_each_group(docs.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_contaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, and parts of documents, that the mix draws; repeated where a source's target asks for it."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mix goes: doc_id, size, text_crc32, shard, slot."""
    return sharding.shard_by_bytes(docs, 40)


STAGES = [("language ID", language), ("near-dedup", near_copies), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: A random field, fingerprints by XXH64 and edit-distance search have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is a Parquet table in the shared folder, so a lost executor repeats one stage at most.

    A stage's table goes once the next one's is written, and the last when the driver's JVM ends: the folder holds two at most.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, docs = docs, stored(out, f"pipeline-{k}")
            if k:
                removed(before)
    return out

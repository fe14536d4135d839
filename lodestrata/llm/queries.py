"""The thin queries of the contracts: each calls its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lm_scoring, toxicity
from .ann import nearest
from .decontam import contaminated
from .jaccard import jaccard_components
from .leaderboard import leaderboard_changes
from .line_dedup import apply_bitmaps, keep_bitmaps
from .mixing import mix, taken
from .sharding import shard_by_bytes
from .simhash import near_duplicates
from .url_filter import filter_urls
from .vector_codes import encode, with_label_errors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"), ["doc_id"])
    facts = spark.createDataFrame([(p.code, p.size, p.target) for p in m.plan] or [(0, 0, 0.0)], "_code int, source_size long, target double")
    out = taken(m).join(F.broadcast(facts), "_code")
    return out.select(F.col("_c_doc_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), fold(7) == 2)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fold(n: int) -> F.Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(toxicity.sample(docs, labels.where(fold(5) != 0)))
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def language_model(docs: DataFrame) -> langid.Crf | None:
    return langid.train(langid.sample(docs.where(fold(3) != 1)))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.label_documents(docs, language_model(docs))
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: Fixed values of the contract: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op12_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaderboard_changes(*(table(spark, sf_dir, t) for t in ("sale_lines", "vendors", "items")))
    return out.withColumnRenamed("grp", "nation_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = encode(table(spark, sf_dir, "embeddings"))
    out = with_label_errors(codes.rows)
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest).alias("codebooks_sha256"))


OPERATORS = (
    op1_sharding, op2_mixing, op3_lm_scoring, op4_line_dedup, op5_simhash, op6_toxicity, op7_langid, op8_url_filter, op9_decontamination, op10_ann,
    op11_jaccard_join, op12_leaderboard, op13_vector_codes,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

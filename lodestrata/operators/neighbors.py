"""Chunks around the chunks that an answer starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Settings
from .ranking import ranked, top

SETTINGS = Settings()
HIGH = ("results", "results and discussion", "discussion", "conclusion", "conclusions", "abstract")
LOW = ("references", "bibliography", "acknowledgements", "acknowledgments", "author information")
WEAK = ("title", "introduction", "background")


def positions(chunk_rows: DataFrame) -> DataFrame:
    """chunk_rows with pos, each chunk's place in its document from 0 by chunk_index."""
    return ranked(chunk_rows, ["doc_id"], [F.col("chunk_index"), F.col("chunk_id")], "_p").withColumn("pos", F.col("_p") - 1).drop("_p")


def around(seeds: DataFrame, placed: DataFrame, window: int) -> DataFrame:
    """A row for each seed (qid, chunk_id, rank, rerank_score) and chunk at most ``window`` places from it: step is the distance
    with its sign. Offsets are expanded, so the join is on (doc_id, pos)."""
    at = seeds.join(placed.select("chunk_id", "doc_id", "pos"), "chunk_id")
    steps = F.explode(F.sequence(F.lit(-window).cast("long"), F.lit(window).cast("long"))).alias("step")
    wide = at.select("qid", F.col("chunk_id").alias("seed_id"), F.col("rank").alias("seed_rank"), F.col("rerank_score").alias("seed_score"), "doc_id", F.col("pos").alias("seed_pos"), steps)
    return wide.withColumn("pos", F.col("seed_pos") + F.col("step")).join(placed, ["doc_id", "pos"])


def expand(seeds: DataFrame, placed: DataFrame, window: int = SETTINGS.neighbor_window, cap: int = SETTINGS.neighbor_cap) -> DataFrame:
    """The seeds and their neighbours, each chunk once, by the seed that reaches it first (in the order seed, -1, +1, -2, +2), at
    most cap for a question (or as many as there are seeds), in document order: qid, chunk_id, doc_id, pos, seed_id, is_neighbor, rerank_score, place."""
    order = F.abs("step") * 2 - (F.col("step") < 0).cast("int")
    x = around(seeds, placed, window).withColumn("_o", order)
    x = top(x, ["qid", "chunk_id"], [F.col("seed_rank"), F.col("_o")], 1, "_first")
    most = seeds.groupBy("qid").agg(F.greatest(F.lit(cap).cast("long"), F.count(F.lit(1))).alias("_most"))
    x = ranked(x, ["qid"], [F.col("seed_rank"), F.col("_o")], "_n").join(most, "qid").where("_n <= _most")
    x = x.withColumns({"is_neighbor": F.col("step") != 0, "rerank_score": T.six(F.when(F.col("step") != 0, F.greatest(F.col("seed_score") - 0.01, F.lit(0.0))).otherwise(F.col("seed_score")))})
    return ranked(x, ["qid"], [F.col("doc_id"), F.col("pos")], "place").select("qid", "chunk_id", "doc_id", "pos", "seed_id", "is_neighbor", "rerank_score", "place")


def audit(seeds: DataFrame, placed: DataFrame, questions: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """What neighbours could add: each chunk near a seed that is no seed, by its nearest seed, at most audit_per_seed for a seed,
    with a decayed score and a verdict (excluded, context_only, dry_run_promoted) and its reason. It changes no answer."""
    x = around(seeds, placed, s.audit_window).where("step != 0").join(seeds.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    x = x.withColumn("distance", F.abs("step").cast("long"))
    x = top(x, ["qid", "chunk_id"], [F.col("distance"), F.col("seed_rank")], 1, "_first")
    x = top(x, ["qid", "seed_id"], [F.col("distance"), F.col("step"), F.col("chunk_id")], s.audit_per_seed, "_n").join(questions.select("qid", "question", "intent"), "qid")
    low, section = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.btrim(F.coalesce("section", F.lit(""))))
    shared = F.size(F.array_intersect(T.long_words("question"), T.long_words("text")))
    has = lambda w: F.contains(low, F.lit(w))
    x = x.withColumns({"overlap": shared.cast("long"), "_high": section.isin(*HIGH), "_weak": section.isin(*WEAK), "_low": section.isin(*LOW)})
    bonus = F.least(F.lit(1.3), F.when(low.rlike(r"\d"), 0.3).otherwise(0.0) + F.when(T.has_any(low, s.lexicon.result), 0.3).otherwise(0.0) + F.when(has("[table text]") | has("[table caption]"), 0.2).otherwise(0.0)
                    + F.when(has("[figure caption]") | has("fig."), 0.1).otherwise(0.0) + F.when(F.col("_high"), 0.2).otherwise(0.0) + F.when(F.col("overlap") >= 2, 0.2).otherwise(0.0))
    near, far = s.audit_decay
    base = F.col("seed_score") * F.when(F.col("distance") <= 1, near).otherwise(far)
    x = x.withColumn("neighbor_score", T.six(F.least(base + bonus * F.col("seed_score") * 0.1, base * 1.3)))
    semantic = (F.col("overlap") >= 2) | ((F.col("intent") == "comparison") & (F.col("overlap") >= 3))
    reason = (
        F.when(F.col("_low"), "low_quality_section").when(F.char_length("text") < 50, "text_too_short").when(F.col("_weak") & (F.col("overlap") < 3), "weak_section_insufficient_overlap")
        .when(F.col("neighbor_score") < s.audit_floor, "score_below_floor").when(~semantic, "no_semantic_signal").otherwise("semantic_and_score_passed")
    )
    x = x.withColumn("reason", reason)
    status = F.when(F.col("reason").isin("low_quality_section", "text_too_short"), "excluded").when(F.col("reason") == "semantic_and_score_passed", "dry_run_promoted").otherwise("context_only")
    return x.withColumn("status", status).select("qid", "chunk_id", "seed_id", "distance", "overlap", "neighbor_score", "status", "reason", "section")


def audit_rollup(rows: DataFrame) -> DataFrame:
    """Counts of an audit by status, section, reason and distance: dim, bucket, n, mean_score."""
    dims = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("bucket")) for d in ("status", "section", "reason", "distance")])).alias("d")
    return rows.select(dims, "neighbor_score").groupBy("d.dim", "d.bucket").agg(F.count(F.lit(1)).alias("n"), T.six(F.avg("neighbor_score")).alias("mean_score"))

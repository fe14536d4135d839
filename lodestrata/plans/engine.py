"""The engine's three entries: build an index, ask questions, evaluate a run. Each is one lazily built plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import Settings
from ..functions.session import settle, stored
from ..operators import corpus, evaluation, evidence, neighbors, rerank, retrieval
from ..operators.index import Index


@dataclass(frozen=True)
class Library:
    """chunks, their lexical index and their vectors (chunk_id, v) as stored tables."""

    chunks: DataFrame
    index: Index
    vectors: DataFrame

    @staticmethod
    def build(docs: DataFrame, size: int = 4) -> Library:
        """From documents (doc_id, source, text): chunks of blocks that pass the quality filter, with what search needs of them."""
        return Library.of(corpus.quality_filter(corpus.chunks(docs, size)))

    @staticmethod
    def of(rows: DataFrame) -> Library:
        """From chunks."""
        settle(rows.sparkSession)
        rows = stored(rows, "chunks")
        return Library(rows, Index.build(rows), stored(retrieval.letter_vectors(rows), "vectors"))

    @property
    def postings(self) -> DataFrame:
        """chunk_id, dl, term, tf."""
        return self.index.postings().withColumnRenamed("key", "chunk_id")

    @property
    def stats(self) -> DataFrame:
        """One row: n_rows, avgdl."""
        return self.chunks.sparkSession.createDataFrame([self.index.statistics()], "n_rows long, avgdl double")

    def save(self, path: str, version: str) -> None:
        """The tables under path, with a version that load compares."""
        for name, df in (("chunks", self.chunks), ("vectors", self.vectors), ("version", self.stats.select(F.lit(version).alias("version")))):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        self.index.compacted(f"{path}/index-{version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: str) -> Library | None:
        """The saved tables, ready for search, or None if they are of another version."""
        if settle(spark).read.parquet(f"{path}/version").where(F.col("version") == version).isEmpty():
            return None
        chunks, vectors = (spark.read.parquet(f"{path}/{n}") for n in ("chunks", "vectors"))
        return Library(chunks, Index.load(spark, f"{path}/index-{version}"), vectors)


def search(questions: DataFrame, library: Library, s: Settings = Settings(), filters: list[dict] | None = None) -> DataFrame:  # noqa: B008
    """Hybrid hits of each question from the library's index and vectors; of several filters the first that finds something counts.

    Statistics are those of all chunks whatever the filter. Chunk texts are read for the fused hits only.
    """
    def within(some: DataFrame, f: dict) -> DataFrame:
        only = retrieval.filtered(library.chunks, **f).select("chunk_id") if any(f.values()) else None
        return retrieval.hybrid(some, library.chunks, s, library.index, library.vectors, only)

    if not filters:
        return within(questions, {})
    return retrieval.first_answering(questions, [lambda some, f=f: within(some, f) for f in filters])


def ask(questions: DataFrame, library: Library, s: Settings = Settings(), model: Callable[[pd.Series, pd.Series], pd.Series] | None = None, rewrite: Callable[[pd.Series], pd.Series] | None = None, filters: list[dict] | None = None) -> dict[str, DataFrame]:  # noqa: B008
    """questions (qid, question) to answers: qid, mode, reason, answer, n_citations, with the tables on the way.

    Search, rerank (by a model's scores if there is one, else by features), guard, the final hits, ledger, support, plan,
    extractive answer, optional rewriting under validation, citations, final check, confidence and the neighbour audit.
    """
    settle(questions.sparkSession)
    routed = retrieval.routed(questions, s.lexicon, s)
    found = stored(search(questions, library, s, filters), "hits")  # at most search_limit rows for a question; all that follows reads them
    if model is None:
        scored = rerank.heuristic(found, s)
    else:
        pairs = found.select("qid", "chunk_id", "question", "text").withColumn("variant", F.lit(0))
        scores = rerank.model_scores(pairs, model).select("qid", "chunk_id", "variant", "score")
        scored = rerank.aggregated(found, scores, retrieval.marker_boost(F.col("question"), F.col("text"), s), s)
    guarded = rerank.rank1_guard(rerank.guarded(scored.drop("rank"), s), s)
    guarded = stored(guarded, "guarded")
    seeds = guarded.where(F.col("rank") <= s.final_top_k).drop("kind", "reason")
    pool = evidence.support(evidence.ledger(seeds), s)
    pairs = evidence.branch_support(evidence.branches(routed), pool)
    facts = evidence.factoid(pool.where("intent not in ('comparison', 'summary')"), s.max_factoid)
    several = evidence.comparison(pool.where("intent = 'comparison'"), pairs, s.max_comparison)
    picked = evidence.summary(evidence.summary_quality(pool.where("intent = 'summary'"))).select("qid", "evidence_id", "place")
    sums = pool.join(picked, ["qid", "evidence_id"])
    chosen = stored(facts.unionByName(several).unionByName(sums), "support")
    exists = evidence.existence(routed, chosen, s)
    coverage = evidence.branch_coverage(pairs)
    plans = evidence.plan(routed, chosen, coverage, exists)
    answers = evidence.rewritten(evidence.extractive_answers(plans, chosen), chosen, rewrite if s.rewrite else None, plans, coverage)
    answers = stored(answers, "answers")
    citations = evidence.bind_citations(answers, chosen)
    final = evidence.validated(plans, answers, citations, s).join(evidence.confidence(guarded, s), "qid", "left")
    out = {"hits": guarded, "support": chosen, "plans": plans, "citations": citations, "answers": final}
    if s.neighbor_audit:
        out["neighbours"] = neighbors.audit(seeds.select("qid", "chunk_id", "rank", "rerank_score"), neighbors.positions(library.chunks), routed, s)
    return out


def evaluate(runs: DataFrame, dims: list[str], thresholds: list[tuple[str, float]], baseline: DataFrame | None = None) -> dict[str, DataFrame]:
    """A run's indicators, summary, slices, failure categories and gates, and its difference to a baseline (metric, value)."""
    ev = evaluation.evaluated(runs)
    metrics = evaluation.long(evaluation.summary(ev), list(evaluation.RATES))
    out = {"rows": evaluation.failure_category(ev), "metrics": metrics, "slices": evaluation.slices(ev, dims), "gates": evaluation.gates(metrics, thresholds)}
    if baseline is not None:
        out["diff"] = evaluation.report_diff(metrics, baseline)
    return out

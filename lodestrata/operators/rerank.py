"""Reranking of hits: feature bonuses, model scores, the guarded score and its rank-1 guard, body coverage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Settings
from .ranking import ranked, top

SETTINGS = Settings()


def rerank_text() -> Column:
    return T.headed("title", "section", "source_file", "doc_id", "text", ": ")


def hybrid_score() -> Column:
    return F.greatest("vector_score", "fusion_score", F.col("bm25_score") * 0.1)


def strategy_bonus(s: Settings = SETTINGS) -> Column:
    """A bonus for each group of names that both question and chunk mention."""
    q = F.lower("question")
    hay = F.lower(F.concat_ws("\n", "title", "section", F.substring("text", 1, 800)))
    return reduce(lambda a, b: a + b, [F.when(T.has_any(q, g) & T.has_any(hay, g), s.strategy_bonus).otherwise(0.0) for g in s.lexicon.strategies], F.lit(0.0))


def route_bonus(s: Settings = SETTINGS) -> Column:
    """For questions about pathways: up to three wanted terms add, up to two unwanted ones take away."""
    hay = F.lower(F.concat_ws("\n", "title", "section", F.substring("text", 1, 1200)))
    good, bad = T.count_of(hay, s.lexicon.route_positive), T.count_of(hay, s.lexicon.route_negative)
    both = F.least(good, F.lit(3)) * (s.strategy_bonus * 0.4) - F.least(bad, F.lit(2)) * (s.strategy_bonus * 0.5)
    return F.when(T.has_any(F.lower("question"), s.lexicon.route_markers), both).otherwise(0.0)


def section_bonus(s: Settings = SETTINGS) -> Column:
    x, has = F.lower(F.btrim(F.coalesce("section", F.lit("")))), lambda w: F.contains(F.lower(F.col("section")), F.lit(w))
    r, d, a, i = s.section_bonus
    return F.when(has("result"), r).when(has("discussion"), d).when(x == "abstract", a).when(has("introduction"), i).otherwise(0.0)


def evidence_bonus(s: Settings = SETTINGS) -> Column:
    """For digits, words of results and words of definitions in the headed text, and for the section."""
    text = rerank_text()
    low = F.lower(text)
    n, r, d = s.evidence_bonus
    return F.when(text.rlike(r"\d"), n).otherwise(0.0) + F.when(T.has_any(low, s.lexicon.result), r).otherwise(0.0) + F.when(T.has_any(low, s.lexicon.definition), d).otherwise(0.0) + section_bonus(s)


def heuristic(hits: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """hits with rerank_score without a model: 0.7 of the best score, shared words, strategy and evidence bonuses."""
    shared = F.size(F.array_intersect(F.array_distinct(T.words(F.lower("question"))), F.array_distinct(T.words(F.lower(rerank_text())))))
    score = hybrid_score() * 0.7 + F.least(shared, F.lit(10)) * 0.03 + strategy_bonus(s) + evidence_bonus(s)
    return hits.withColumn("rerank_score", T.six(score))


def by_rerank(hits: DataFrame) -> DataFrame:
    return ranked(hits, ["qid"], [F.desc("rerank_score"), F.desc(hybrid_score()), F.col("chunk_id")])


def model_scores(pairs: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """pairs with ``score`` of (question, text) by a model; it runs on Arrow batches and may load itself once for each worker."""
    call = F.pandas_udf(score, "double")
    return pairs.withColumn("score", call("question", "text"))


def aggregated(hits: DataFrame, scores: DataFrame, marker: Column, s: Settings = SETTINGS) -> DataFrame:
    """hits with rerank_score from the scores (qid, chunk_id, variant, score) of all variants of a question: the best, a part of
    the mean, and the strategy, route, evidence and marker bonuses; query_scores keeps them by variant."""
    per = scores.groupBy("qid", "chunk_id").agg(F.max("score").alias("_max"), F.avg("score").alias("_avg"), F.sort_array(F.collect_list(F.struct("variant", "score"))).alias("_s"))
    total = F.coalesce("_max", "vector_score") + s.rerank_alpha * F.coalesce("_avg", "vector_score") + strategy_bonus(s) + route_bonus(s) + evidence_bonus(s) + marker
    out = hits.join(per, ["qid", "chunk_id"], "left").withColumn("rerank_score", T.six(total))
    return out.withColumn("query_scores", F.transform("_s", lambda x: T.six(x["score"]))).drop("_max", "_avg", "_s")


def above_floor(hits: DataFrame, ratio: float = SETTINGS.floor_ratio) -> DataFrame:
    """Hits of at least ``ratio`` of their question's best score, if that is above 0."""
    best = F.max("rerank_score").over(Window.partitionBy("qid"))
    return hits.withColumn("_best", best).where((F.col("_best") <= 0) | (F.col("rerank_score") >= F.col("_best") * ratio)).drop("_best")


def profile(question: Column | str, s: Settings = SETTINGS) -> Column:
    """kind (table, figure, body), anchors, doc_id and the numbers of tables and figures that a question names."""
    x = s.lexicon
    n = T.normal(question)
    kind = F.when(T.has_any(n, x.table), "table").when(T.has_any(n, x.figure), "figure").otherwise("body")
    refs = lambda word: F.regexp_extract_all(n, F.lit(T.edges(rf"\b(?:{word})\s*([a-z]?\d+)\b")), F.lit(1))
    tables, figures = refs("table"), refs(r"figure|fig\.?")
    found = F.regexp_extract_all(n, F.lit(r"[a-z0-9][a-z0-9'._-]+"), F.lit(0))
    bare = lambda t: F.regexp_replace(t, r"[\s/_-]+", "")
    kept = F.filter(found, lambda t: ~t.isin(*x.stop_words) & (F.char_length(bare(t)) > 1) & (t.rlike(r"[0-9]") | F.contains(t, F.lit("-")) | bare(t).isin(*x.anchor_words) | (F.char_length(bare(t)) >= 5)))
    named = lambda word, r: F.transform(r, lambda v: F.concat(F.lit(word + " "), v))
    doc = F.lower(F.replace(F.regexp_extract(T.col(question), T.edges(r"(?i)\b(doc[_-]?\d{4})\b"), 1), F.lit("-"), F.lit("_")))
    return F.struct(kind.alias("kind"), F.array_distinct(F.concat(named("table", tables), named("figure", figures), kept)).alias("anchors"), F.nullif(doc, F.lit("")).alias("doc_id"), tables.alias("tables"), figures.alias("figures"))


def guarded(hits: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """hits with the guarded score: normalised hybrid and rerank scores, the question's anchors, structure markers, references
    and document, less a penalty for incomplete evidence; and the completeness that the rank-1 guard compares."""
    w = Window.partitionBy("qid")
    x = hits.withColumns({"_p": profile("question", s), "_text": rerank_text(), "_h": hybrid_score()}).withColumns({"_n": T.normal("_text"), "_c": T.compact("_text"), "_low": F.lower("_text")})
    plain = F.replace(F.col("_n"), F.lit("'"), F.lit(""))
    hit = lambda a: F.contains(F.col("_n"), a) | F.contains(F.col("_c"), F.regexp_replace(a, r"[ /_-]+", "")) | F.contains(plain, F.replace(a, F.lit("'"), F.lit("")))
    has = lambda m: F.contains(F.col("_low"), F.lit(m))
    kind = F.col("_p.kind")
    x = x.withColumns({
        "keyword": F.when(F.size("_p.anchors") == 0, 0.0).otherwise(F.size(F.filter("_p.anchors", hit)) / F.size("_p.anchors")),
        "marker": F.when(kind == "table", F.least(F.lit(1.0), F.when(has("[table text]"), 0.7).otherwise(0.0) + F.when(has("[table caption]"), 0.4).otherwise(0.0))).when((kind == "figure") & has("[figure caption]"), 1.0).otherwise(0.0),
        "reference": F.when((kind == "table") & F.exists("_p.tables", lambda r: F.contains(F.col("_low"), F.concat(F.lit("table "), r))), 1.0).when((kind == "figure") & F.exists("_p.figures", lambda r: F.contains(F.col("_low"), F.concat(F.lit("figure "), r))), 1.0).otherwise(0.0),
        "doc_match": F.coalesce(F.when(F.lower(F.col("doc_id").cast("string")) == F.col("_p.doc_id"), 1.0), F.lit(0.0)),
    })
    scaled = lambda c: F.when(F.max(c).over(w) <= F.min(c).over(w), 1.0).otherwise((F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w)))
    x = x.withColumns({"hybrid_norm": scaled("_h"), "rerank_norm": scaled("rerank_score")})
    penalty = F.when(kind == "body", 0.0).otherwise(F.when(F.col("keyword") < 0.35, 1.0).otherwise(0.0) + F.when((F.col("marker") <= 0) & (F.col("reference") <= 0), 0.35).otherwise(0.0))
    hw, rw, kw, mw, dw, pw = s.guarded_weights
    body = 0.40 * F.col("hybrid_norm") + 0.40 * F.col("rerank_norm") + 0.15 * F.col("keyword") + 0.05 * F.col("doc_match")
    rich = hw * F.col("hybrid_norm") + rw * F.col("rerank_norm") + kw * F.col("keyword") + mw * F.least(F.lit(1.0), F.col("marker") + 0.3 * F.col("reference")) + dw * F.col("doc_match") - pw * penalty
    k, m, r, d = (F.col(c) for c in ("keyword", "marker", "reference", "doc_match"))
    complete = (
        F.when(kind == "figure", F.least(F.lit(1.0), 0.20 * k + 0.35 * m + 0.30 * r + 0.05 * d + F.when(has("[figure caption]"), 0.1).otherwise(0.0)))
        .when(kind == "table", F.least(F.lit(1.0), 0.40 * k + 0.20 * m + 0.20 * r + 0.08 * d + F.when(has("[table caption]"), 0.12).otherwise(0.0) + F.when(has("[table text]"), 0.04).otherwise(0.0)))
        .otherwise(0.50 * k + 0.35 * r + 0.15 * d)
    )
    whole = (
        F.when(kind == "figure", has("[figure caption]") & (r >= 1) & (k >= 0.45))
        .when(kind == "table", has("[table text]") & (k >= 0.55) & (has("[table caption]") | (k >= 0.78)) & ((r >= 1) | ((F.size("_p.tables") == 0) & has("[table caption]"))))
        .otherwise(True)
    )
    x = x.withColumns({"guarded_score": T.six(F.when(kind == "body", body).otherwise(rich)), "completeness": T.six(complete), "is_complete": whole, "kind": kind, "has_caption": F.when(kind == "figure", has("[figure caption]")).otherwise(has("[table caption]")), "wants_doc": F.col("_p.doc_id").isNotNull()})
    x = x.drop("_p", "_text", "_h", "_n", "_c", "_low")
    return ranked(x, ["qid"], [F.desc("guarded_score"), F.desc("keyword"), F.desc("marker"), F.col("chunk_id")])


def rank1_guard(hits: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """guarded hits, ranked anew with ``promoted`` and ``reason``: for table and figure questions whose first hit isn't complete
    evidence, the most complete candidate goes to the front if it gains enough and isn't too far behind (or has what the first lacks)."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(c).over(w)
    x = hits.withColumns({f"_{c}": first(c) for c in ("completeness", "guarded_score", "is_complete", "has_caption", "reference")})
    near = F.col("guarded_score") + F.when(F.col("kind") == "figure", max(s.guard_gap, 0.65)).otherwise(s.guard_gap) >= F.col("_guarded_score")
    excused = (F.col("kind") == "table") & ((F.col("has_caption") & ~F.col("_has_caption")) | ((F.col("reference") > F.col("_reference")) & (F.col("completeness") >= 0.95)))
    able = (
        (F.col("rank") > 1) & F.col("kind").isin("table", "figure") & ~F.col("_is_complete") & F.col("is_complete") & (F.col("completeness") - F.col("_completeness") >= s.guard_gain)
        & (~F.col("wants_doc") | (F.col("doc_match") >= 1)) & ((F.col("kind") == "table") | F.col("has_caption")) & (near | excused)
    )
    x = x.withColumn("_able", able).withColumn("_best", F.max(F.when(F.col("_able"), F.struct("completeness", (-F.col("rank")).alias("r")))).over(Window.partitionBy("qid")))
    x = x.withColumn("promoted", F.coalesce(-F.col("rank") == F.col("_best.r"), F.lit(False)))
    reason = (
        F.when(~F.col("kind").isin("table", "figure"), "intent_not_guarded").when(F.col("promoted"), "promoted_complete_evidence").when(F.col("rank") > 1, "not_promoted")
        .when(F.col("is_complete"), "top1_already_complete").when(F.col("_best").isNotNull(), "demoted_incomplete_evidence").otherwise("no_better_complete_evidence")
    )
    x = x.withColumn("reason", reason).withColumnRenamed("rank", "rank_before")
    return ranked(x, ["qid"], [F.desc("promoted"), F.col("rank_before")]).drop(*[c for c in x.columns if c.startswith("_")])


def comparison_coverage(hits: DataFrame, top_k: int, least: float = 1.0) -> DataFrame:
    """Comparisons with two or more variants: the best chunk of a document not yet chosen for each variant in turn, if it scores
    ``least``, then the best of each other document; other questions: the first top_k.

    hits: qid, chunk_id, doc_id, rank, intent, query_scores (by variant). The choice depends on the ones before it, so a
    question's hits (a few dozen) are one group of a pandas function.
    """

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        n = max((len(x) if x is not None else 0 for x in g["query_scores"]), default=0)
        if g["intent"].iloc[0] != "comparison" or n < 2:
            chosen = list(g.index[:top_k])
        else:
            chosen, docs = [], set()
            for v in range(1, n):
                able = [(float(x[v]), -r, i) for i, x, r, d in zip(g.index, g["query_scores"], g["rank"], g["doc_id"], strict=True) if x is not None and len(x) > v and d not in docs]
                if able and max(able)[0] >= least:
                    i = max(able)[2]
                    chosen.append(i)
                    docs.add(g.loc[i, "doc_id"])
            for i, d in zip(g.index, g["doc_id"], strict=True):
                if d not in docs:
                    chosen.append(i)
                    docs.add(d)
            chosen = chosen[:top_k]
        out = g.loc[chosen, ["qid", "chunk_id", "doc_id"]].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    t = dict(hits.dtypes)
    return hits.select("qid", "chunk_id", "doc_id", "rank", "intent", "query_scores").groupBy("qid").applyInPandas(choose, f"qid {t['qid']}, chunk_id string, doc_id {t['doc_id']}, place long")


def body_coverage(hits: DataFrame, top_k: int, margin: int = 5, s: Settings = SETTINGS) -> DataFrame:
    """hits' first top_k by rank, with at most one swap for each question: the first document shown only by title or abstract
    gives its title, else its abstract, for its best body chunk among the next ``margin`` hits: qid, chunk_id, doc_id, place, swapped_in.

    Results, discussion and conclusion come before introduction and methods. The set keeps its size.
    """
    g = T.section_group("section")
    strong, weak = g.isin("RESULT", "DISCUSSION", "CONCLUSION", "BODY_ANY"), g.isin("INTRO", "METHOD")
    x = hits.where(F.col("rank") <= top_k + margin).withColumns({"_shown": F.col("rank") <= top_k, "_body": strong | weak, "_strong": strong, "_front": F.when(g == "TITLE", 0).when(g == "ABSTRACT", 1)})
    w = Window.partitionBy("qid", "doc_id")
    x = x.withColumns({
        "_has_body": F.max(F.col("_shown") & F.col("_body")).over(w),
        "_victim": F.min(F.when(F.col("_shown") & F.col("_front").isNotNull(), F.struct("_front", "rank"))).over(w)["rank"],
        "_new": F.min(F.when(~F.col("_shown") & F.col("_body"), F.struct((~F.col("_strong")).alias("w"), F.col("rank").alias("rank")))).over(w)["rank"],
    })
    able = ~F.col("_has_body") & F.col("_victim").isNotNull() & F.col("_new").isNotNull()
    first = F.min(F.when(able, F.struct(F.col("_victim").alias("v"), F.col("_new").alias("n")))).over(Window.partitionBy("qid"))
    x = x.withColumn("_swap", first)
    place = F.when(F.col("rank") == F.col("_swap.n"), F.col("_swap.v")).when(F.coalesce(F.col("rank") == F.col("_swap.v"), F.lit(False)), None).when(F.col("_shown"), F.col("rank"))
    x = x.withColumns({"place": place, "swapped_in": F.coalesce(F.col("rank") == F.col("_swap.n"), F.lit(False))}).where(F.col("place").isNotNull())
    return x.select("qid", "chunk_id", "doc_id", "place", "swapped_in")


def final(hits: DataFrame, k: int = SETTINGS.final_top_k) -> DataFrame:
    return top(hits, ["qid"], [F.col("rank")], k, "final_rank")

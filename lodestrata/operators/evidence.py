"""From ranked chunks to a cited answer or a refusal."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Settings
from .ranking import ranked, top

SETTINGS = Settings()
RESULT = T.edges(r"(?i)\b(result|results|showed|demonstrated|increased|decreased|yield|titer|production)\b|结果|显示|提高|降低|产量|滴度")
REFUSAL = "The library's evidence is not enough to answer this question."


def about_tables(question: Column | str) -> Column:
    return F.lower(T.col(question)).rlike(T.edges(r"\btable\b|\btab\.|表"))


def about_figures(question: Column | str) -> Column:
    return F.lower(T.col(question)).rlike(T.edges(r"\bfig(ure|\.)|图"))


def ledger(seeds: DataFrame, result: str = RESULT) -> DataFrame:
    """seeds (by qid and rank) as evidence: evidence_id E1.. and the features of their text."""
    low = F.lower(F.coalesce("text", F.lit("")))
    has = lambda *w: T.has_any(low, w)
    return seeds.withColumns({
        "evidence_id": F.concat(F.lit("E"), F.col("rank").cast("string")), "section_type": F.lower(F.btrim(F.coalesce("section", F.lit("")))), "text_length": F.char_length(low).cast("long"),
        "has_table_text": has("[table text]", "table_text"), "has_table_caption": has("[table caption]", "table_caption"), "has_figure_caption": has("[figure caption]", "fig.", "figure_caption"),
        "has_numeric": low.rlike(r"\d"), "has_result_terms": low.rlike(result),
    })


def support(evidence: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """evidence with query_overlap and support_score, of min_support or more."""
    q, t = T.long_words("question"), T.long_words("text")
    kind = F.col("section_type")
    has = lambda w: F.contains(kind, F.lit(w))
    section = F.when(has("result"), 0.25).when(has("discussion"), 0.18).when(has("abstract"), 0.08).when(has("reference") | has("bibliograph"), -0.30).otherwise(0.0)
    base = T.unit_score(F.greatest("rerank_score", "vector_score", "fusion_score"))
    x = evidence.withColumn("query_overlap", T.six(F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))))
    plus = lambda c, v: F.when(F.col(c), v).otherwise(0.0)
    score = (
        base + section + plus("has_numeric", 0.08) + plus("has_result_terms", 0.10) + plus("has_table_text", 0.18) + plus("has_table_caption", 0.14) + plus("has_figure_caption", 0.14) + F.least(F.col("query_overlap") * 0.3, F.lit(0.3))
        + F.when(about_tables("question") & (F.col("has_table_text") | F.col("has_table_caption")), 0.30).otherwise(0.0) + F.when(about_figures("question") & F.col("has_figure_caption"), 0.30).otherwise(0.0)
    )
    return x.withColumn("support_score", T.six(score)).where(F.col("support_score") >= s.min_support)


def factoid(scored: DataFrame, k: int = SETTINGS.max_factoid) -> DataFrame:
    """The k best; evidence of the kind that a question asks for (tables, figures) first."""
    wanted = F.when(about_tables("question"), F.col("has_table_text") | F.col("has_table_caption")).when(about_figures("question"), F.col("has_figure_caption")).otherwise(F.lit(True))
    return top(scored, ["qid"], [F.desc(wanted), F.desc("support_score"), F.col("rank")], k, "place")


def summary_quality(scored: DataFrame) -> DataFrame:
    """scored with summary_rank and quality: why it may not serve a summary, or pass."""
    x = ranked(scored, ["qid"], [T.section_priority("section"), F.desc("has_result_terms"), F.desc("has_numeric"), F.desc("support_score"), F.col("rank")], "summary_rank")
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    has = lambda *w: T.has_any("section_type", w)
    rich = F.col("has_table_text") | F.col("has_table_caption") | F.col("has_figure_caption")
    fine = (F.col("query_overlap") > 0) | (T.section_priority("section") <= 4) | F.col("has_result_terms") | F.col("has_numeric") | rich | (F.col("summary_rank") <= F.greatest(F.lit(2), F.least(F.lit(4), n)))
    why = (
        F.when(has("reference", "bibliograph"), "references_section").when(has("acknowledg", "author", "title", "content"), "low_value_section")
        .when(has("list") & has("figure", "table"), "figure_table_list").when(F.col("text_length") < 12, "too_short").when(fine, "pass").otherwise("low_quality")
    )
    return x.withColumn("quality", why)


def summary(graded: DataFrame, most: int = min(SETTINGS.max_summary, 3), per_doc: int = 2) -> DataFrame:
    """Two or three items for a summary in summary_rank order: no near copy (same document and section group, 80 % of the smaller
    word set shared), another document second if there is one: qid, evidence_id, chunk_id, doc_id, place.

    Each choice depends on those before, so a question's evidence (at most a few dozen rows) is one group of a pandas function.
    """
    x = graded.where("quality = 'pass'").select("qid", "evidence_id", "chunk_id", "doc_id", "summary_rank", T.section_bucket("section").alias("bucket"), T.long_words("text").alias("words"))
    t = dict(x.dtypes)
    return x.groupBy("qid").applyInPandas(lambda g: diverse(g, most, per_doc), f"qid {t['qid']}, evidence_id string, chunk_id string, doc_id {t['doc_id']}, place long")


def diverse(g: pd.DataFrame, most: int, per_doc: int) -> pd.DataFrame:
    rows = list(g.sort_values("summary_rank").itertuples(index=False))
    chosen: list = []

    def fresh(r) -> bool:
        for c in chosen:
            a, b = set(r.words), set(c.words)
            if r.chunk_id == c.chunk_id or (r.doc_id == c.doc_id and r.bucket == c.bucket and a and b and len(a & b) / min(len(a), len(b)) >= 0.8):
                return False
        return True

    for later in (False, True):
        for r in rows:
            docs = [c.doc_id for c in chosen]
            waits = not later and len(chosen) == 1 and r.doc_id in docs and any(o.doc_id not in docs for o in rows)
            if len(chosen) < most and r.evidence_id not in [c.evidence_id for c in chosen] and docs.count(r.doc_id) < per_doc and not waits and fresh(r):
                chosen.append(r)
    return pd.DataFrame([(r.qid, r.evidence_id, r.chunk_id, r.doc_id, i) for i, r in enumerate(chosen, 1)], columns=["qid", "evidence_id", "chunk_id", "doc_id", "place"])


def branches(questions: DataFrame) -> DataFrame:
    """qid, branch_no, branch, terms: what each comparison compares, with the words that stand for it."""
    from .retrieval import compared_objects

    each = questions.where("intent = 'comparison'").select("qid", F.posexplode(compared_objects("question")).alias("branch_no", "branch"))
    return each.withColumns({"branch_no": F.col("branch_no").cast("long"), "terms": T.terms("branch")})


def branch_support(branch_rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Each branch against each item of its question's evidence: matched, specific, confidence, status (direct, indirect, missing).

    Confidence: 0.18 of the score (to 1.5), 0.18 for a term with a digit or capital sign (to 0.36), 0.16 for a long term (to 0.48),
    a bonus for the section and one for the title.
    """
    x = branch_rows.join(scored.select("qid", "evidence_id", "chunk_id", "title", "section", "text", "support_score"), "qid")
    hay = F.lower(F.concat_ws("\n", "title", "section", "text"))
    x = x.withColumns({"_hay": hay, "matched": F.filter("terms", lambda t: F.contains(hay, t))})
    entity, specific = F.size(F.filter("matched", lambda t: t.rlike("[0-9]"))), F.size(F.filter("matched", lambda t: F.char_length(t) >= 5))
    b = T.section_bucket("section")
    section = F.when(b.isin("results", "results_and_discussion"), 0.10).when(b == "discussion", 0.06).when(b == "abstract", 0.04).otherwise(0.0)
    in_title = F.exists("matched", lambda t: F.contains(F.lower(F.coalesce("title", F.lit(""))), t))
    score = F.least(F.greatest(F.col("support_score"), F.lit(0.0)), F.lit(1.5)) * 0.18 + F.least(entity * 0.18, F.lit(0.36)) + F.least(specific * 0.16, F.lit(0.48)) + section + F.when(in_title, 0.08).otherwise(0.0)
    status = F.when((specific >= 2) | ((entity >= 1) & (specific >= 1)), "direct").when((specific >= 1) | (entity >= 1), "indirect").otherwise("missing")
    x = x.withColumns({"confidence": F.round(F.least(score, F.lit(1.0)), 4), "status": status, "n_matched": F.size("matched").cast("long")})
    return x.select("qid", "branch_no", "branch", "evidence_id", "chunk_id", "n_matched", "confidence", "status", "support_score")


def branch_coverage(pairs: DataFrame) -> DataFrame:
    """Each branch's best item: qid, branch_no, branch, evidence_id, confidence, status; direct evidence that another branch also
    has as its best becomes indirect (shared)."""
    level = F.when(F.col("status") == "direct", 2).when(F.col("status") == "indirect", 1).otherwise(0)
    best = top(pairs, ["qid", "branch_no"], [F.desc(level), F.desc("confidence"), F.desc("support_score"), F.col("evidence_id")], 1, "_n").drop("_n")
    uses = F.count(F.lit(1)).over(Window.partitionBy("qid", "evidence_id", F.col("status") == "direct"))
    best = best.withColumn("shared", (F.col("status") == "direct") & (uses > 1))
    return best.withColumn("status", F.when(F.col("shared"), "indirect").otherwise(F.col("status"))).select("qid", "branch_no", "branch", "evidence_id", "confidence", "status", "shared")


def comparison(scored: DataFrame, pairs: DataFrame, k: int = SETTINGS.max_comparison) -> DataFrame:
    """The best item of each branch, then the best of the others, a document's second after all first ones: up to k."""
    level = F.when(F.col("status") == "direct", 2).when(F.col("status") == "indirect", 1).otherwise(0)
    best = top(pairs.where("status != 'missing'"), ["qid", "branch_no"], [F.desc(level), F.desc("confidence"), F.desc("support_score"), F.col("evidence_id")], 1, "_n")
    lead = best.groupBy("qid", "evidence_id").agg(F.min("branch_no").alias("_lead"))
    x = scored.join(lead, ["qid", "evidence_id"], "left")
    x = ranked(x, ["qid", "doc_id"], [F.col("_lead").isNull(), F.desc("support_score"), F.col("rank")], "_nth")
    return top(x, ["qid"], [F.asc_nulls_last("_lead"), F.col("_nth"), F.desc("support_score"), F.col("rank")], k, "place").drop("_lead", "_nth")


def existence(questions: DataFrame, chosen: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Whether each question asks if something is in the library, and how its whole support speaks for that.

    Core terms are the phrases of the lexicon that the question has and its words in capitals; entities are those that are no
    phrase and not generic, the others qualifiers. Strong: three fifths of the terms are in the support, a qualifier among them,
    and an entity if there is any. None without support, else weak.
    """
    low = F.lower(F.regexp_replace(F.coalesce("question", F.lit("")), T.WHITE, " "))
    phrases = F.filter(F.array(*map(F.lit, s.lexicon.core_phrases)), lambda p: F.contains(low, F.lower(p)))
    marks = F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(T.edges(r"\b(?:[A-Z][A-Z0-9-]+|mRNA)\b")), F.lit(0))
    loose = F.array(*[F.lit(p) for p in s.lexicon.core_phrases if " " in p or not p.isascii()])
    text = chosen.groupBy("qid").agg(F.count(F.lit(1)).alias("n_support"), F.lower(F.concat_ws(" ", F.collect_list(F.concat_ws(" ", *[c for c in ("title", "section", "text") if c in chosen.columns])))).alias("_x"))
    x = questions.select("qid", T.has_any(F.lower("question"), s.lexicon.existence).alias("asks_existence"), F.array_distinct(F.concat(phrases, marks)).alias("_t")).join(text, "qid", "left")
    is_entity = lambda t: ~t.isin(*s.lexicon.generic_terms) & (t.rlike("^[A-Z0-9-]{2,}$") | ~F.array_contains(loose, t))
    within = lambda t: F.when(t.rlike("^[A-Za-z0-9-]{2,}$"), F.rlike(F.col("_x"), F.concat(F.lit(T.EDGE), F.lower(t), F.lit(T.EDGE)))).otherwise(F.contains(F.col("_x"), F.lower(t)))
    x = x.withColumns({"n_support": F.coalesce("n_support", F.lit(0)), "_x": F.coalesce("_x", F.lit(""))}).withColumn("_m", F.filter("_t", within))
    x = x.withColumns({"_e": F.size(F.filter("_t", is_entity)), "_me": F.size(F.filter("_m", is_entity)), "term_part": T.six(F.when(F.size("_t") > 0, F.size("_m") / F.size("_t")).otherwise(0.0))})
    strong = (F.size("_t") > 0) & (F.size("_m") * 5 >= F.size("_t") * 3) & ((F.col("_e") == 0) | (F.col("_me") > 0)) & (F.size("_m") > F.col("_me"))
    status = F.when(F.col("n_support") == 0, "none").when(strong, "strong").otherwise("weak")
    return x.select("qid", "asks_existence", "term_part", "n_support", status.alias("support_status"))


def plan(questions: DataFrame, chosen: DataFrame, coverage: DataFrame, exists: DataFrame) -> DataFrame:
    """mode (full, partial, refuse) and reason of each question's answer from its chosen support, its branches and the existence check."""
    b = T.section_bucket("section")
    per = chosen.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"), F.min((b == "abstract").cast("int")).alias("_abs"), F.max((F.col("has_table_text") | F.col("has_table_caption")).cast("int")).alias("_table"), F.max(F.col("has_figure_caption").cast("int")).alias("_figure"))
    cov = coverage.groupBy("qid").agg(F.count(F.lit(1)).alias("branches"), F.sum((F.col("status") == "direct").cast("int")).alias("_direct"), F.sum((F.col("status") == "indirect").cast("int")).alias("_indirect"), F.max(F.col("shared").cast("int")).alias("_shared"))
    x = questions.join(per, "qid", "left").join(cov, "qid", "left").join(exists.select("qid", "asks_existence", "support_status"), "qid", "left")
    x = x.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "docs", "branches", "_direct", "_indirect", "_shared", "_abs", "_table", "_figure")})
    structured = about_tables("question") | about_figures("question")
    found = (about_tables("question") & (F.col("_table") == 1)) | (about_figures("question") & (F.col("_figure") == 1))
    missing = F.col("_direct") + F.col("_indirect") < F.col("branches")
    i = F.col("intent")
    none = F.when(F.col("asks_existence"), "existence_no_support").when(i == "summary", "summary_no_support").otherwise("no_support_pack")
    reason = (
        F.when(F.col("n") == 0, none).when(F.col("asks_existence") & (F.col("support_status") == "weak"), "existence_weak_support").when(structured & found, "structured_evidence_found").when(structured, "missing_explicit_structured_evidence")
        .when(i.isin("factoid", "unknown"), "factoid_supported").when((i == "summary") & (F.col("n") == 1), "summary_support_count").when((i == "summary") & (F.col("_abs") == 1), "summary_abstract_only")
        .when((i == "summary") & (F.col("docs") == 1), "summary_single_doc_limited").when(i == "summary", "summary_multi_support").when(i == "experiment", "experiment_queries_only_allow_summary")
        .when(F.col("branches") == 0, "comparison_evidence_incomplete").when(F.col("_shared") == 1, "shared_evidence_limited_comparison").when(F.col("_direct") == F.col("branches"), "direct_all_branches_independent")
        .when((F.col("_direct") > 0) & (F.col("_indirect") > 0), "branch_partial_support").when(F.col("_direct") > 0, "comparison_branch_coverage").otherwise("comparison_indirect_support")
    )
    x = x.withColumn("reason", reason)
    full = F.col("reason").isin("factoid_supported", "summary_multi_support") | ((F.col("reason") == "structured_evidence_found") & ~missing)
    mode = F.when(F.col("n") == 0, "refuse").when(full, "full").otherwise("partial")
    return x.withColumns({"mode": mode, "missing_branches": F.greatest(F.col("branches") - F.col("_direct") - F.col("_indirect"), F.lit(0)).cast("long")}).select("qid", "intent", "mode", "reason", F.col("n").alias("n_support"), "missing_branches")


def extractive_answers(plans: DataFrame, chosen: DataFrame, items: int = 3, chars: int = 160) -> DataFrame:
    """qid, mode, answer: a line for each of the first items of support with its mark, or the refusal."""
    lines = chosen.where(F.col("place") <= items).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", F.concat(T.squeezed("text", chars), F.lit(" ["), F.col("evidence_id"), F.lit("]")).alias("l")))).alias("l"))
    x = plans.join(lines, "qid", "left")
    head = F.when(F.col("mode") == "partial", "Limited evidence: ").otherwise("")
    return x.select("qid", "mode", F.when((F.col("mode") == "refuse") | F.col("l").isNull(), REFUSAL).otherwise(F.concat(head, F.array_join(F.transform("l", lambda v: v["l"]), " "))).alias("answer"))


def bind_citations(answers: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row for each citation in order of first mention: qid, citation_no, evidence_id, chunk_id, doc_id, quote; marks of
    evidence that the support doesn't hold vanish."""
    marks = answers.select("qid", F.posexplode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(E\d+)\]"), F.lit(1)))).alias("_p", "evidence_id"))
    x = marks.join(chosen.select("qid", "evidence_id", "chunk_id", "doc_id", T.squeezed("text", 1200).alias("quote")), ["qid", "evidence_id"])
    return ranked(x, ["qid"], [F.col("_p")], "citation_no").drop("_p")


def validated(plans: DataFrame, answers: DataFrame, citations: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """The final mode, reason and answer: full with a missing branch is partial, and without a citation an answer is a refusal."""
    n = citations.groupBy("qid").agg(F.count(F.lit(1)).alias("n_citations"))
    x = plans.join(answers.select("qid", "answer"), "qid").join(n, "qid", "left").withColumn("n_citations", F.coalesce("n_citations", F.lit(0)).cast("long"))
    bare = F.lit(s.require_citation) & (F.col("mode") != "refuse") & (F.col("n_citations") == 0)
    mode = F.when(bare, "refuse").when((F.col("mode") == "full") & (F.col("missing_branches") > 0), "partial").otherwise(F.col("mode"))
    return x.select("qid", mode.alias("mode"), F.when(bare, "post_generation_zero_citation_refuse").otherwise(F.col("reason")).alias("reason"), F.when(bare, REFUSAL).otherwise(F.col("answer")).alias("answer"), "n_citations")


def answer_flags(answers: DataFrame, chosen: DataFrame, plans: DataFrame | None = None, coverage: DataFrame | None = None, before: DataFrame | None = None, most_chars: int = 1200, s: Settings = SETTINGS) -> DataFrame:
    """What speaks against a rewritten answer: qid, flags.

    answers: qid, mode, answer. Its marks must be of the support (chosen) and, if ``before`` (qid, answer: the extractive one) is
    given, the same set; a comparison whose branches (coverage) have evidence may use what any branch has, and must use each
    direct one's. With ``plans`` (reason, missing_branches) limits must be named where they hold. Overclaims count unless a
    negation stands within eight characters before them. Numbers must be in the support.
    """
    none = F.array().cast("array<string>")
    marks_of = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[(E\d+)\]"), F.lit(1)))
    x = answers.select("qid", "mode", F.coalesce("answer", F.lit("")).alias("answer")).join(chosen.groupBy("qid").agg(F.collect_set("evidence_id").alias("_ids"), F.concat_ws("\n", F.collect_list("text")).alias("_all")), "qid", "left")
    x = x.join(before.select("qid", marks_of("answer").alias("_before")), "qid", "left") if before is not None else x.withColumn("_before", F.lit(None).cast("array<string>"))
    x = x.join(plans.select("qid", "reason", "missing_branches"), "qid", "left") if plans is not None else x.withColumns({"reason": F.lit(""), "missing_branches": F.lit(0)})
    if coverage is not None:
        has = F.col("status") != "missing"
        x = x.join(coverage.groupBy("qid").agg(F.collect_set(F.when(has, F.col("evidence_id"))).alias("_allowed"), F.collect_set(F.when(F.col("status") == "direct", F.col("evidence_id"))).alias("_direct"), F.max((F.col("status") == "indirect").cast("int")).alias("_indirect")), "qid", "left")
    else:
        x = x.withColumns({"_allowed": none, "_direct": none, "_indirect": F.lit(0)})
    x = x.withColumns({c: F.coalesce(c, none) for c in ("_ids", "_allowed", "_direct")}).withColumns({"_marks": marks_of("answer"), "_subset": (F.size("_allowed") > 0) & F.col("mode").isin("full", "partial")})
    body = F.regexp_replace("answer", r"\[E\d+\]", "")
    loose = F.filter(T.numbers_and_units(body), lambda n: ~F.contains(F.lower(F.replace(F.coalesce("_all", F.lit("")), F.lit(" "), F.lit(""))), n))
    lex, partial, weak = s.lexicon, F.col("mode") == "partial", F.coalesce(F.col("reason") == "existence_weak_support", F.lit(False))
    over = partial & T.claims_any("answer", lex.overclaims, lex.negations)
    cites, was = F.size("_marks") > 0, F.coalesce(F.size("_before"), F.lit(0)) > 0
    flag = lambda when, name: F.when(when, name)
    flags = F.array_compact(F.array(
        flag(F.size(F.array_except("_marks", "_ids")) > 0, "invalid_citation_ids"), flag(F.col("_subset") & (F.size(F.array_except("_marks", "_allowed")) > 0), "comparison_disallowed_citation"),
        flag(F.char_length("answer") > most_chars, "output_too_long"), flag((F.col("mode") != "refuse") & ~cites, "missing_citations"), flag(was & ~cites, "dropped_all_citations"),
        flag(~F.col("_subset") & was & (F.array_sort("_marks") != F.array_sort("_before")), "citation_set_changed"), flag(F.col("_subset") & (F.size(F.array_except("_direct", "_marks")) > 0), "missing_direct_branch_citation"),
        flag(over, "partial_overclaim"), flag(partial & (over | ~T.has_any("answer", lex.partial_limits)), "partial_abstention_tone"), flag(weak & T.has_any("answer", lex.existence_overclaims), "existence_overclaim"),
        flag((F.coalesce("missing_branches", F.lit(0)) > 0) & ~T.has_any("answer", lex.branch_limits), "missing_branch_limit_not_disclosed"),
        flag((F.coalesce("_indirect", F.lit(0)) > 0) & ~T.has_any("answer", lex.indirect_limits), "indirect_branch_limit_not_disclosed"),
        flag(weak & ~T.has_any("answer", lex.existence_disclaimers), "missing_existence_weak_disclaimer"),
        flag(F.size(loose) > 0, "unsupported_number"), flag((F.col("mode") == "refuse") & cites, "refusal_with_citation"),
    ))
    return x.select("qid", flags.alias("flags"))


def rewritten(answers: DataFrame, chosen: DataFrame, rewrite: Callable[[pd.Series], pd.Series] | None = None, plans: DataFrame | None = None, coverage: DataFrame | None = None) -> DataFrame:
    """The answers as a model rewrites them, where that passes the flags; else as they are. Without a model nothing changes."""
    if rewrite is None:
        return answers.withColumn("rewritten", F.lit(False))
    tried = answers.withColumn("_new", F.pandas_udf(rewrite, "string")("answer"))
    flags = answer_flags(tried.select("qid", "mode", F.col("_new").alias("answer")), chosen, plans, coverage, answers)
    x = tried.join(flags, "qid").withColumn("rewritten", F.size("flags") == 0)
    return x.select("qid", "mode", F.when(F.col("rewritten"), F.col("_new")).otherwise(F.col("answer")).alias("answer"), "rewritten")


def citation_budget(chosen: DataFrame, by_intent: dict[str, int] | None = None) -> DataFrame:
    """The support that an intent may cite: 4 for facts, 8 for summaries, 10 for comparisons, else 6."""
    limit = F.lit(6)
    for k, v in (by_intent or {"factoid": 4, "summary": 8, "comparison": 10}).items():
        limit = F.when(F.col("intent") == k, v).otherwise(limit)
    return top(chosen, ["qid"], [F.col("place")], limit, "citation_rank")


def evidence_sentences(hits: DataFrame, k: int = 5, least: float = 0.05) -> DataFrame:
    """The k best sentences of a question's hits: 0.40 shared words, 0.35 shared numbers, 0.25 the chunk's score; a sentence once."""
    x = hits.select("qid", "question", "chunk_id", "rerank_score", F.posexplode(T.sentences("text")).alias("_n", "sentence"))
    q = T.long_words("question")
    words = F.size(F.array_intersect(q, T.long_words("sentence"))) / F.greatest(F.size(q), F.lit(1))
    nums = T.numbers_and_units("question")
    shared = F.when(F.size(nums) > 0, F.size(F.array_intersect(nums, T.numbers_and_units("sentence"))) / F.greatest(F.size(nums), F.lit(1))).otherwise(0.0)
    x = x.withColumn("score", T.six(0.40 * words + 0.35 * shared + 0.25 * T.fifth_score(F.col("rerank_score")))).where(F.col("score") >= least)
    x = top(x, ["qid", "sentence"], [F.desc("score"), F.col("chunk_id"), F.col("_n")], 1, "_first")
    return top(x, ["qid"], [F.desc("score"), F.col("chunk_id"), F.col("_n")], k, "place").select("qid", "chunk_id", "sentence", "score", "place")


def confidence(hits: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """qid, confidence (mean of the three best hits' scores and a bonus for documents), needs_external."""
    x = hits.where(F.col("rank") <= 3).withColumn("_s", T.unit_score(F.greatest("rerank_score", "vector_score", "fusion_score")))
    per = x.groupBy("qid").agg(T.six(F.least(F.avg("_s") + F.least(F.count_distinct("doc_id") * 0.05, F.lit(0.15)), F.lit(0.99))).alias("confidence"))
    return per.withColumn("needs_external", F.col("confidence") < s.answer_threshold)


def signals(hits: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """What a question's first five hits say together: mean score, shared words, features, their grade (strong, partial, none)."""
    x = hits.where(F.col("rank") <= 5)
    low = F.lower(F.coalesce("text", F.lit("")))
    q = F.filter(F.array_distinct(T.tokens("question")), lambda t: F.char_length(t) > 1)
    words = F.size(F.array_intersect(q, F.array_distinct(T.tokens(F.concat_ws(" ", "title", "section", F.substring("text", 1, 800)))))) / F.greatest(F.size(q), F.lit(1))
    feature = (low.rlike(r"\d").cast("int") + T.has_any(low, s.lexicon.result).cast("int") + T.has_any(low, s.lexicon.definition).cast("int")) / 3
    per = x.groupBy("qid").agg(T.six(F.avg(T.fifth_score(F.col("rerank_score")))).alias("mean_score"), T.six(F.max(words)).alias("overlap"), T.six(F.avg(feature)).alias("features"))
    total = 0.4 * F.col("mean_score") + 0.35 * F.col("overlap") + 0.25 * F.col("features")
    return per.withColumn("grade", F.when(total >= 0.55, "strong").when(total >= 0.35, "partial").otherwise("none"))


def contexts(hits: DataFrame, limit: int = 32_000) -> DataFrame:
    """qid, context, n_chunks: the hits' texts under numbered heads, by document (summaries: by section), cut at ``limit`` characters (part of the feature)."""
    by_section = F.when(F.col("intent") == "summary", T.section_priority("section")).otherwise(0)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] doc "), F.col("doc_id").cast("string"), F.lit(" / "), F.col("section"), F.lit("\n"), F.col("text"))
    per = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(by_section.alias("s"), F.when(F.col("intent") != "summary", F.col("doc_id")).alias("d"), F.col("rank").alias("r"), line.alias("l")))).alias("p"))
    return per.select("qid", F.substring(F.array_join(F.transform("p", lambda v: v["l"]), "\n\n"), 1, limit).alias("context"), F.size("p").cast("long").alias("n_chunks"))

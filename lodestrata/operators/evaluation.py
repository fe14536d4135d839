"""Evaluation of runs: overlaps, rates, slices, gates, categories, differences. All relational."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def full(values: Column) -> Column:
    """The distinct members that aren't null or empty; none for null."""
    values = F.coalesce(values.cast("array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(values, lambda v: F.coalesce(v != "", F.lit(False))))


def overlap(expected: Column, actual: Column, accepted: Column | None = None) -> Column:
    """hit, precision, recall (4 places) and matched of two lists; accepted ones count as expected. Nothing expected: no hit, 0."""
    e, a = full(expected), full(actual)
    if accepted is not None:
        e = F.array_union(e, full(accepted))
    m = F.array_sort(F.array_intersect(e, a))
    part = lambda of: F.when(F.size(of) > 0, F.round(F.size(m) / F.size(of) + 1e-9, 4)).otherwise(0.0)
    return F.struct((F.size(m) > 0).alias("hit"), part(a).alias("precision"), part(e).alias("recall"), m.alias("matched"))


def grouped_overlap(expected_groups: Column, actual_sections: Column) -> Column:
    """As overlap, by section group; without expected groups there is no hit."""
    return overlap(expected_groups, F.transform(F.coalesce(actual_sections, F.array().cast("array<string>")), lambda s: T.section_group(s)))


def evaluated(runs: DataFrame) -> DataFrame:
    """runs with doc, section, route and citation indicators. Columns: expected_doc_ids, doc_ids, expected_sections, sections,
    expected_route, route, min_citations, n_citations, mode."""
    substantive = ~F.col("mode").isin("refuse")
    return runs.withColumns({
        "doc": overlap(F.col("expected_doc_ids"), F.col("doc_ids")), "sec": overlap(F.col("expected_sections"), F.col("sections")),
        "route_match": F.col("route") == F.col("expected_route"), "citations_pass": F.col("n_citations") >= F.col("min_citations"),
        "substantive": substantive, "zero_citation_answer": substantive & (F.col("n_citations") == 0), "refusal_no_citation": ~substantive & (F.col("n_citations") == 0),
    })


RATES = ("doc_hit_rate", "doc_precision", "doc_recall", "section_hit_rate", "route_match_rate", "citation_pass_rate", "zero_citation_rate", "substantive_doc_hit_rate", "score_mean")


def rates() -> list[Column]:
    """Means over the rows that have a value; null if none has (such as hits where nothing was expected)."""
    some = lambda c, cond: F.round(F.avg(F.when(cond, c)) + 1e-9, 4)
    num = lambda c: c.cast("double")
    has_doc, has_sec = F.size(full(F.col("expected_doc_ids"))) > 0, F.size(full(F.col("expected_sections"))) > 0
    values = (
        some(num(F.col("doc.hit")), has_doc), some(F.col("doc.precision"), has_doc), some(F.col("doc.recall"), has_doc), some(num(F.col("sec.hit")), has_sec), some(num(F.col("route_match")), F.lit(True)), some(num(F.col("citations_pass")), F.lit(True)),
        some(num(F.col("zero_citation_answer")), F.lit(True)), some(num(F.col("doc.hit")), has_doc & F.col("substantive")), some(F.nanvl("score", F.lit(None).cast("double")), F.lit(True)),
    )
    return [v.alias(n) for n, v in zip(RATES, values, strict=True)]


def summary(ev: DataFrame) -> DataFrame:
    """One row: n and the rates."""
    return ev.agg(F.count(F.lit(1)).alias("n"), *rates())


def slices(ev: DataFrame, dims: list[str], tags: str = "tags") -> DataFrame:
    """The rates by each bucket of each dimension and of each tag: dim, bucket, n, rates. A row is read once and counted in each of its buckets."""
    buckets = F.concat(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("bucket")) for d in dims]), F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("dim"), t.alias("bucket"))))
    return ev.withColumn("_b", F.explode(buckets)).groupBy(F.col("_b.dim").alias("dim"), F.col("_b.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *rates())


def long(wide: DataFrame, metrics: list[str], prefix: str = "") -> DataFrame:
    """metric, value rows of a one-row table."""
    return wide.select(F.explode(F.array(*[F.struct(F.lit(prefix + m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("r")).select("r.*")


def gates(metrics: DataFrame, thresholds: list[tuple[str, float]]) -> DataFrame:
    """metric, value, threshold, status (pass, fail, not_applicable without a value) and overall: fail if any gate fails."""
    t = metrics.sparkSession.createDataFrame(thresholds, "metric string, threshold double")
    x = t.join(metrics, "metric", "left")
    x = x.withColumn("status", F.when(F.col("value").isNull(), "not_applicable").when(F.col("value") >= F.col("threshold"), "pass").otherwise("fail"))
    return x.withColumn("overall", F.when(F.max((F.col("status") == "fail").cast("int")).over(Window.partitionBy(F.lit(0))) == 1, "fail").otherwise("pass"))  # as many rows as there are thresholds


def failure_category(ev: DataFrame) -> DataFrame:
    """ev with category: the first that holds of nine."""
    has_doc, has_sec = F.size(full(F.col("expected_doc_ids"))) > 0, F.size(full(F.col("expected_sections"))) > 0
    c = (
        F.when(~F.col("route_match"), "route_mismatch").when(F.col("refusal_no_citation"), "refusal_no_citation").when(F.col("zero_citation_answer"), "zero_citation_substantive_answer")
        .when(has_doc & ~F.col("doc.hit"), "doc_miss").when(has_sec & ~F.col("sec.hit"), "section_miss").when(F.col("coverage") == 0, "evidence_not_supported_by_citations")
        .when(F.col("mode") == "partial", "partial_answer").when(F.col("mode") == "refuse", "refusal_other").otherwise("ok")
    )
    return ev.withColumn("category", c)


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def funnel_status(expected: Column, candidates: Column, support: Column, cited: Column) -> Column:
    """How far an expected item came on its way to a citation."""
    e, has = full(expected), lambda of: F.size(F.array_intersect(full(expected), full(of))) > 0
    return F.when(F.size(e) == 0, "no_expected").when(has(cited), "retrieved_and_cited").when(has(support), "in_support_not_cited").when(has(candidates), "in_candidates_not_selected").otherwise("not_retrieved")


def funnel(runs: DataFrame) -> DataFrame:
    """The rates of the ledger (candidates, support, citations) and a row for each status: status, n, part."""
    x = runs.select(funnel_status(F.col("expected_doc_ids"), F.col("candidate_ids"), F.col("support_ids"), F.col("cited_ids")).alias("status"))
    return x.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))) + 1e-9, 4))  # five rows at most


def report_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Full outer join of two metric tables: metric, current, baseline, delta (4 places, null if one is missing)."""
    x = current.withColumnRenamed("value", "current").join(baseline.withColumnRenamed("value", "baseline"), "metric", "full_outer")
    return x.withColumn("delta", F.round(F.col("current") - F.col("baseline"), 4)).select("metric", "current", "baseline", "delta")


def run_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The rows of two runs that differ: key and the names of the changed fields."""
    x = a.alias("a").join(b.alias("b"), key)
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in fields]))
    return x.select(F.col(key), changed.alias("changed")).where(F.size("changed") > 0)


def verdict(old: DataFrame, new: DataFrame, margins: list[tuple[str, float]]) -> DataFrame:
    """metric, old, new, threshold, passed: whether each rate of the new run is at least the old one's less a margin (missing: 0)."""
    m = old.sparkSession.createDataFrame(margins, "metric string, margin double")
    x = m.join(old.withColumnRenamed("value", "old"), "metric", "left").join(new.withColumnRenamed("value", "new"), "metric", "left")
    low = F.round(F.coalesce("old", F.lit(0.0)) - F.col("margin"), 4)
    return x.select("metric", "old", "new", low.alias("threshold"), (F.coalesce("new", F.lit(0.0)) >= low).alias("passed"))


def refusals(ev: DataFrame) -> DataFrame:
    """ev with refusal: none, reasonable, false or unclassified. Columns: n_support, n_candidates, refusal_reason, branch_count, covered_branches."""
    sound = (F.col("n_support") == 0) | (F.col("n_candidates") == 0) | (F.col("n_citations") == 0) | ((F.col("route") == "comparison") & (F.col("branch_count") > 0) & (F.col("covered_branches") == 0)) | F.coalesce(F.col("refusal_reason").isin("empty_support_refuse", "missing_all_branches_refuse", "post_generation_zero_citation_refuse", "fallback_without_citable_support", "weak_evidence"), F.lit(False))
    wrong = (F.col("doc.hit") & (F.col("n_support") > 0)) | (F.col("n_candidates") > 0) | F.coalesce(F.col("refusal_reason") == "covered_branch_but_refuse", F.lit(False))
    return ev.withColumn("refusal", F.when(F.col("mode") != "refuse", "none").when(sound, "reasonable").when(wrong, "false").otherwise("unclassified"))


def branch_metrics(runs: DataFrame) -> DataFrame:
    """qid, branch_count, covered, missing, doc_coverage, partial_allowed from branches (label, doc_ids, required): a branch is
    covered if one of its documents was retrieved."""
    hit = lambda b: F.arrays_overlap(b["doc_ids"], F.col("doc_ids"))
    labels = lambda keep: F.transform(F.filter("branches", keep), lambda b: b["label"])
    x = runs.select("qid", "partial_from", F.size("branches").cast("long").alias("branch_count"), labels(hit).alias("covered"), labels(lambda b: ~hit(b) & b["required"]).alias("missing"))
    return x.select("qid", "branch_count", "covered", "missing", F.when(F.col("branch_count") > 0, F.round(F.size("covered") / F.col("branch_count") + 1e-9, 4)).alias("doc_coverage"), ((F.col("partial_from") > 0) & (F.size("covered") >= F.col("partial_from"))).alias("partial_allowed"))


def fact_presence(references: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each fact (sentence) of a reference against its context: qid, fact_no, fact, present, why. Rules in order: exact, a number
    and 15 % of the terms, 55 % of the terms."""
    f = references.select("qid", F.posexplode(T.facts("reference")).alias("fact_no", "fact")).join(contexts.select("qid", T.normal("context").alias("_c")), "qid", "left")
    t, n = T.terms("fact"), T.numbers_and_units("fact")
    part = F.when(F.size(t) > 0, F.size(F.filter(t, lambda v: F.contains(F.col("_c"), v))) / F.size(t)).otherwise(0.0)
    number = (F.size(n) > 0) & F.exists(n, lambda v: F.contains(F.replace(F.col("_c"), F.lit(" "), F.lit("")), v))
    why = F.when(F.contains(F.col("_c"), T.normal("fact")), "exact").when(number & (part >= 0.15), "number").when(part >= 0.55, "terms").otherwise("missing")
    return f.withColumns({"why": F.coalesce(why, F.lit("missing")), "fact_no": F.col("fact_no").cast("long")}).select("qid", "fact_no", "fact", (F.col("why") != "missing").alias("present"), "why")


def coverage(facts: DataFrame) -> DataFrame:
    return facts.groupBy("qid").agg(F.count(F.lit(1)).alias("n_facts"), F.sum(F.col("present").cast("long")).alias("n_covered"), F.round(F.avg(F.col("present").cast("double")) + 1e-9, 4).alias("coverage"))


def section_match(expected: DataFrame, actual: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether any expected section fits any actual one of the same question, by name or by a rule (expected, actual); rules need
    not hold both ways. Both sides are exploded rows (qid, section), so this is two equi-joins."""
    wide = expected.withColumnRenamed("section", "expected").join(rules, "expected", "left").select("qid", "expected", F.explode(F.array_compact(F.array("expected", "actual"))).alias("fits")).distinct()
    hit = wide.join(actual.select("qid", F.col("section").alias("fits")).distinct(), ["qid", "fits"], "left_semi").select("qid").distinct().withColumn("_hit", F.lit(True))
    return expected.select("qid").distinct().join(hit, "qid", "left").select("qid", F.coalesce("_hit", F.lit(False)).alias("matched"))


def first_hit_rank(rows: DataFrame, match: Column, k: int) -> DataFrame:
    """qid, first_rank, grade: pass if the first match is among the first k, partial if later, else fail."""
    x = rows.groupBy("qid").agg(F.min(F.when(match, F.col("rank"))).alias("first_rank"))
    return x.withColumn("grade", F.when(F.col("first_rank") <= k, "pass").when(F.col("first_rank").isNotNull(), "partial").otherwise("fail"))


def best_mode(rows: DataFrame, k: int) -> DataFrame:
    """The mode that serves each question best: a hit among the first k, then the earlier rank, then the mode's priority. rows: qid, mode, first_rank, priority."""
    order = F.struct((F.coalesce("first_rank", F.lit(10**6)) <= k).cast("int").alias("a"), (-F.coalesce("first_rank", F.lit(10**6))).alias("b"), (-F.col("priority")).alias("c"))
    return rows.groupBy("qid").agg(F.max_by("mode", order).alias("best_mode"))


def failure_reason(rows: DataFrame, k: int) -> DataFrame:
    """Where a question was lost: the first of in_corpus, dense_rank, hybrid_rank, rerank_rank that fails."""
    late = lambda c: F.col(c).isNull() | (F.col(c) > k)
    why = F.when(~F.col("in_corpus"), "target_not_in_corpus").when(F.col("hybrid_rank").isNull(), "not_retrieved").when(late("rerank_rank") & ~late("hybrid_rank"), "rerank_demoted").when(late("rerank_rank"), "ranked_too_low").otherwise("ok")
    return rows.withColumn("failure_reason", why)


def unsupported_numbers(answers: DataFrame) -> DataFrame:
    """answers with the numbers of the answer that no cited text has."""
    return answers.withColumn("loose_numbers", F.array_except(T.numbers_and_units("answer"), T.numbers_and_units("cited")))


def constraints(samples: DataFrame, required: list[str], one_of: dict[str, list[str]]) -> DataFrame:
    """check, n of a dataset: repeated and missing ids, gaps in the numbers, empty required fields, values outside a list."""
    parts = [
        samples.groupBy("qid").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_id").alias("check"), "n"),
        samples.agg(F.sum(F.col("qid").isNull().cast("long")).alias("n")).select(F.lit("missing_id").alias("check"), "n"),
        samples.agg((F.coalesce(F.max("qid") - F.min("qid") + 1, F.lit(0)) - F.count_distinct("qid")).alias("n")).select(F.lit("gap_in_ids").alias("check"), "n"),
        *[samples.agg(F.sum((F.coalesce(F.btrim(F.col(c).cast("string")), F.lit("")) == "").cast("long")).alias("n")).select(F.lit(f"empty_{c}").alias("check"), "n") for c in required],
        *[samples.agg(F.sum((~F.coalesce(F.col(c).isin(*v), F.lit(False))).cast("long")).alias("n")).select(F.lit(f"invalid_{c}").alias("check"), "n") for c, v in one_of.items()],
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def subset(samples: DataFrame, ids: list) -> DataFrame:
    """The samples of a list of ids in its order: place, then the sample; ids that no sample has stay, with nulls. A repeated id comes twice."""
    spark = samples.sparkSession
    wanted = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"place long, qid {dict(samples.dtypes)['qid']}")
    return wanted.join(samples, "qid", "left")


def quality_audit(rows: DataFrame) -> DataFrame:
    """Blocks (doc_id, kind, text) by document and in all: counts by kind, broken words, heading fragments. The TOTAL row is a rollup."""
    count = lambda cond: F.sum(cond.cast("long"))
    per = [count(F.col("kind") == k).alias(k) for k in ("paragraph", "heading", "table_text", "noise", "reference")]
    x = rows.rollup("doc_id").agg(F.grouping("doc_id").alias("_g"), F.count(F.lit(1)).alias("blocks"), *per, count(F.col("text").rlike(r"[a-z]-$")).alias("broken_words"), count((F.col("kind") == "heading") & (F.char_length("text") < 4)).alias("fragments"))
    return x.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("doc_id").cast("string")).alias("doc"), "blocks", "paragraph", "heading", "table_text", "noise", "reference", "broken_words", "fragments")


def section_summary(rows: DataFrame) -> DataFrame:
    """section, n_chunks, n_docs, tokens, is_body."""
    per = rows.groupBy("section").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.sum("token_count").alias("tokens"))
    return per.withColumn("is_body", ~T.section_group("section").isin("TITLE", "ABSTRACT", "UNKNOWN"))

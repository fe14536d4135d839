import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.functions.session import settle
from lodestrata.operators import corpus as C
from lodestrata.operators import evaluation as V
from lodestrata.operators import evidence as E
from lodestrata.operators import neighbors as N
from lodestrata.operators import rerank as K

HIT = "qid long, question string, intent string, chunk_id string, doc_id long, source_file string, title string, section string, text string, vector_score double, bm25_score double, fusion_score double, rerank_score double, rank long"


def hits(spark, rows, question="What is it?", intent="factoid"):
    settle(spark)
    full = []
    for i, r in enumerate(rows, 1):
        d = {"chunk_id": f"c{i}", "doc_id": i, "source_file": "f.pdf", "title": "T", "section": "Results", "text": "body", "vector_score": 0.5, "bm25_score": 0.0, "fusion_score": 0.0, "rerank_score": 1 - i / 100, "rank": i} | r
        full.append((0, question, intent, *[d[k] for k in ("chunk_id", "doc_id", "source_file", "title", "section", "text", "vector_score", "bm25_score", "fusion_score", "rerank_score", "rank")]))
    return spark.createDataFrame(full, HIT)


def test_rank1_guard_promotes_complete_table_evidence(spark):
    q = "What are the Vmax values in table 2 for enzyme PP1234?"
    rows = [{"text": "Prose about something else entirely.", "rerank_score": 0.9}, {"text": "[TABLE CAPTION] Table 2 Vmax values [TABLE TEXT] enzyme pp1234 vmax 3", "rerank_score": 0.8}, {"text": "More prose.", "rerank_score": 0.1}]
    out = {r.chunk_id: r for r in K.rank1_guard(K.guarded(hits(spark, rows, q).drop("rank"))).collect()}
    assert out["c2"]["rank"] == 1 and out["c2"].is_complete
    plain = K.rank1_guard(K.guarded(hits(spark, rows, "Who did it").drop("rank"))).collect()
    assert {r.reason for r in plain} == {"intent_not_guarded"} and not any(r.promoted for r in plain)


def test_body_coverage_swaps_one_title_for_a_body_chunk(spark):
    rows = [{"section": "Title", "doc_id": 1}, {"section": "Abstract", "doc_id": 1}, {"section": "Results", "doc_id": 2}, {"section": "Methods", "doc_id": 1}, {"section": "Discussion", "doc_id": 1}]
    out = {r.chunk_id: r for r in K.body_coverage(hits(spark, rows), 3).collect()}
    assert set(out) == {"c5", "c2", "c3"} and out["c5"].place == 1 and out["c5"].swapped_in
    same = K.body_coverage(hits(spark, rows[1:3]), 2).collect()
    assert {r.chunk_id for r in same} == {"c1", "c2"}


def test_comparison_coverage_takes_a_document_for_each_variant(spark):
    rows = [{"doc_id": 1}, {"doc_id": 1}, {"doc_id": 2}, {"doc_id": 3}]
    h = hits(spark, rows, intent="comparison").withColumn("query_scores", F.when(F.col("chunk_id") == "c3", F.array(F.lit(0.1), F.lit(1.5), F.lit(0.2))).when(F.col("chunk_id") == "c2", F.array(F.lit(0.5), F.lit(1.2), F.lit(1.4))).otherwise(F.array(F.lit(0.9), F.lit(0.3), F.lit(0.3))))
    got = [r.chunk_id for r in K.comparison_coverage(h, 3).orderBy("place").collect()]
    assert got == ["c3", "c2", "c4"]


def test_relative_floor_and_model(spark):
    h = hits(spark, [{"rerank_score": 1.0}, {"rerank_score": 0.39}, {"rerank_score": 0.41}])
    assert {r.chunk_id for r in K.above_floor(h).collect()} == {"c1", "c3"}
    assert K.above_floor(h.withColumn("rerank_score", F.lit(-1.0))).count() == 3
    out = K.model_scores(h.select("qid", "chunk_id", "question", "text"), lambda q, t: pd.Series([float(len(x)) for x in t])).collect()
    assert {r.score for r in out} == {4.0}


def chunk_rows(spark, n=6, docs=2):
    rows = [(f"{d}_{i}", d, "f", "T", "Results", 1, 1, i, 10, f"chunk {i} of {d} " + "word " * 20) for d in range(docs) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id long, source_file string, title string, section string, page_start long, page_end long, chunk_index long, token_count long, text string")


def test_neighbours(spark):
    settle(spark)
    placed = N.positions(chunk_rows(spark))
    seeds = spark.createDataFrame([(0, "0_2", 1, 0.9), (0, "0_3", 2, 0.8), (0, "1_0", 3, 0.7)], "qid long, chunk_id string, rank long, rerank_score double")
    got = N.expand(seeds, placed, 1).orderBy("place").collect()
    assert [r.chunk_id for r in got] == ["0_1", "0_2", "0_3", "0_4", "1_0", "1_1"]
    assert {r.chunk_id: (r.seed_id, r.is_neighbor) for r in got}["0_3"] == ("0_2", True)
    assert [r.chunk_id for r in N.expand(seeds, placed, 0).collect()] == ["0_2", "0_3", "1_0"]
    assert N.expand(seeds, placed, 5, 4).count() == 4
    q = spark.createDataFrame([(0, "chunk of word", "factoid")], "qid long, question string, intent string")
    audit = N.audit(seeds, placed, q).collect()
    assert {r.chunk_id for r in audit} == {"0_1", "0_4", "1_1"} and {r.status for r in audit} == {"dry_run_promoted"}
    assert all(r.neighbor_score <= round(0.45 * 1.3, 6) for r in audit)


def test_summary_prefers_two_documents_and_drops_near_copies(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [{"doc_id": 1, "text": a}, {"doc_id": 1, "text": a + " iota"}, {"doc_id": 2, "text": "other words entirely here and more of them"}, {"doc_id": 1, "section": "References", "text": a}]
    scored = E.support(E.ledger(hits(spark, rows, "Summary of alpha", "summary")))
    graded = E.summary_quality(scored)
    assert {r.evidence_id: r.quality for r in graded.collect()}["E4"] == "references_section"
    assert [r.doc_id for r in E.summary(graded).orderBy("place").collect()] == [1, 2]


def test_answers_cite_only_their_support(spark):
    h = hits(spark, [{"text": "The yield was 5 g/L."}, {"text": "It increased."}, {"text": "Nothing."}, {"text": "Four."}])
    chosen = E.factoid(E.support(E.ledger(h)))
    plans = spark.createDataFrame([(0, "factoid", "full", "factoid_supported", 3, 0), (1, "factoid", "full", "x", 0, 0)], "qid long, intent string, mode string, reason string, n_support long, missing_branches long")
    answers = E.extractive_answers(plans, chosen)
    cites = E.bind_citations(answers, chosen).collect()
    assert {c.chunk_id for c in cites} <= {r.chunk_id for r in chosen.collect()} and sorted(c.citation_no for c in cites) == [1, 2, 3]
    bad = spark.createDataFrame([(0, "full", "The yield was 9 g/L [E99] [E1]")], "qid long, mode string, answer string")
    assert E.answer_flags(bad, chosen).first().flags == ["invalid_citation_ids", "unsupported_number"]
    assert [c.evidence_id for c in E.bind_citations(bad, chosen).collect()] == ["E1"]
    final = {r.qid: r for r in E.validated(plans, answers, E.bind_citations(answers, chosen)).collect()}
    assert final[0].mode == "full" and final[1].mode == "refuse" and final[1].answer == E.REFUSAL
    downgraded = E.validated(plans.withColumn("missing_branches", F.lit(1)), answers, E.bind_citations(answers, chosen)).where("qid = 0").first()
    assert downgraded["mode"] == "partial"
    kept = E.rewritten(answers, chosen, lambda s: s + " [E99]").where("qid = 0").first()
    assert not kept.rewritten and "E99" not in kept.answer
    assert E.rewritten(answers, chosen, lambda s: s.str.replace("yield", "Yield")).where("qid = 0").first().rewritten


def test_existence(spark):
    asked = ["Is there a clinical trial of CAR-T cells in DLBCL?", "Are there clinical trial data of CAR-T?", "Are there whales?", "Does the library have a review of DLBCL?"]
    q = spark.createDataFrame([(str(i), x, "factoid") for i, x in enumerate(asked)], "qid string, question string, intent string")
    support = [("0", "T", "Results", "A clinical trial (CAR-T) in DLBCL patients"), ("1", "T", "Results", "data of mice"), ("3", "T", "Results", "a review of LBCL")]
    got = {r.qid: r for r in E.existence(q, spark.createDataFrame(support, "qid string, title string, section string, text string")).collect()}
    assert got["0"].support_status == "strong" and got["0"].term_part == 1.0  # an entity and a phrase
    assert got["1"].support_status == "weak" and got["3"].support_status == "weak"  # no entity; the entity only as a part of a word
    assert got["2"].support_status == "none" and got["2"].asks_existence


def test_flags_of_rewritten_answers(spark):
    rows = {
        "ok": ("full", "Yield rose to 5 g/l [E1].", "", 0), "marks": ("full", "Yield [E1] [E9]", "", 0), "none": ("full", "Yield rose.", "", 0), "over": ("partial", "This is fully supported, limited support [E1]", "", 0),
        "negated": ("partial", "This is not fully supported; limited support [E1]", "", 0), "tone": ("partial", "Yield rose [E1]", "", 0), "exists": ("partial", "limited support，可以确认包含 [E1]", "existence_weak_support", 0),
        "branch": ("partial", "limited support [E1]", "", 1), "number": ("full", "Yield rose to 77 g/l [E1]", "", 0), "refuse": ("refuse", "No [E1]", "", 0), "long": ("full", "x" * 1300 + " [E1]", "", 0),
    }
    answers = spark.createDataFrame([(k, v[0], v[1]) for k, v in rows.items()], "qid string, mode string, answer string")
    plans = spark.createDataFrame([(k, v[2], v[3]) for k, v in rows.items()], "qid string, reason string, missing_branches long")
    chosen = spark.createDataFrame([(k, "E1", "yield 5 g/l") for k in rows], "qid string, evidence_id string, text string")
    before = spark.createDataFrame([(k, "It is so [E1].") for k in rows], "qid string, answer string")
    got = {r.qid: r.flags for r in E.answer_flags(answers, chosen, plans, None, before).collect()}
    assert got["ok"] == [] and got["marks"] == ["invalid_citation_ids", "citation_set_changed"] and got["none"] == ["missing_citations", "dropped_all_citations", "citation_set_changed"]
    assert got["over"] == ["partial_overclaim", "partial_abstention_tone"] and got["negated"] == [] and got["tone"] == ["partial_abstention_tone"]
    assert got["exists"] == ["existence_overclaim", "missing_existence_weak_disclaimer"] and got["branch"] == ["missing_branch_limit_not_disclosed"] and got["number"] == ["unsupported_number"]
    assert got["refuse"] == ["refusal_with_citation"] and got["long"] == ["output_too_long"]
    coverage = spark.createDataFrame([("ok", "E2", "direct"), ("ok", "E3", "indirect")], "qid string, evidence_id string, status string")
    got = {r.qid: r.flags for r in E.answer_flags(answers, chosen, plans, coverage, before).collect()}
    assert got["ok"] == ["comparison_disallowed_citation", "missing_direct_branch_citation", "indirect_branch_limit_not_disclosed"] and got["tone"] == ["partial_abstention_tone"]


def plain_pack(words_by_block, size, overlap):
    out, cur, lead = [], [], []
    for w in words_by_block:
        if cur and len(lead) + len(cur) + len(w) > size:
            out.append(lead + cur)
            lead = cur[-overlap:] if overlap and len(cur) > overlap else []
            cur = []
        cur = cur + w
    if cur:
        out.append(lead + cur)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize(("size", "overlap"), [(10, 0), (10, 3), (7, 2), (100, 5)])
def test_packing_is_the_plain_loop(spark, size, overlap):
    texts = ["a b c\nd e f g\n\nh i j k l\nm n o p q r s t u v w x y z", "one", "", None, "x " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in C.packed(docs, size, overlap).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    want = {i: p for i, t in enumerate(texts) if (p := plain_pack([x.split() for x in (t or "").split("\n") if x.strip()], size, overlap))}
    assert got == want


def test_structure(spark):
    rows = spark.createDataFrame([(1, 0, "Introduction of"), (1, 1, "the enzyme"), (1, 2, "Text here."), (1, 3, "[1] Smith 1999"), (1, 4, "[2] Jones 2001"), (1, 9, "[3] Late 2002")], "doc_id long, ord long, text string")
    merged = C.merged_headings(rows.withColumn("heading", F.col("ord") < 2)).orderBy("ord").collect()
    assert merged[0].text == "Introduction of the enzyme" and merged[0].last_ord == 1
    assert [(r.first_ord, r.last_ord, r.n) for r in C.reference_runs(rows).collect()] == [(3, 4, 2)]
    table = rows.withColumn("kind", F.when(F.col("ord") == 0, "table_caption").when(F.col("ord") == 2, "heading").otherwise("other"))
    assert [r.in_table for r in C.table_context(table).orderBy("ord").collect()] == [True, True, False, False, False, False]


def test_evaluation(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    o = one(V.overlap(F.array(F.lit("a"), F.lit("b"), F.lit("")), F.array(F.lit("b"), F.lit("c"), F.lit("b"))))
    assert (o.hit, o.precision, o.recall, o.matched) == (True, 0.5, 0.5, ["b"])
    none = one(V.overlap(F.lit(None).cast("array<string>"), F.array(F.lit("b"))))
    assert (none.hit, none.precision, none.recall) == (False, 0.0, 0.0)
    m = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "metric string, value double")
    g = {r.metric: r for r in V.gates(m, [("a", 0.5), ("b", 0.5), ("c", 0.5)]).collect()}
    assert [g[k].status for k in "abc"] == ["pass", "fail", "not_applicable"] and g["a"].overall == "fail"
    assert V.gates(m.where("metric = 'a'"), [("a", 0.5), ("c", 0.5)]).first().overall == "pass"
    q = spark.createDataFrame([("5 g/L and 7 mM", "5 g/L")], "answer string, cited string")
    assert V.unsupported_numbers(q).first().loose_numbers == ["7mm"]


def test_words_end_at_accented_letters(spark):
    """an edge of a word is that of ASCII words, in the question and in its support, as in the query's SQL."""
    q = spark.createDataFrame([(0, "SSö zu. Is it there?", "factoid"), (1, "Äin TAT?", "factoid")], "qid long, question string, intent string")
    rows = [(0, "T", "Results", "das ss ist"), (1, "T", "Results", "un étatö"), (1, "T", "Results", "un étatö")]
    got = {r.qid: (r.term_part, r.n_support) for r in E.existence(q, spark.createDataFrame(rows, "qid long, title string, section string, text string")).collect()}
    assert got == {0: (1.0, 1), 1: (1.0, 2)}

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.lexicon import Settings
from lodestrata.operators import assessment as A
from lodestrata.operators import retrieval as R
from lodestrata.plans import engine

PAPER = """Fucosyltransferase increases production of 2-fucosyllactose in E. coli
Abstract about human milk oligosaccharides and their microbial production in engineered strains today.
Introduction of the field with many words on metabolic engineering and pathways of sugar nucleotides.
Methods were standard fermentations of engineered strains in minimal medium with lactose as acceptor.
Results showed that the yield of 2-fucosyllactose increased to 20 g/L in fed batch with fucosyltransferase.
Results on lactose uptake showed that the permease limits the titer of the product in late phases.
Discussion of fucosyltransferase variants and their activity under process conditions at scale."""


@pytest.fixture(scope="module")
def library(spark):
    other = "\n".join(f"Unrelated line {i} about soil bacteria and nitrogen fixation in the field of agronomy research." for i in range(12))
    docs = spark.createDataFrame([(1, "a.pdf", PAPER), (2, "b.pdf", other), (3, "c.pdf", None), (4, "d.pdf", PAPER.replace("fucosyl", "sialyl").replace("Fucosyl", "Sialyl"))], "doc_id long, source string, text string")
    return engine.Library.build(docs, 2)


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, question string")


def test_ask(spark, library):
    out = engine.ask(questions(spark, "What yield of 2-fucosyllactose was reached with fucosyltransferase?", "Summary of fucosyltransferase production", "Compare fucosyltransferase and sialyltransferase"), library, Settings.of("debug"), model=lambda q, t: pd.Series([float("fucosyl" in x) for x in t]))
    answers = {r.qid: r for r in out["answers"].collect()}
    assert set(answers) == {0, 1, 2} and answers[0]["mode"] == "full" and answers[0].n_citations > 0 and "[E" in answers[0].answer
    support = {(r.qid, r.chunk_id) for r in out["support"].collect()}
    assert {(r.qid, r.chunk_id) for r in out["citations"].collect()} <= support
    assert answers[2]["mode"] in ("partial", "refuse")
    assert out["neighbours"].count() >= 0


def test_saved_library(spark, library, tmp_path):
    library.save(str(tmp_path), "1")
    again = engine.Library.load(spark, str(tmp_path), "1")
    assert again.postings.count() == library.postings.count() and engine.Library.load(spark, str(tmp_path), "2") is None


def test_filters_fall_back(spark, library):
    q = questions(spark, "What is fucosyltransferase?")
    steps = [f for _, f in R.filter_ladder([999], None, None)] + [{"doc_ids": [4]}]
    found = engine.search(q, library, Settings(), [steps[0], steps[-1]])
    assert {r.doc_id for r in found.collect()} == {4} and {r.attempt for r in found.collect()} == {1}


def test_branches_and_keywords(spark):
    cases = {
        "Compare enzyme A and enzyme B in yeast?": ("enzyme A", "enzyme B in yeast", "ok"), "A1 vs. B2": ("A1", "B2", "ok"), "A comparison between growth and yield": ("growth", "yield", "ok"), "比较 甲醇 和 乙醇 的产量": ("甲醇", "乙醇", "ok"),
        "文库中有两类方案：一类是补料策略A，另一类是染色体整合。": ("补料策略A", "染色体整合", "ok"), "比较文库中WcfB和FutC的差异": ("WcfB", "FutC", "ok"), "请比较补料与整合两种策略": ("补料", "整合", "ok"),
        "Tell me more": (None, None, "not_comparison_intent"), "compare role and mechanism": (None, None, "generic_branch"), "Compare x1 and x1": (None, None, "duplicate_branch"), "  ？": (None, None, "empty_question"), "Please compare them": (None, None, "no_supported_pattern"),
        "compare " + "a" * 90 + " and b2": (None, None, "branch_too_long"),
    }
    got = spark.createDataFrame([(q,) for q in cases], "q string").select("q", T.branches("q").alias("b")).collect()
    assert {r.q: tuple(r.b) for r in got} == cases
    row = spark.createDataFrame([("Yield of 2′-FL and GDP-L-fucose", ["2'-fl", "gdp l fucose", "absent"])], "t string, k array<string>")
    assert row.select(T.keyword_hits("t", "k").alias("h")).first().h == ["2'-fl", "gdp l fucose"]
    assert not row.select(T.meets_keywords("t", "k").alias("h")).first().h
    assert spark.range(1).select(T.canonical(F.lit("2-Fucosyllactose and FL"), {"hmo1": ["2-fucosyllactose", "fl"]}).alias("x")).first().x == "hmo1 and hmo1"


def test_captions_and_sections(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    parts = one(T.split_captions(F.lit("It grew. Figure 2. Growth curve. Table 1. Primers used.")))
    assert [(p.kind, p.text) for p in parts] == [("paragraph", "It grew."), ("figure_caption", "Figure 2. Growth curve."), ("table_caption", "Table 1. Primers used.")]
    names = {"2. Materials and Methods": "Methods", "## Results": "Results", "RESULTS AND DISCUSSION:": "Results and Discussion", "参考文献": "References", "Strains": None}
    assert {n: one(T.section_name(F.lit(n))) for n in names} == names


def test_claims_and_templates(spark):
    claims = spark.createDataFrame([(0, "It grew well.", "supported", "c1"), (0, "Smith et al. doi 10.1", "supported", "c1"), (0, "No source", "supported", " "), (0, "Guess", "unsupported", "c2")], "qid long, fact string, status string, source string")
    assert [r.fact for r in A.valid_claims(claims).collect()] == ["It grew well."]
    routed = spark.createDataFrame([(0, "factoid"), (1, "comparison")], "qid long, intent string")
    assert {r.qid: r.suffices for r in A.claims_suffice(routed, claims).collect()} == {0: True, 1: False}
    levels = spark.createDataFrame([(0, "none", True, "weak_evidence"), (1, "strong", False, "")], "qid long, level string, refuse boolean, reason string")
    modes = {r.qid: (r.mode, r.recovered) for r in A.answer_mode(levels, A.claims_suffice(routed, claims)).collect()}
    assert modes == {0: ("partial", True), 1: ("full", False)}
    answers = spark.createDataFrame([(0, "Alpha grows. [1]\nBeta dies. [2]")], "qid long, answer string")
    clean = A.without_missing_branches(answers, spark.createDataFrame([(0, "Beta")], "qid long, branch string")).first().answer
    assert clean == "Alpha grows. [1]\nNo evidence: beta"
    both = A.two_phase(spark.createDataFrame([(0, "q"), (1, "q")], "qid long, question string"), spark.createDataFrame([(0, "x"), (1, "y")], "qid long, context string"), lambda s: pd.Series(['note {"claims": [{"fact": "F", "status": "supported", "source": "c"}]}' if "x" in v else "none" for v in s]), lambda s: "Answer: " + s)
    assert {r.qid: r.answer for r in both.collect()} == {0: "Answer: F", 1: None}


def test_lookups(spark):
    hits = spark.createDataFrame([(0, "a", None), (0, "b", "T")], "qid long, chunk_id string, title string")
    meta = spark.createDataFrame([("a", "M", 3), ("b", "N", 4)], "chunk_id string, title string, page long")
    assert {(r.chunk_id, r.title, r.page) for r in A.with_sidecar(hits, meta, ["title", "page"]).collect()} == {("a", "M", 3), ("b", "T", 4)}
    reports = spark.createDataFrame([("p1", "d", 1), ("p2", "d", 2), ("q", "e", 1)], "path string, dataset string, modified long")
    assert {r.dataset: r.path for r in A.latest_baseline(reports).collect()} == {"d": "p2", "e": "q"}
    units = spark.createDataFrame([(0, "a", "Same  quote", 0.1), (0, "a", "same quote", 0.2), (0, "z", "other", 0.3)], "qid long, chunk_id string, quote string, score double")
    assert A.unique_units(units, meta.withColumn("text", F.lit(""))).count() == 2
    ev = spark.createDataFrame([(True, "refuse"), (True, "full"), (False, "refuse"), (False, "full")], "should_refuse boolean, mode string")
    r = A.abstention(ev).first()
    assert (r.recall, r.precision, r.wrong) == (0.5, 0.5, 1)
    bad = "论文.pdf".encode().decode("latin-1")
    fixed = {r.old_name: (r.new_name, r.codec) for r in A.decoded_names(spark.createDataFrame([(bad,), ("plain.pdf",)], "old_name string")).collect()}
    assert fixed == {bad: ("论文.pdf", "utf-8"), "plain.pdf": ("plain.pdf", "")}
    rows = spark.createDataFrame([(1, ["a b c", "d e"]), (2, None)], "d long, x array<string>")
    assert rows.count() == 2

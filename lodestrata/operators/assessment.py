"""The older way to an answer: what the evidence is worth, claims, templates, and lookups around them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Settings
from .evidence import signals
from .ranking import ranked, top
from .rerank import profile

SETTINGS = Settings()
# Fixed values by intent: least mean score, mean score below which an answer is partial, least score of an evidence unit, features below which
# evidence is weak, least part of a comparison's branches. "policy" holds for all intents that have no entry; "default" where no policy is used.
THRESHOLDS = {"default": (0.38, 0.50, 0.30, 0.35, 0.55), "policy": (0.34, 0.46, 0.34, 0.32, 0.40), "summary": (0.32, 0.44, 0.30, 0.32, 0.40), "comparison": (0.30, 0.44, 0.28, 0.32, 0.40)}
BIBLIOGRAPHIC = T.edges(r"(?i)\bet al\b|\bdoi\b|\bvol\.|\bpp\.|\bjournal\b|\b(19|20)\d\d;|\[\d+\]")


def thresholds(routed: DataFrame, policy: bool = True) -> DataFrame:
    """routed questions with the five limits of their intent, or without a policy the same for all."""
    names = ("least_score", "partial_below", "least_unit", "weak_below", "least_branches")
    other = THRESHOLDS["policy" if policy else "default"]
    pick = lambda i: F.when(F.lit(policy) & (F.col("intent") == "summary"), THRESHOLDS["summary"][i]).when(F.lit(policy) & (F.col("intent") == "comparison"), THRESHOLDS["comparison"][i]).otherwise(other[i])
    return routed.withColumns({n: pick(i) for i, n in enumerate(names)})


def support_chunks(hits: DataFrame, k: int = 5, s: Settings = SETTINGS) -> DataFrame:
    """The k hits that fit a question's profile best: score, anchors found, structure markers, the named table or figure (0.45) and
    document (0.18); a question that names a document takes only its chunks, if it has any."""
    x = hits.withColumns({"_p": profile("question", s), "_low": F.lower(F.coalesce("text", F.lit("")))})
    has = lambda m: F.contains(F.col("_low"), F.lit(m))
    kind = F.col("_p.kind")
    anchors = F.when(F.size("_p.anchors") > 0, F.size(F.filter("_p.anchors", lambda a: F.contains(F.col("_low"), a))) / F.size("_p.anchors")).otherwise(0.0)
    marker = F.when(kind == "table", F.when(has("[table text]"), 0.3).otherwise(0.0) + F.when(has("[table caption]"), 0.2).otherwise(0.0)).when((kind == "figure") & has("[figure caption]"), 0.4).otherwise(0.0)
    named = F.exists("_p.tables", lambda r: F.contains(F.col("_low"), F.concat(F.lit("table "), r))) | F.exists("_p.figures", lambda r: F.contains(F.col("_low"), F.concat(F.lit("figure "), r)))
    own = F.coalesce(F.lower(F.col("doc_id").cast("string")) == F.col("_p.doc_id"), F.lit(False))
    x = x.withColumn("_own", own).withColumn("_any", F.max("_own").over(Window.partitionBy("qid"))).where(F.col("_own") | ~F.col("_any"))
    score = T.fifth_score(F.greatest("rerank_score", "vector_score", "fusion_score")) + 0.35 * anchors + marker + F.when(named, 0.45).otherwise(0.0) + F.when(F.col("_own"), 0.18).otherwise(0.0) - F.col("rank") * 1e-6
    x = x.withColumn("support_score", T.six(score)).drop("_p", "_low", "_own", "_any")
    return top(x, ["qid"], [F.desc("support_score"), F.col("rank")], k, "place")


def missing_structure(hits: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """qid, refuse: questions that name a table or figure by number of which no hit has the marker and the name."""
    x = hits.select("qid", profile("question", s).alias("p"), F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    found = lambda refs, word, marks: F.exists(refs, lambda r: F.contains(F.col("t"), F.concat(F.lit(word), r))) & T.has_any("t", marks)
    ok = found("p.tables", "table ", ("[table text]", "[table caption]")) | found("p.figures", "figure ", ("[figure caption]",))
    asks = (F.size("p.tables") > 0) | (F.size("p.figures") > 0)
    return x.groupBy("qid").agg((F.max(asks.cast("int")) * (1 - F.max(ok.cast("int"))) == 1).alias("refuse"))


def named_coverage(question: Column, texts: Column, s: Settings = SETTINGS) -> Column:
    """The part of the branches a comparison names by the lexicon of which one of the texts (an array, lower-cased) has a word; 1 if it names none."""
    low = F.lower(question)
    asked = [T.has_any(low, names) for names, _ in s.lexicon.named_branches]
    found = lambda words: F.exists(texts, lambda t: T.has_any(t, words))
    met = [a & found(words) for a, (_, words) in zip(asked, s.lexicon.named_branches, strict=True)]
    n = sum((a.cast("int") for a in asked), F.lit(0))
    return F.when(n == 0, 1.0).otherwise(sum((m.cast("int") for m in met), F.lit(0)) / n)


def assessed(routed: DataFrame, hits: DataFrame, k: int = 5, policy: bool = True, single_doc_refuses: bool = True, s: Settings = SETTINGS) -> DataFrame:
    """qid, level (strong, partial, none), refuse, reason from the k first hits and the limits of the question's intent.

    In order: no hit; a table or figure that no hit has; a low mean score, or few shared words with few features; a comparison with
    too few of its branches, or from one document (unless that is allowed); else many reviews, a middling score, or few words
    and features make an answer partial.
    """
    x = hits.where(F.col("rank") <= k)
    text = F.lower(F.concat_ws(" ", "title", F.substring("text", 1, 600)))
    negative = T.has_any(F.lower(F.concat_ws(" ", "title", F.substring("text", 1, 400))), s.lexicon.negative)
    per = x.groupBy("qid").agg(F.avg(T.fifth_score(F.greatest("rerank_score", "vector_score", "fusion_score"))).alias("_s"), F.count_distinct("doc_id").alias("_d"), F.avg(negative.cast("double")).alias("_n"), F.collect_list(text).alias("_x"))
    per = per.join(signals(x, s).select("qid", "overlap", "features"), "qid")
    x = thresholds(routed, policy).join(per, "qid", "left").join(missing_structure(hits).withColumnRenamed("refuse", "_m"), "qid", "left")
    x = x.withColumn("coverage", F.when((F.col("intent") == "comparison") & F.col("_x").isNotNull(), named_coverage(F.col("question"), F.col("_x"), s)).otherwise(1.0))
    compares = F.col("intent") == "comparison"
    weak = (F.col("_s") < F.col("least_score")) | ((F.col("overlap") < 0.05) & (F.col("features") < F.col("weak_below")))
    reason = (
        F.when(F.col("_s").isNull(), "empty_support_refuse").when(F.coalesce("_m", F.lit(False)), "missing_structured_reference").when(weak, "weak_evidence")
        .when(compares & (F.col("coverage") < F.col("least_branches")), "comparison_branch_coverage").when(compares & (F.col("_d") == 1) & F.lit(single_doc_refuses), "comparison_single_doc").otherwise("")
    )
    limited = (F.col("_n") > 0.55) | (F.col("_s") < F.col("partial_below")) | ((F.col("overlap") < 0.1) & (F.col("features") < 0.5))
    x = x.withColumn("reason", reason)
    level = F.when(F.col("reason").isin("empty_support_refuse", "missing_structured_reference", "weak_evidence"), "none").when((F.col("reason") != "") | limited, "partial").otherwise("strong")
    number = lambda c: T.six(F.coalesce(c, F.lit(0.0)))
    return x.select("qid", "intent", level.alias("level"), (F.col("reason") != "").alias("refuse"), "reason", number("_s").alias("mean_score"), number("overlap").alias("overlap"), number("features").alias("features"), T.six("coverage").alias("coverage"), number("_n").alias("negative"))


def valid_claims(claims: DataFrame) -> DataFrame:
    """claims (qid, fact, status, source) that are supported, have a source and are no bibliography."""
    marks = F.regexp_count(F.coalesce("fact", F.lit("")), F.lit(BIBLIOGRAPHIC))
    biblio = (marks >= 2) | ((marks >= 1) & (T.word_count("fact") < 40))
    return claims.where((F.col("status") == "supported") & (F.coalesce(F.btrim("source"), F.lit("")) != "") & ~biblio)


def claims_suffice(routed: DataFrame, claims: DataFrame) -> DataFrame:
    """qid, n_claims, suffices: one claim for a fact, else two."""
    n = valid_claims(claims).groupBy("qid").agg(F.count(F.lit(1)).alias("n_claims"))
    x = routed.join(n, "qid", "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0)))
    return x.select("qid", "n_claims", (F.col("n_claims") >= F.when(F.col("intent") == "factoid", 1).otherwise(2)).alias("suffices"))


def branch_matches(branch_rows: DataFrame, support: DataFrame, least: float = 0.45, soft: float = 0.2) -> DataFrame:
    """qid, branch_no, best, covered, soft: how well each branch is met by its question's support: the part of its terms in one item."""
    x = branch_rows.join(support.select("qid", F.lower("text").alias("_x")), "qid")
    part = F.when(F.size("terms") > 0, F.size(F.filter("terms", lambda t: F.contains(F.col("_x"), t))) / F.size("terms")).otherwise(0.0)
    per = x.groupBy("qid", "branch_no").agg(T.six(F.max(part)).alias("best"))
    return per.withColumns({"covered": F.col("best") >= least, "soft": (F.col("best") >= soft) & (F.col("best") < least)})


def answer_mode(levels: DataFrame, suffices: DataFrame) -> DataFrame:
    """qid, mode, recovered: what is refused for weak evidence may be answered in part if claims suffice."""
    x = levels.join(suffices, "qid", "left")
    saved = F.col("refuse") & (F.col("reason") == "weak_evidence") & F.coalesce("suffices", F.lit(False))
    return x.select("qid", F.when(saved, "partial").when(F.col("refuse"), "refuse").when(F.col("level") == "strong", "full").otherwise("partial").alias("mode"), saved.alias("recovered"))


def structured_answers(modes: DataFrame, support: DataFrame, refusal: str = "The library's evidence is not enough to answer this question.", chars: int = 200) -> DataFrame:
    """qid, mode, answer: a numbered line for each item of support, or the refusal; an answer without a source is a refusal."""
    lines = support.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", F.concat(F.col("place").cast("string"), F.lit(". "), T.squeezed("text", chars), F.lit(" ["), F.col("place").cast("string"), F.lit("]")).alias("l")))).alias("l"))
    x = modes.join(lines, "qid", "left")
    refuse = (F.col("mode") == "refuse") | F.col("l").isNull()
    return x.select("qid", F.when(refuse, "refuse").otherwise(F.col("mode")).alias("mode"), F.when(refuse, refusal).otherwise(F.array_join(F.transform("l", lambda v: v["l"]), "\n")).alias("answer"))


def without_missing_branches(answers: DataFrame, missing: DataFrame) -> DataFrame:
    """answers without the lines that name a branch that has no evidence (missing: qid, branch), and a line that says so."""
    m = missing.groupBy("qid").agg(F.array_sort(F.collect_set(F.lower("branch"))).alias("_m"))
    x = answers.join(m, "qid", "left").withColumn("_m", F.coalesce("_m", F.array().cast("array<string>")))
    kept = F.filter(F.split("answer", "\n"), lambda line: ~F.exists("_m", lambda b: F.contains(F.lower(line), b)))
    note = F.when(F.size("_m") > 0, F.array(F.concat(F.lit("No evidence: "), F.array_join("_m", ", ")))).otherwise(F.array().cast("array<string>"))
    return x.withColumn("answer", F.array_join(F.concat(kept, note), "\n")).drop("_m")


def two_phase(questions: DataFrame, contexts: DataFrame, extract: Callable[[pd.Series], pd.Series], write: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """qid, claims, answer by a model called twice: ``extract`` turns a prompt into JSON with claims, ``write`` valid claims into an
    answer; a question whose claims don't pass has answer null. Both run on Arrow batches; there is no model of our own here."""
    x = questions.join(contexts, "qid").select("qid", F.concat_ws("\n", "question", "context").alias("_in"))
    x = x.withColumn("_json", T.first_json(F.pandas_udf(extract, "string")("_in")))
    claims = x.select("qid", F.explode(F.from_json("_json", "claims array<struct<fact:string,status:string,source:string>>")["claims"]).alias("c")).select("qid", "c.*")
    good = valid_claims(claims).groupBy("qid").agg(F.array_sort(F.collect_list("fact")).alias("claims"))
    out = questions.select("qid").join(good, "qid", "left").withColumn("claims", F.coalesce("claims", F.array().cast("array<string>")))
    return out.withColumn("answer", F.when(F.size("claims") > 0, F.pandas_udf(write, "string")(F.array_join("claims", "\n"))))


def with_sidecar(hits: DataFrame, meta: DataFrame, columns: list[str], key: str = "chunk_id") -> DataFrame:
    """hits with columns filled from a table by key where they are null."""
    side = meta.select(F.col(key), *[F.col(c).alias(f"_m_{c}") for c in columns])
    x = hits.join(side, key, "left")
    mine = lambda c: F.coalesce(c, f"_m_{c}") if c in hits.columns else F.col(f"_m_{c}")
    return x.withColumns({c: mine(c) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def with_ranks(final: DataFrame, runs: dict[str, DataFrame], key: str = "chunk_id") -> DataFrame:
    """final with the rank that each run (qid, key, rank) gave its rows."""
    for name, run in runs.items():
        final = final.join(run.select("qid", key, F.col("rank").alias(f"{name}_rank")), ["qid", key], "left")
    return final


def first_hits(hits: DataFrame, score: str, k: int = 3) -> DataFrame:
    """qid, hits: the first k as structs for a report."""
    x = hits.where(F.col("rank") <= k).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "title", "section", F.col(score).alias("score")))).alias("hits"))
    return x


def unique_units(units: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """Evidence units (qid, chunk_id, quote, score) with their chunk's columns, one for each chunk and quote (white space aside): the best."""
    x = units.join(chunk_rows.drop("text"), "chunk_id", "left").withColumn("_q", F.lower(T.squeezed("quote", 10**6)))
    return top(x, ["qid", "chunk_id", "_q"], [F.desc("score"), F.col("quote")], 1, "_n").drop("_n", "_q")


def latest_baseline(reports: DataFrame) -> DataFrame:
    """The newest report (path, dataset, modified) of each dataset."""
    return reports.groupBy("dataset").agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))


def abstention(ev: DataFrame) -> DataFrame:
    """One row: how often what should be refused was, and the reverse. Columns: should_refuse, mode."""
    did = F.col("mode") == "refuse"
    n = lambda c: F.sum(c.cast("long"))
    x = ev.agg(F.count(F.lit(1)).alias("n"), n(F.col("should_refuse")).alias("due"), n(did).alias("refused"), n(F.col("should_refuse") & did).alias("right"), n(~F.col("should_refuse") & did).alias("wrong"))
    return x.withColumns({"recall": F.when(F.col("due") > 0, F.round(F.col("right") / F.col("due") + 1e-9, 4)), "precision": F.when(F.col("refused") > 0, F.round(F.col("right") / F.col("refused") + 1e-9, 4))})


def decoded_names(names: DataFrame, codecs: tuple[str, ...] = ("utf-8", "gbk", "big5", "cp437", "latin-1")) -> DataFrame:
    """names (old_name) with new_name and codec: what a name that was read by the wrong codec (written as cp437 or latin-1) says by
    the codec that gives the most letters and the fewest control and replacement signs; the name itself if none is better."""

    def repair(s: pd.Series) -> pd.DataFrame:
        def score(x: str) -> float:
            return sum(c.isalnum() or "一" <= c <= "鿿" for c in x) / max(1, len(x)) - 2 * sum(c == "�" or ord(c) < 32 or "─" <= c <= "▟" for c in x) / max(1, len(x))

        out = []
        for x in s:
            best = (score(x), x, "")
            for wrong in ("cp437", "latin-1"):
                for right in codecs:
                    try:
                        y = x.encode(wrong).decode(right)
                    except (UnicodeEncodeError, UnicodeDecodeError):
                        continue
                    mark = score(y) + (right == "utf-8")  # what decodes as UTF-8 hardly ever is anything else
                    if len(y) < len(x) and mark > best[0] + 1e-9:
                        best = (mark, y, right)
            out.append(best[1:])
        return pd.DataFrame(out, columns=["new_name", "codec"])

    fixed = F.pandas_udf(repair, "new_name string, codec string")
    return names.withColumn("_f", fixed("old_name")).select("*", "_f.new_name", "_f.codec").drop("_f")


def renumbered(hits: DataFrame) -> DataFrame:
    return ranked(hits, ["qid"], [F.col("rank"), F.col("chunk_id")])

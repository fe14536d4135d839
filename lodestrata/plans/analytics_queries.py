"""Queries of corpus structure, text functions, evaluation, sessions, audit and table changes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import evaluation as V
from ..operators.ranking import top
from ..sources import readers, sinks
from . import sql as S
from .retrieval_queries import DOC_BM25, chunk_rows, document_rows, questions, table
from .retrieval_queries import bm25_topk as bm25_docs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- corpus structure


@query(f"WITH {S.CHUNKS} SELECT chunk_id, doc_id, source_file, title, section, page_start, page_end, chunk_index, token_count, text FROM chunks")
def chunk_table(spark, sf_dir):
    return chunk_rows(spark, sf_dir)


LETTERS, DIGITS = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))", "length(regexp_replace(text, '[^\\p{Nd}]', '', 'g'))"
QUALITY = f"""CASE WHEN length(text) = 0 THEN 0 ELSE greatest(0, least(1, 1.0 - CASE WHEN length(text) < 50 THEN 0.4 WHEN length(text) < 100 THEN 0.2 ELSE 0 END - CASE WHEN {S.wc('text')} < 10 THEN 0.3 WHEN {S.wc('text')} < 20 THEN 0.15 ELSE 0 END
- CASE WHEN {LETTERS} / greatest(length(text), 1)::DOUBLE < 0.5 THEN 0.3 WHEN {LETTERS} / greatest(length(text), 1)::DOUBLE < 0.7 THEN 0.1 ELSE 0 END - CASE WHEN {DIGITS} / greatest(length(text), 1)::DOUBLE > 0.3 THEN 0.2 ELSE 0 END
- CASE WHEN {S.wc('text')} > 0 AND len(list_distinct({S.word_list('lower(text)')})) / {S.wc('text')}::DOUBLE < 0.2 THEN 0.2 ELSE 0 END)) END::DOUBLE"""


@query(f"SELECT doc_id, round({QUALITY}, 6) AS quality_score FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def quality_score(spark, sf_dir):
    return document_rows(spark, sf_dir).select("doc_id", F.round(T.quality("text"), 6).alias("quality_score"))


@query(f"""WITH {S.CHUNKS}, q AS (SELECT chunk_id, doc_id, chunk_index AS ci, {S.wc('text')} AS w, length(text) AS n, {QUALITY} AS qs, contains(text, '[TABLE TEXT]') AS tab FROM chunks)
SELECT chunk_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ci) - 1 AS chunk_index, round(qs, 6) AS quality_score FROM q WHERE CASE WHEN tab THEN n >= 20 AND w >= 3 AND qs >= 0.05 ELSE n >= 50 AND w >= 10 AND qs >= 0.3 END""")
def quality_filter(spark, sf_dir):
    return C.quality_filter(chunk_rows(spark, sf_dir)).select("chunk_id", "doc_id", "chunk_index", F.round("quality_score", 6).alias("quality_score"))


@query(f"WITH {S.CHUNKS} SELECT chunk_id, {S.HEADED} AS retrieval_text FROM chunks")
def retrieval_text(spark, sf_dir):
    return chunk_rows(spark, sf_dir).select("chunk_id", T.headed("title", "section", "source_file", "doc_id", "text").alias("retrieval_text"))


@query(f"WITH {S.CHUNKS}, t AS (SELECT source_file, token_count FROM chunks) SELECT source_file, count(*) AS n_chunks, sum(token_count)::BIGINT AS tokens, min(token_count) AS least, max(token_count) AS most, round(avg(token_count), 6) AS mean, sum((token_count < 50)::INT)::BIGINT AS short FROM t GROUP BY source_file")
def token_stats(spark, sf_dir):
    t = F.col("token_count")
    return chunk_rows(spark, sf_dir).groupBy("source_file").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(t).alias("tokens"), F.min(t).alias("least"), F.max(t).alias("most"), F.round(F.avg(t), 6).alias("mean"), F.sum((t < 50).cast("long")).alias("short"))


@query(f"SELECT doc_id, round({LETTERS} / greatest(length(text), 1)::DOUBLE, 6) AS letters, round({DIGITS} / greatest(length(text), 1)::DOUBLE, 6) AS digits FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def char_ratios(spark, sf_dir):
    return document_rows(spark, sf_dir).select("doc_id", F.round(T.ratio_of("text", r"\p{L}"), 6).alias("letters"), F.round(T.ratio_of("text", r"\p{Nd}"), 6).alias("digits"))


@query(f"WITH {S.BLOCKS}, t AS (SELECT doc_id, text FROM blocks WHERE {S.wc('text')} <= 15) SELECT doc_id, trim(text) AS text, count(*) AS n FROM t GROUP BY doc_id, trim(text) HAVING count(*) >= 3")
def header_footer_lines(spark, sf_dir):
    return C.repeated_lines(blocks(spark, sf_dir))


SHORT = f"{S.wc('text')} <= 4"


@query(f"WITH {S.BLOCKS} SELECT doc_id, ord, (sum(({SHORT})::INT) OVER w)::BIGINT AS section_no, last_value(CASE WHEN {SHORT} THEN trim(text) END IGNORE NULLS) OVER w AS section FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
def section_islands(spark, sf_dir):
    """Short lines stand for headings: sections are the islands between them, and a heading carries forward."""
    return C.with_sections(blocks(spark, sf_dir), T.word_count("text") <= 4).select("doc_id", "ord", "section_no", "section")


@query(f"""WITH {S.BLOCKS}, h AS (SELECT *, {SHORT} AS heading FROM blocks), g AS (SELECT *, CASE WHEN coalesce(lag(heading) OVER w AND heading AND (regexp_matches(lag(text) OVER w, '(?i)\\b(of|and|the|for|in|on|with|to|by|de|der|des|et|y)$') OR regexp_matches(text, '^[a-zäöüéèñ]')), false) THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM g) SELECT doc_id, min(ord) AS ord, max(ord) AS last_ord, string_agg(text, ' ' ORDER BY ord) AS text FROM r GROUP BY doc_id, run""")
def heading_merge(spark, sf_dir):
    return C.merged_headings(blocks(spark, sf_dir).withColumn("heading", T.word_count("text") <= 4))


@query(f"""WITH {S.BLOCKS}, c AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS e FROM blocks) SELECT doc_id, ord, ((e - length(text) - 1) // 3000 + 1)::BIGINT AS page_start, ((e - 1) // 3000 + 1)::BIGINT AS page_end FROM c""")
def page_ranges(spark, sf_dir):
    return C.page_ranges(blocks(spark, sf_dir)).select("doc_id", "ord", "page_start", "page_end")


@query(f"""WITH {S.CHUNKS}, blocks AS (SELECT doc_id, n, unnest(range(n)) AS ord, unnest(l) AS text FROM (SELECT doc_id, len(l) AS n, l FROM lines WHERE len(l) > 0)),
pages AS (SELECT doc_id, page, sum(c) OVER (PARTITION BY doc_id ORDER BY page) AS e FROM (SELECT doc_id, page_start AS page, sum(length(text) + 1) AS c FROM chunks GROUP BY doc_id, page_start)),
b AS (SELECT doc_id, ord, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord) AS z, z - length(text) - 1 AS a FROM blocks),
s AS (SELECT b.*, p.page AS page_start FROM b ASOF JOIN pages p ON b.doc_id = p.doc_id AND b.a <= p.e)
SELECT s.doc_id, s.ord, s.page_start, p.page AS page_end FROM s ASOF JOIN pages p ON s.doc_id = p.doc_id AND s.z <= p.e""")
def page_spans(spark, sf_dir):
    """Blocks on pages of real lengths: a page is a run of chunks with the characters that they have."""
    pages = chunk_rows(spark, sf_dir).groupBy("doc_id", F.col("page_start").alias("page")).agg(F.sum(F.char_length("text") + 1).alias("n_chars"))
    return C.page_spans(blocks(spark, sf_dir), pages).select("doc_id", "ord", "page_start", "page_end")


@query(f"""WITH {S.CHUNKS}, g AS (SELECT doc_id, token_count AS t, section IN ('Introduction', 'Methods', 'Results', 'Discussion') AS body, section IN ('Title', 'Abstract') AS front FROM chunks),
p AS (SELECT doc_id, count(*) AS n_blocks, sum(t)::BIGINT AS words, sum(CASE WHEN body THEN t ELSE 0 END)::BIGINT AS body_words, sum(CASE WHEN front THEN t ELSE 0 END)::BIGINT AS front_words FROM g GROUP BY doc_id) SELECT *, n_blocks >= 3 AND body_words * 10 < words AND front_words * 10 > words * 8 AS fallback FROM p""")
def section_fallback(spark, sf_dir):
    return C.needs_fallback(chunk_rows(spark, sf_dir).select("doc_id", "section", "token_count"))


BODY_LINE = f"(length(text) >= 20 AND NOT {S.noise('text')} AND NOT {S.heading('text')} AND NOT {S.cells('text')} AND NOT {S.reference('text')})"


@query(f"""WITH {S.KINDS}, o AS (SELECT *, last_value(CASE WHEN kind IN ('table_caption', 'table_text') THEN ord END IGNORE NULLS) OVER w AS opened, last_value(CASE WHEN kind IN ('heading', 'figure_caption') OR (kind = 'paragraph' AND {BODY_LINE}) THEN ord END IGNORE NULLS) OVER w AS closed
FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) SELECT doc_id, ord, kind, coalesce(opened > coalesce(closed, -1) AND ord - opened <= 40, false) AS in_table FROM o""")
def line_kinds(spark, sf_dir):
    """Every block's kind, and whether it stands in a table; the tests hold the rules against examples."""
    rows = blocks(spark, sf_dir).withColumn("kind", T.line_kind("text"))
    return C.table_context(rows).select("doc_id", "ord", "kind", "in_table")


@query(f"""WITH {S.KINDS} SELECT CASE WHEN grouping(doc_id) = 1 THEN 'TOTAL' ELSE doc_id::VARCHAR END AS doc, count(*) AS blocks, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ('paragraph', 'heading', 'table_text', 'noise', 'reference'))},
count(*) FILTER (regexp_matches(text, '[a-z]-$')) AS broken_words, count(*) FILTER (kind = 'heading' AND length(text) < 4) AS fragments FROM kinds GROUP BY ROLLUP (doc_id)""")
def block_quality_audit(spark, sf_dir):
    return V.quality_audit(blocks(spark, sf_dir).withColumn("kind", T.line_kind("text")))


@query(f"""WITH {S.KINDS}, t AS (SELECT doc_id, ord, text, (CASE WHEN {S.wc('text')} BETWEEN 4 AND 25 THEN 3 ELSE 0 END + CASE WHEN regexp_matches(text, '^[A-ZÄÖÜÉÈÑ]') THEN 2 ELSE 0 END - CASE WHEN {S.noise('text')} THEN 5 ELSE 0 END - CASE WHEN {S.heading('text')} THEN 1 ELSE 0 END
- CASE WHEN regexp_matches(text, '[.;,]$') THEN 1 ELSE 0 END - CASE WHEN {S.cells('text')} THEN 3 ELSE 0 END)::BIGINT AS score FROM kinds WHERE ord < 20) SELECT doc_id, text AS title, score FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1""")
def titles(spark, sf_dir):
    return C.title_candidates(blocks(spark, sf_dir))


def packing(size: int, overlap: int) -> str:
    """Blocks in order: each goes to the chunk of the one before if it fits; a chunk's lead is the last words of the chunk before, if that has more."""
    own = f"CASE WHEN {overlap} > 0 AND p.own > {overlap} THEN {overlap} ELSE 0 END"
    return f"""WITH RECURSIVE {S.BLOCKS}, w AS MATERIALIZED (SELECT doc_id, ord, {S.word_list('text')} AS w FROM blocks), n AS MATERIALIZED (SELECT doc_id, ord, len(w) AS n FROM w),
walk(doc_id, ord, chunk_no, own, lead) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, n::BIGINT, 0::BIGINT FROM n WHERE ord = 0
  UNION ALL SELECT p.doc_id, n.ord::BIGINT, CASE WHEN p.lead + p.own + n.n <= {size} THEN p.chunk_no ELSE p.chunk_no + 1 END, CASE WHEN p.lead + p.own + n.n <= {size} THEN p.own + n.n ELSE n.n END, CASE WHEN p.lead + p.own + n.n <= {size} THEN p.lead ELSE {own} END FROM walk p JOIN n ON n.doc_id = p.doc_id AND n.ord = p.ord + 1),
c AS (SELECT doc_id, chunk_no, min(ord) AS first_ord, max(ord) AS last_ord, max(lead) AS lead, flatten(list(w ORDER BY ord)) AS ws FROM walk JOIN w USING (doc_id, ord) GROUP BY doc_id, chunk_no),
l AS (SELECT *, CASE WHEN lead > 0 THEN lag(ws) OVER (PARTITION BY doc_id ORDER BY chunk_no)[-{max(1, overlap)}:] ELSE [] END || ws AS a FROM c)
SELECT doc_id, chunk_no, len(a) AS n_words, first_ord, last_ord, array_to_string(a, ' ') AS text FROM l"""


@query(packing(800, 0))
def chunk_pack(spark, sf_dir):
    """Greedy packing to 800 words without overlap; the tests hold it against a plain loop."""
    return C.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), 800, 0)


@query(packing(800, 120))
def chunk_overlap(spark, sf_dir):
    return C.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), 800, 120)


@query(f"WITH {S.CHUNKS}, p AS (SELECT section, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, sum(token_count)::BIGINT AS tokens FROM chunks GROUP BY section) SELECT *, section NOT IN ('Title', 'Abstract') AS is_body FROM p")
def section_summary(spark, sf_dir):
    return V.section_summary(chunk_rows(spark, sf_dir))


@query(f"WITH {S.CHUNKS} SELECT doc_id, list(section ORDER BY chunk_index, chunk_id) AS sections, list_sort(list_distinct(list(section))) AS distinct_sections FROM chunks GROUP BY doc_id")
def section_index(spark, sf_dir):
    return readers.section_index(chunk_rows(spark, sf_dir))


TEXTS = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


@query(f"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_\\x{{4e00}}-\\x{{9fff}}]{{2,}}'))) AS long_words, {S.wc('text')} AS n_words, list_distinct(list_transform(regexp_extract_all(lower(text), '[0-9]+(?:\\.[0-9]+)? ?(?:%|g/l|mg/l|mg|mm|um|fold|h\\b)?'), lambda x: replace(x, ' ', ''))) AS numbers FROM {TEXTS}")
def text_features(spark, sf_dir):
    out = document_rows(spark, sf_dir).select("doc_id", F.size(T.long_words("text")).cast("long").alias("long_words"), T.word_count("text").alias("n_words"), F.array_sort(T.numbers_and_units("text")).alias("numbers"))
    return out


ORACLES["text_features"] = ORACLES["text_features"].replace("list_distinct(list_transform(", "list_sort(list_distinct(list_transform(").replace("replace(x, ' ', ''))) AS numbers", "replace(x, ' ', '')))) AS numbers")


def squeeze(x: str, n: int) -> str:
    y = f"trim(regexp_replace({x}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"
    return f"CASE WHEN length({y}) <= {n} THEN {y} ELSE rtrim(substr({y}, 1, {n - 3})) || '...' END"


@query(f"SELECT doc_id, {squeeze('text', 160)} AS quote, trim(regexp_replace(replace(translate(lower(text), '′’‘–—−_', '''''''--- '), 'fig.', 'figure '), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS normal FROM {TEXTS}")
def compress_and_normalise(spark, sf_dir):
    return document_rows(spark, sf_dir).select("doc_id", T.squeezed("text", 160).alias("quote"), T.normal("text").alias("normal"))


# --- evaluation: run records derived from labels

RUNS = """runs AS (SELECT doc_id AS qid, CASE WHEN quality = 1 THEN [doc_id::VARCHAR] ELSE [] END AS expected_doc_ids, [(doc_id + toxic)::VARCHAR, (doc_id + 7)::VARCHAR] AS doc_ids,
CASE doc_id % 3 WHEN 0 THEN ['Results'] WHEN 1 THEN ['Title', 'Discussion'] ELSE [] END AS expected_sections, CASE doc_id % 2 WHEN 0 THEN ['Results', 'Methods'] ELSE ['Discussion'] END AS sections,
['comparison', 'summary', 'factoid'][(doc_id % 3 + 1)::INT] AS expected_route, ['comparison', 'summary', 'factoid', 'factoid'][(doc_id % 4 + 1)::INT] AS route, doc_id % 3 AS min_citations, doc_id % 4 AS n_citations,
CASE doc_id % 5 WHEN 0 THEN 'refuse' WHEN 1 THEN 'partial' ELSE 'full' END AS mode, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 100) / 100.0::DOUBLE END AS score, ['q' || quality, 't' || toxic] AS tags, CASE WHEN toxic = 1 THEN 'high' ELSE 'low' END AS risk,
(doc_id % 4) / 3.0::DOUBLE AS coverage, [doc_id::VARCHAR, (doc_id + 1)::VARCHAR] AS candidate_ids, CASE WHEN doc_id % 2 = 0 THEN [doc_id::VARCHAR] ELSE [] END AS support_ids, CASE WHEN doc_id % 4 = 0 THEN [doc_id::VARCHAR] ELSE [] END AS cited_ids,
doc_id % 3 AS n_support, doc_id % 7 AS n_candidates, ['weak_evidence', 'covered_branch_but_refuse', NULL][(doc_id % 3 + 1)::INT] AS refusal_reason, doc_id % 3 AS branch_count, doc_id % 2 AS covered_branches FROM labels)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = F.col("doc_id"), lambda c: c.cast("string")
    none = F.array().cast("array<string>")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (d % n + 1).cast("int"))
    return table(spark, sf_dir, "labels").select(
        d.alias("qid"), F.when(F.col("quality") == 1, F.array(s(d))).otherwise(none).alias("expected_doc_ids"), F.array(s(d + F.col("toxic")), s(d + 7)).alias("doc_ids"),
        F.when(d % 3 == 0, F.array(F.lit("Results"))).when(d % 3 == 1, F.array(F.lit("Title"), F.lit("Discussion"))).otherwise(none).alias("expected_sections"), F.when(d % 2 == 0, F.array(F.lit("Results"), F.lit("Methods"))).otherwise(F.array(F.lit("Discussion"))).alias("sections"),
        pick(("comparison", "summary", "factoid"), 3).alias("expected_route"), pick(("comparison", "summary", "factoid", "factoid"), 4).alias("route"), (d % 3).alias("min_citations"), (d % 4).alias("n_citations"),
        F.when(d % 5 == 0, "refuse").when(d % 5 == 1, "partial").otherwise("full").alias("mode"), F.when(d % 11 == 0, F.lit(float("nan"))).otherwise((d % 100) / 100.0).alias("score"), F.array(F.concat(F.lit("q"), s(F.col("quality"))), F.concat(F.lit("t"), s(F.col("toxic")))).alias("tags"), F.when(F.col("toxic") == 1, "high").otherwise("low").alias("risk"),
        ((d % 4) / 3.0).alias("coverage"), F.array(s(d), s(d + 1)).alias("candidate_ids"), F.when(d % 2 == 0, F.array(s(d))).otherwise(none).alias("support_ids"), F.when(d % 4 == 0, F.array(s(d))).otherwise(none).alias("cited_ids"),
        (d % 3).alias("n_support"), (d % 7).alias("n_candidates"), pick(("weak_evidence", "covered_branch_but_refuse", None), 3).alias("refusal_reason"), (d % 3).alias("branch_count"), (d % 2).alias("covered_branches"),
        F.array(*[F.struct(F.lit(n).alias("label"), F.array(s(d + k)).alias("doc_ids"), F.lit(r).alias("required")) for n, k, r in (("A", 0, True), ("B", 7, True), ("C", 9, False))]).alias("branches"), (d % 3).alias("partial_from"),
    )


def part(m: str, of: str) -> str:
    return f"CASE WHEN len({of}) > 0 THEN round(len({m}) / len({of})::DOUBLE + 1e-9, 4) ELSE 0 END"


EVAL = f"""{RUNS}, ev AS (SELECT *, list_sort(list_intersect(expected_doc_ids, doc_ids)) AS dm, list_sort(list_intersect(expected_sections, sections)) AS sm, len(dm) > 0 AS dhit, {part('dm', 'doc_ids')} AS dprec, {part('dm', 'expected_doc_ids')} AS drec, len(sm) > 0 AS shit,
route = expected_route AS route_match, n_citations >= min_citations AS citations_pass, mode <> 'refuse' AS substantive, mode <> 'refuse' AND n_citations = 0 AS zero_citation_answer, mode = 'refuse' AND n_citations = 0 AS refusal_no_citation FROM runs)"""


@query(f"WITH {EVAL} SELECT qid, dhit AS doc_hit, dprec AS doc_precision, drec AS doc_recall, dm AS matched, shit AS section_hit FROM ev")
def overlap_metrics(spark, sf_dir):
    return V.evaluated(runs(spark, sf_dir)).select("qid", F.col("doc.hit").alias("doc_hit"), F.col("doc.precision").alias("doc_precision"), F.col("doc.recall").alias("doc_recall"), F.col("doc.matched").alias("matched"), F.col("sec.hit").alias("section_hit"))


@query(f"""WITH {RUNS}, x AS (SELECT qid, list_distinct(expected_doc_ids || [(qid + 7)::VARCHAR]) AS e, list_distinct(doc_ids) AS a FROM runs), y AS (SELECT *, list_intersect(e, a) AS m FROM x) SELECT qid, len(m) > 0 AS hit, {part('m', 'a')} AS precision, {part('m', 'e')} AS recall, list_sort(m) AS matched FROM y""")
def overlap_with_accepts(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.select("qid", V.overlap(F.col("expected_doc_ids"), F.col("doc_ids"), F.array((F.col("qid") + 7).cast("string"))).alias("o")).select("qid", "o.hit", "o.precision", "o.recall", "o.matched")


GROUPS = "list_transform(sections, lambda s: CASE s WHEN 'Results' THEN 'RESULT' WHEN 'Methods' THEN 'METHOD' WHEN 'Discussion' THEN 'DISCUSSION' END)"


@query(f"WITH {RUNS}, x AS (SELECT qid, list_intersect(['RESULT', 'INTRO'], {GROUPS}) AS m FROM runs) SELECT qid, len(m) > 0 AS hit, round(len(m) / 2::DOUBLE + 1e-9, 4) AS recall FROM x")
def section_group_overlap(spark, sf_dir):
    o = V.grouped_overlap(F.array(F.lit("RESULT"), F.lit("INTRO")), F.col("sections"))
    return runs(spark, sf_dir).select("qid", o.alias("o")).select("qid", "o.hit", "o.recall")


def avg4(x: str, when: str = "true") -> str:
    return f"round(avg(CASE WHEN {when} THEN {x} END) + 1e-9, 4)"


RATES = ", ".join(f"{e} AS {n}" for n, e in zip(V.RATES, (
    avg4("dhit::INT", "len(expected_doc_ids) > 0"), avg4("dprec", "len(expected_doc_ids) > 0"), avg4("drec", "len(expected_doc_ids) > 0"), avg4("shit::INT", "len(expected_sections) > 0"), avg4("route_match::INT"), avg4("citations_pass::INT"),
    avg4("zero_citation_answer::INT"), avg4("dhit::INT", "len(expected_doc_ids) > 0 AND substantive"), avg4("score"),
), strict=True))


@query(f"WITH {EVAL} SELECT count(*) AS n, {RATES} FROM ev")
def retrieval_summary(spark, sf_dir):
    return V.summary(V.evaluated(runs(spark, sf_dir)))


SLICED = f"""sl AS (SELECT *, unnest(['route', 'risk', 'mode', 'tag', 'tag']) AS dim, unnest([route, risk, mode, tags[1], tags[2]]) AS bucket FROM ev), slices AS (SELECT dim, bucket, count(*) AS n, {RATES} FROM sl GROUP BY dim, bucket)"""


@query(f"WITH {EVAL}, {SLICED} SELECT * FROM slices")
def slice_grouping_sets(spark, sf_dir):
    return V.slices(V.evaluated(runs(spark, sf_dir)), ["route", "risk", "mode"])


GATES = [("doc_hit_rate", 0.7), ("route_match_rate", 0.7), ("citation_pass_rate", 0.8), ("score_mean", 0.75), ("high_risk_doc_hit_rate", 0.8), ("faithfulness", 0.75)]
METRICS = ["doc_hit_rate", "route_match_rate", "citation_pass_rate", "score_mean"]


@query(f"""WITH {EVAL}, s AS (SELECT {RATES} FROM ev), h AS (SELECT {RATES} FROM ev WHERE risk = 'high'), m AS ({' UNION ALL '.join(f"SELECT '{x}' AS metric, {x}::DOUBLE AS value FROM s" for x in METRICS)} UNION ALL SELECT 'high_risk_doc_hit_rate', doc_hit_rate FROM h),
t(metric, threshold) AS (VALUES {', '.join(f"('{a}', {b}::DOUBLE)" for a, b in GATES)}), g AS (SELECT t.metric, value, threshold, CASE WHEN value IS NULL THEN 'not_applicable' WHEN value >= threshold THEN 'pass' ELSE 'fail' END AS status FROM t LEFT JOIN m USING (metric))
SELECT *, CASE WHEN bool_or(status = 'fail') OVER () THEN 'fail' ELSE 'pass' END AS overall FROM g""")
def gate_table(spark, sf_dir):
    ev = V.evaluated(runs(spark, sf_dir))
    metrics = V.long(V.summary(ev), METRICS).unionByName(V.long(V.summary(ev.where("risk = 'high'")), ["doc_hit_rate"], "high_risk_"))
    return V.gates(metrics, GATES)


CATEGORY = """CASE WHEN NOT route_match THEN 'route_mismatch' WHEN refusal_no_citation THEN 'refusal_no_citation' WHEN zero_citation_answer THEN 'zero_citation_substantive_answer' WHEN len(expected_doc_ids) > 0 AND NOT dhit THEN 'doc_miss' WHEN len(expected_sections) > 0 AND NOT shit THEN 'section_miss'
WHEN coverage = 0 THEN 'evidence_not_supported_by_citations' WHEN mode = 'partial' THEN 'partial_answer' WHEN mode = 'refuse' THEN 'refusal_other' ELSE 'ok' END"""


@query(f"WITH {EVAL} SELECT qid, {CATEGORY} AS category FROM ev")
def failure_category(spark, sf_dir):
    return V.failure_category(V.evaluated(runs(spark, sf_dir))).select("qid", "category")


@query(f"WITH {EVAL} SELECT {CATEGORY} AS category, count(*) AS n, list(qid ORDER BY qid) AS ids, sum((mode = 'full')::INT)::BIGINT AS full_answers FROM ev GROUP BY category")
def failure_diagnostics(spark, sf_dir):
    ev = V.failure_category(V.evaluated(runs(spark, sf_dir)))
    return ev.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("qid")).alias("ids"), F.sum((F.col("mode") == "full").cast("long")).alias("full_answers"))


def overlaps(a: str) -> str:
    return f"len(list_intersect(expected_doc_ids, {a})) > 0"


@query(f"""WITH {RUNS}, x AS (SELECT CASE WHEN len(expected_doc_ids) = 0 THEN 'no_expected' WHEN {overlaps('cited_ids')} THEN 'retrieved_and_cited' WHEN {overlaps('support_ids')} THEN 'in_support_not_cited' WHEN {overlaps('candidate_ids')} THEN 'in_candidates_not_selected' ELSE 'not_retrieved' END AS status FROM runs)
SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE + 1e-9, 4) AS part FROM x GROUP BY status""")
def funnel_ledger(spark, sf_dir):
    return V.funnel(runs(spark, sf_dir))


DIFFED = ["doc_hit_rate", "route_match_rate", "section_hit_rate"]


@query(f"""WITH {EVAL}, a AS (SELECT {RATES} FROM ev WHERE qid % 2 = 0), b AS (SELECT {RATES} FROM ev WHERE qid % 2 = 1), ca AS ({' UNION ALL '.join(f"SELECT '{x}' AS metric, {x}::DOUBLE AS value FROM a" for x in DIFFED)}), cb AS ({' UNION ALL '.join(f"SELECT '{x}' AS metric, {x}::DOUBLE AS value FROM b" for x in [*DIFFED[1:], 'score_mean'])})
SELECT metric, ca.value AS current, cb.value AS baseline, round(ca.value - cb.value, 4) AS delta FROM ca FULL JOIN cb USING (metric)""")
def report_diff_full_outer(spark, sf_dir):
    """The even questions' report against the odd ones'; each has a metric that the other lacks."""
    ev = V.evaluated(runs(spark, sf_dir))
    return V.report_diff(V.long(V.summary(ev.where("qid % 2 = 0")), DIFFED), V.long(V.summary(ev.where("qid % 2 = 1")), [*DIFFED[1:], "score_mean"]))


@query(f"""WITH {EVAL}, a AS (SELECT {RATES} FROM ev WHERE qid % 2 = 0), b AS (SELECT {RATES} FROM ev WHERE qid % 2 = 1), m AS ({' UNION ALL '.join(f"SELECT '{x}' AS metric, a.{x}::DOUBLE AS old, b.{x}::DOUBLE AS new, {g}::DOUBLE AS margin FROM a, b" for x, g in zip(DIFFED, (0.03, 0.03, 0.05)))})
SELECT metric, old, new, round(coalesce(old, 0) - margin, 4) AS threshold, coalesce(new, 0) >= round(coalesce(old, 0) - margin, 4) AS passed FROM m""")
def smoke_verdict(spark, sf_dir):
    ev = V.evaluated(runs(spark, sf_dir))
    return V.verdict(V.long(V.summary(ev.where("qid % 2 = 0")), DIFFED), V.long(V.summary(ev.where("qid % 2 = 1")), DIFFED), list(zip(DIFFED, (0.03, 0.03, 0.05), strict=True)))


@query(f"""WITH {RUNS}, b AS (SELECT qid, CASE WHEN qid % 5 = 2 THEN 'partial' ELSE mode END AS mode, route, n_citations + (qid % 7 = 0)::INT AS n_citations FROM runs) SELECT a.qid, list_filter([CASE WHEN a.mode <> b.mode THEN 'mode' END, CASE WHEN a.n_citations <> b.n_citations THEN 'n_citations' END], lambda x: x IS NOT NULL) AS changed FROM runs a JOIN b USING (qid) WHERE a.mode <> b.mode OR a.n_citations <> b.n_citations""")
def run_diff(spark, sf_dir):
    a = runs(spark, sf_dir).select("qid", "mode", "route", "n_citations")
    b = a.withColumns({"mode": F.when(F.col("qid") % 5 == 2, "partial").otherwise(F.col("mode")), "n_citations": F.col("n_citations") + (F.col("qid") % 7 == 0).cast("int")})
    return V.run_diff(a, b, "qid", ["mode", "route", "n_citations"])


@query(f"""WITH {EVAL}, s AS (SELECT *, n_support = 0 OR n_candidates = 0 OR n_citations = 0 OR (route = 'comparison' AND branch_count > 0 AND covered_branches = 0) OR coalesce(refusal_reason = 'weak_evidence', false) AS sound, (dhit AND n_support > 0) OR n_candidates > 0 OR coalesce(refusal_reason = 'covered_branch_but_refuse', false) AS wrong FROM ev)
SELECT qid, CASE WHEN mode <> 'refuse' THEN 'none' WHEN sound THEN 'reasonable' WHEN wrong THEN 'false' ELSE 'unclassified' END AS refusal FROM s""")
def refusal_class(spark, sf_dir):
    return V.refusals(V.evaluated(runs(spark, sf_dir))).select("qid", "refusal")


@query(f"""WITH {RUNS}, b AS (SELECT qid, qid % 3 AS pf, list_filter(['A', 'B', 'C'], lambda l: list_contains(doc_ids, (qid + CASE l WHEN 'A' THEN 0 WHEN 'B' THEN 7 ELSE 9 END)::VARCHAR)) AS covered FROM runs)
SELECT qid, 3::BIGINT AS branch_count, covered, list_filter(['A', 'B'], lambda l: NOT list_contains(covered, l)) AS missing, round(len(covered) / 3::DOUBLE + 1e-9, 4) AS doc_coverage, pf > 0 AND len(covered) >= pf AS partial_allowed FROM b""")
def branch_metrics(spark, sf_dir):
    return V.branch_metrics(runs(spark, sf_dir))


@query("SELECT bucket, n, dim FROM (SELECT (doc_id % 4)::VARCHAR AS bucket, count(*) AS n, 'citations' AS dim FROM labels GROUP BY 1 UNION ALL SELECT CASE doc_id % 5 WHEN 0 THEN 'refuse' WHEN 1 THEN 'partial' ELSE 'full' END, count(*), 'mode' FROM labels GROUP BY 1)")
def distributions(spark, sf_dir):
    r = runs(spark, sf_dir)
    return V.distribution(r, "n_citations").withColumn("dim", F.lit("citations")).unionByName(V.distribution(r, "mode").withColumn("dim", F.lit("mode")))


RULES = [("Title", "Abstract"), ("Results", "Discussion"), ("Discussion", "Results")]


@query(f"""WITH {RUNS}, r(e, a) AS (VALUES {', '.join(map(str, RULES))}), x AS (SELECT qid, unnest(expected_sections) AS e FROM runs), f AS (SELECT qid, e AS s FROM x UNION SELECT qid, r.a FROM x JOIN r USING (e)), h AS (SELECT DISTINCT f.qid FROM f JOIN (SELECT qid, unnest(sections) AS s FROM runs) t ON f.qid = t.qid AND f.s = t.s)
SELECT DISTINCT qid, qid IN (SELECT qid FROM h) AS matched FROM x""")
def section_theta_match(spark, sf_dir):
    r = runs(spark, sf_dir)
    rules = spark.createDataFrame(RULES, "expected string, actual string")
    return V.section_match(r.select("qid", F.explode("expected_sections").alias("section")), r.select("qid", F.explode("sections").alias("section")), rules)


FACTS = """f0 AS (SELECT item_id AS qid, list_filter(list_transform(regexp_split_to_array(text, '[.;!?\\n。；！？]+'), lambda s: trim(s)), lambda s: length(s) >= 12) AS fs FROM benchmark), f1 AS (SELECT qid, unnest(range(len(fs))) AS fact_no, unnest(fs) AS fact FROM f0)"""
NORM = "trim(regexp_replace(replace(translate(lower({}), '′’‘–—−_', '''''''--- '), 'fig.', 'figure '), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"
FT = "list_distinct(regexp_extract_all(lower(fact), '[a-z0-9][a-z0-9_+''-]{2,}'))"
PRESENT = f"""{S.QUESTIONS}, {DOC_BM25}, ctx AS (SELECT qid, {NORM.format("string_agg(text, chr(10) ORDER BY bm25_rank)")} AS c FROM b JOIN documents USING (doc_id) WHERE bm25_rank <= 3 GROUP BY qid), {FACTS}, f2 AS (SELECT *, {FT} AS t FROM f1 LEFT JOIN ctx USING (qid)), f3 AS (SELECT *, CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda v: contains(c, v))) / len(t)::DOUBLE ELSE 0 END AS p FROM f2),
facts AS (SELECT qid, fact_no, fact, CASE WHEN contains(c, {NORM.format('fact')}) THEN 'exact' WHEN p >= 0.55 THEN 'terms' ELSE 'missing' END AS why FROM f3)"""


def present(spark, sf_dir):
    best = bm25_docs(spark, sf_dir).where("bm25_rank <= 3").join(document_rows(spark, sf_dir), "doc_id")
    contexts = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("bm25_rank", "text"))).alias("p")).select("qid", F.array_join(F.transform("p", lambda v: v["text"]), "\n").alias("context"))
    return V.fact_presence(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("reference")), contexts)


@query(f"WITH {PRESENT} SELECT qid, fact_no, fact, why <> 'missing' AS present, why FROM facts")
def fact_presence(spark, sf_dir):
    """Each sentence of an item against its three best documents."""
    return present(spark, sf_dir)


@query(f"WITH {PRESENT} SELECT qid, count(*) AS n_facts, sum((why <> 'missing')::INT)::BIGINT AS n_covered, round(avg((why <> 'missing')::INT) + 1e-9, 4) AS coverage FROM facts GROUP BY qid")
def evidence_coverage(spark, sf_dir):
    return V.coverage(present(spark, sf_dir))


@query(f"WITH {S.QUESTIONS}, {DOC_BM25}, x AS (SELECT qid, min(CASE WHEN source IN ('src1', 'src2', 'src3') THEN bm25_rank END) AS first_rank FROM b JOIN documents USING (doc_id) GROUP BY qid) SELECT qid, first_rank, CASE WHEN first_rank <= 5 THEN 'pass' WHEN first_rank IS NOT NULL THEN 'partial' ELSE 'fail' END AS grade FROM x")
def first_hit_rank(spark, sf_dir):
    rows = bm25_docs(spark, sf_dir).join(document_rows(spark, sf_dir), "doc_id")
    return V.first_hit_rank(rows.withColumnRenamed("bm25_rank", "rank"), F.col("source").isin("src1", "src2", "src3"), 5)


@query("""WITH m AS (SELECT doc_id AS qid, unnest(['dense', 'hybrid', 'rerank']) AS mode, unnest([CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 + 1 END, doc_id % 7 + 1, doc_id % 5 + 2]) AS r, unnest([2, 1, 0]) AS p FROM labels)
SELECT qid, first(mode ORDER BY coalesce(r, 1000000) <= 3 DESC, coalesce(r, 1000000), p) AS best_mode FROM m GROUP BY qid""")
def best_mode(spark, sf_dir):
    d = F.col("doc_id")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), r.alias("first_rank"), F.lit(p).alias("priority")) for m, r, p in (("dense", F.when(d % 2 == 0, d % 9 + 1), 2), ("hybrid", d % 7 + 1, 1), ("rerank", d % 5 + 2, 0))])
    return V.best_mode(table(spark, sf_dir, "labels").select(d.alias("qid"), F.explode(modes).alias("m")).select("qid", "m.*"), 3)


@query("""WITH x AS (SELECT doc_id AS qid, quality = 1 AS ic, CASE WHEN doc_id % 3 > 0 THEN doc_id % 20 END AS h, CASE WHEN doc_id % 4 > 0 THEN doc_id % 15 END AS r FROM labels) SELECT qid, CASE WHEN NOT ic THEN 'target_not_in_corpus' WHEN h IS NULL THEN 'not_retrieved' WHEN (r IS NULL OR r > 5) AND h <= 5 THEN 'rerank_demoted' WHEN r IS NULL OR r > 5 THEN 'ranked_too_low' ELSE 'ok' END AS failure_reason FROM x""")
def failure_reason(spark, sf_dir):
    d = F.col("doc_id")
    x = table(spark, sf_dir, "labels").select(d.alias("qid"), (F.col("quality") == 1).alias("in_corpus"), F.when(d % 3 > 0, d % 20).alias("hybrid_rank"), F.when(d % 4 > 0, d % 15).alias("rerank_rank"))
    return V.failure_reason(x, 5).select("qid", "failure_reason")


@query(f"""WITH {RUNS} SELECT 'repeated_id' AS "check", (SELECT count(*) FROM (SELECT qid FROM runs GROUP BY qid HAVING count(*) > 1)) AS n UNION ALL SELECT 'missing_id', (SELECT count(*) FROM runs WHERE qid IS NULL) UNION ALL SELECT 'gap_in_ids', (SELECT max(qid) - min(qid) + 1 - count(DISTINCT qid) FROM runs)
UNION ALL SELECT 'empty_mode', 0 UNION ALL SELECT 'empty_refusal_reason', (SELECT count(*) FROM runs WHERE refusal_reason IS NULL) UNION ALL SELECT 'invalid_route', (SELECT count(*) FROM runs WHERE route NOT IN ('comparison', 'summary'))""")
def dataset_constraints(spark, sf_dir):
    return V.constraints(runs(spark, sf_dir), ["mode", "refusal_reason"], {"route": ["comparison", "summary"]})


SUBSET = [30, 7, 999_999, 12, 7]


@query(f"WITH w AS (SELECT unnest({SUBSET}) AS qid, unnest(range({len(SUBSET)})) AS place), d AS (SELECT item_id AS qid, text FROM benchmark) SELECT w.qid::BIGINT AS qid, place, text FROM w LEFT JOIN d USING (qid)")
def diagnostic_subset(spark, sf_dir):
    return V.subset(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), SUBSET)


# --- sessions, audit, table changes, sets


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def session_last_n(spark, sf_dir):
    return sinks.last_turns(table(spark, sf_dir, "conversations"), 6, "conv_id", "turn")


@query("SELECT conv_id, count(*) AS turns, sum((role = 'user')::INT)::BIGINT AS user_turns, first(text ORDER BY turn) AS first_text, last(text ORDER BY turn) AS last_text FROM conversations GROUP BY conv_id")
def session_summary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum((F.col("role") == "user").cast("long")).alias("user_turns"), F.min_by("text", "turn").alias("first_text"), F.max_by("text", "turn").alias("last_text"))


@query(f"""WITH {S.CHUNKS}, fresh AS (SELECT * REPLACE (text || ' (new)' AS text, CASE WHEN chunk_index % 2 = 0 THEN NULL ELSE page_start END AS page_start) FROM chunks WHERE source_file = 'src1'), n AS (SELECT * REPLACE (coalesce(page_start, -1) AS page_start) FROM fresh)
SELECT chunk_id, doc_id, page_start, text FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM n) UNION ALL SELECT chunk_id, doc_id, page_start, text FROM n""")
def upsert_latest(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir)
    fresh = rows.where("source_file = 'src1'").withColumns({"text": F.concat("text", F.lit(" (new)")), "page_start": F.when(F.col("chunk_index") % 2 == 0, None).otherwise(F.col("page_start"))})
    return sinks.upserted(rows, fresh).select("chunk_id", "doc_id", "page_start", "text")


@query(f"WITH {S.CHUNKS} SELECT chunk_id, doc_id, text FROM chunks WHERE source_file IS DISTINCT FROM 'src1' UNION ALL SELECT chunk_id || 'n', doc_id, lower(text) FROM chunks WHERE source_file = 'src1' AND chunk_index < 2")
def rebuild_anti_union(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir).select("chunk_id", "doc_id", "chunk_index", "text")
    ids = table(spark, sf_dir, "documents").where("source = 'src1'").select("doc_id")
    fresh = rows.where("chunk_index < 2").withColumns({"chunk_id": F.concat("chunk_id", F.lit("n")), "text": F.lower("text")})
    return sinks.rebuilt(rows, fresh, ids)[0].select("chunk_id", "doc_id", "text")


@query(f"WITH {S.CHUNKS}, o AS (SELECT doc_id, count(*) AS o, sum((chunk_index < 2)::INT)::BIGINT AS n FROM chunks GROUP BY doc_id) SELECT d.doc_id, coalesce(o, 0) AS old, coalesce(n, 0) AS new FROM documents d LEFT JOIN o USING (doc_id)")
def rebuild_changes(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir)
    return sinks.rebuilt(rows, rows.where("chunk_index < 2"), table(spark, sf_dir, "documents").select("doc_id"))[1]


@query(f"WITH {S.CHUNKS} SELECT chunk_id, [w FOR w IN [CASE WHEN length(chunk_id) > 128 THEN 'chunk_id_too_long' END, CASE WHEN length(text) > 2000 THEN 'text_too_long' END] IF w IS NOT NULL] AS why FROM chunks WHERE length(text) > 2000 OR length(chunk_id) > 128")
def schema_violations(spark, sf_dir):
    return sinks.checked(chunk_rows(spark, sf_dir), {"chunk_id": 128, "text": 2000}).select("chunk_id", "why")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def audit_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, list_sort(json_keys(props)) AS keys FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array_sort(F.json_object_keys("props")).alias("keys"))


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM s)
SELECT user_id, session_no::BIGINT AS session_no, min(ts) AS started, count(*) AS n FROM n GROUP BY user_id, session_no""")
def user_sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOURS")
    x = table(spark, sf_dir, "events").withColumn("_new", F.when(gap, 0).otherwise(1))
    x = x.withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return x.groupBy("user_id", "session_no").agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, sum(value) AS value, event_id FROM (SELECT user_id, event_type, round(value, 6) AS value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3 GROUP BY ALL")
def top_events(spark, sf_dir):
    x = top(table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 3)
    return x.select("user_id", "event_type", F.round("value", 6).alias("value"), "event_id")


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels) UNION ALL SELECT 'union_all', count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM labels)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels)""")
def set_ops(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return count("union", a.union(b).distinct()).unionByName(count("union_all", a.union(b))).unionByName(count("intersect", a.intersect(b))).unionByName(count("except", a.exceptAll(b).distinct()))


@query(f"""WITH {RUNS} SELECT qid, list_distinct(doc_ids || expected_doc_ids) AS ordered_union, list_filter(expected_doc_ids, lambda x: NOT list_contains(doc_ids, x)) AS missing FROM runs""")
def array_sets(spark, sf_dir):
    return runs(spark, sf_dir).select("qid", F.array_union("doc_ids", "expected_doc_ids").alias("ordered_union"), F.array_except("expected_doc_ids", "doc_ids").alias("missing"))


ORACLES["array_sets"] = f"""WITH {RUNS} SELECT qid, doc_ids || list_filter(expected_doc_ids, lambda x: NOT list_contains(doc_ids, x)) AS ordered_union, list_filter(expected_doc_ids, lambda x: NOT list_contains(doc_ids, x)) AS missing FROM runs"""


@query(f"""WITH {S.QUESTIONS}, {DOC_BM25} SELECT qid, d.doc_id, bm25_rank, source, lang, quality, toxic FROM b JOIN documents d USING (doc_id) LEFT JOIN labels USING (doc_id)""")
def ranked_lookup_joins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return bm25_docs(spark, sf_dir).drop("bm25_score").join(docs, "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query(f"""WITH {S.CHUNKS}, w AS (SELECT chunk_id, doc_id, chunk_index, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_\\x{{4e00}}-\\x{{9fff}}]{{2,}}')) AS t FROM chunks), p AS (SELECT a.chunk_id, b.chunk_id AS next_id, round(len(list_intersect(a.t, b.t)) / greatest(1, least(len(a.t), len(b.t)))::DOUBLE, 6) AS overlap FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.chunk_index = a.chunk_index + 1) SELECT * FROM p""")
def near_dup_overlap(spark, sf_dir):
    """Shared words of each chunk and the next, by the smaller set."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    x = chunk_rows(spark, sf_dir).select("chunk_id", "doc_id", "chunk_index", T.long_words("text").alias("_t"))
    x = x.withColumns({"next_id": F.lead("chunk_id").over(w), "_n": F.lead("_t").over(w)}).where("next_id is not null")
    return x.select("chunk_id", "next_id", F.round(F.size(F.array_intersect("_t", "_n")) / F.greatest(F.lit(1), F.least(F.size("_t"), F.size("_n"))), 6).alias("overlap"))


# --- generic relational coverage over the order tables


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def revenue_rollup(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).select("n_name", "r_name", "n", "revenue")


del questions

"""Queries of reranking, neighbours and evidence over the stand-in hits, each with its SQL where SQL can express it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.session import stored
from ..operators import assessment as A
from ..operators import evidence as E
from ..operators import neighbors as N
from ..operators import rerank as K
from ..operators import retrieval as R
from . import sql as S
from .engine import Library, ask
from .retrieval_queries import HITS, PROSE, PROSE_SETTINGS, X, document_rows, hits, marker_sql, questions, runs, served

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


WL = S.word_list
HEAD2 = "concat_ws(chr(10), 'title: ' || nullif(title, ''), 'section: ' || nullif(section, ''), 'source_file: ' || nullif(source_file, ''), 'doc_id: ' || doc_id, text)"
STRATEGY = " + ".join(f"CASE WHEN {S.any_of('lower(question)', g)} AND {S.any_of('lower(concat_ws(chr(10), title, section, substr(text, 1, 800)))', g)} THEN 0.1 ELSE 0 END" for g in X.strategies)
SECTION = "CASE WHEN contains(lower(section), 'result') THEN 0.35 WHEN contains(lower(section), 'discussion') THEN 0.28 WHEN lower(section) = 'abstract' THEN 0 WHEN contains(lower(section), 'introduction') THEN -0.05 ELSE 0 END"


def evidence_sql(x) -> str:
    return f"CASE WHEN regexp_matches({HEAD2}, '[0-9]') THEN 0.2 ELSE 0 END + CASE WHEN {S.any_of(f'lower({HEAD2})', x.result)} THEN 0.22 ELSE 0 END + CASE WHEN {S.any_of(f'lower({HEAD2})', x.definition)} THEN 0.06 ELSE 0 END + {SECTION}"


HYBRID = "greatest(vector_score, fusion_score, bm25_score * 0.1)"
RERANKED = f"""{HITS}, scored AS (SELECT * EXCLUDE (rank), round({HYBRID} * 0.7 + least(len(list_intersect(list_distinct({WL('lower(question)')}), list_distinct({WL(f'lower({HEAD2})')}))), 10) * 0.03 + {STRATEGY} + {evidence_sql(PROSE)} + 1e-9, 6) AS rerank_score FROM hits),
reranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, {HYBRID} DESC, chunk_id) AS rank FROM scored)"""


def reranked(spark, sf_dir):
    return K.by_rerank(K.heuristic(hits(spark, sf_dir), PROSE_SETTINGS))


@query(f"WITH {RERANKED} SELECT qid, chunk_id, rerank_score, rank FROM reranked")
def rerank_heuristic(spark, sf_dir):
    return reranked(spark, sf_dir).select("qid", "chunk_id", "rerank_score", "rank")


def shared_words(question: pd.Series, text: pd.Series) -> pd.Series:
    """A stand-in for a cross-encoder: shared white-space words by the question's."""
    out = [len(set(q.lower().split()) & set(t.lower().split())) / max(1, len(set(q.lower().split()))) for q, t in zip(question, text, strict=True)]
    return pd.Series(out, dtype="float64")


WORDS_OF = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> '')"
PAIR = f"len(list_intersect(list_distinct({WORDS_OF.format('vq')}), list_distinct({WORDS_OF.format('text')}))) / greatest(1, len(list_distinct({WORDS_OF.format('vq')})))::DOUBLE"


@query(f"""WITH {HITS}, pairs AS (SELECT *, unnest([question, title]) AS vq, unnest([0, 1]) AS variant FROM hits), sc AS (SELECT qid, chunk_id, max({PAIR}) AS mx, avg({PAIR}) AS av, list(round({PAIR} + 1e-9, 6) ORDER BY variant) AS query_scores FROM pairs GROUP BY qid, chunk_id)
SELECT qid, chunk_id, round(mx + 0.15 * av + {STRATEGY} + {evidence_sql(PROSE)} + {marker_sql()} + 1e-9, 6) AS rerank_score, query_scores FROM hits JOIN sc USING (qid, chunk_id)""")
def rerank_aggregate(spark, sf_dir):
    """A model's scores of two variants of the question (itself, the chunk's title as a question) put together."""
    h = hits(spark, sf_dir)
    pairs = h.select("qid", "chunk_id", "text", F.posexplode(F.array("question", "title")).alias("variant", "question"))
    scores = K.model_scores(pairs, shared_words).select("qid", "chunk_id", "variant", "score")
    out = K.aggregated(h, scores, R.marker_boost(F.col("question"), F.col("text")), PROSE_SETTINGS)
    return out.select("qid", "chunk_id", "rerank_score", "query_scores")


@query(f"WITH {RERANKED} SELECT qid, chunk_id, rerank_score FROM (SELECT *, max(rerank_score) OVER (PARTITION BY qid) AS best FROM reranked) WHERE best <= 0 OR rerank_score >= best * 0.9")
def relative_floor(spark, sf_dir):
    return K.above_floor(reranked(spark, sf_dir), 0.9).select("qid", "chunk_id", "rerank_score")


def fifth(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN 0 AND 1 THEN {x} ELSE greatest(0, least(1, {x} / 5)) END"


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace(translate(lower({x}), '′’‘–—−_', '''''''--- '), 'fig.', 'figure '), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"


BARE = "regexp_replace({}, '[\\s/_-]+', '', 'g')"
STOP = "('" + "', '".join(X.stop_words) + "')"
ANCHOR = "('" + "', '".join(X.anchor_words) + "')"
GUARDED = f"""{RERANKED}, prof AS (SELECT DISTINCT qid, question AS q0, {norm('question')} AS nq FROM hits),
prof2 AS (SELECT qid, nq, CASE WHEN {S.any_of('nq', X.table)} THEN 'table' WHEN {S.any_of('nq', X.figure)} THEN 'figure' ELSE 'body' END AS kind, regexp_extract_all(nq, '\\b(?:table)\\s*([a-z]?\\d+)\\b', 1) AS tables, regexp_extract_all(nq, '\\b(?:figure|fig\\.?)\\s*([a-z]?\\d+)\\b', 1) AS figures,
  regexp_extract_all(nq, '[a-z0-9][a-z0-9''._-]+') AS found FROM prof),
prof3 AS (SELECT qid, kind, tables, figures, list_transform(tables, lambda v: 'table ' || v) || list_transform(figures, lambda v: 'figure ' || v) || list_filter(found, lambda t: t NOT IN {STOP} AND length({BARE.format('t')}) > 1 AND (regexp_matches(t, '[0-9]') OR contains(t, '-') OR {BARE.format('t')} IN {ANCHOR} OR length({BARE.format('t')}) >= 5)) AS an FROM prof2),
g0 AS (SELECT r.*, p.kind, p.tables, p.figures, list_distinct(an) AS anchors, {norm(HEAD2)} AS nt, {BARE.format(norm(HEAD2))} AS ct, lower({HEAD2}) AS low, {HYBRID} AS h FROM reranked r JOIN prof3 p USING (qid)),
g1 AS (SELECT *, CASE WHEN len(anchors) = 0 THEN 0 ELSE len(list_filter(anchors, lambda a: contains(nt, a) OR contains(ct, regexp_replace(a, '[ /_-]+', '', 'g')) OR contains(replace(nt, '''', ''), replace(a, '''', '')))) / len(anchors)::DOUBLE END AS keyword,
  CASE kind WHEN 'table' THEN least(1, CASE WHEN contains(low, '[table text]') THEN 0.7 ELSE 0 END + CASE WHEN contains(low, '[table caption]') THEN 0.4 ELSE 0 END) WHEN 'figure' THEN CASE WHEN contains(low, '[figure caption]') THEN 1 ELSE 0 END ELSE 0 END::DOUBLE AS marker,
  CASE kind WHEN 'table' THEN (len(list_filter(tables, lambda r: contains(low, 'table ' || r))) > 0)::INT WHEN 'figure' THEN (len(list_filter(figures, lambda r: contains(low, 'figure ' || r))) > 0)::INT ELSE 0 END::DOUBLE AS reference,
  CASE WHEN max(h) OVER w <= min(h) OVER w THEN 1 ELSE (h - min(h) OVER w) / (max(h) OVER w - min(h) OVER w) END AS hn, CASE WHEN max(rerank_score) OVER w <= min(rerank_score) OVER w THEN 1 ELSE (rerank_score - min(rerank_score) OVER w) / (max(rerank_score) OVER w - min(rerank_score) OVER w) END AS rn
  FROM g0 WINDOW w AS (PARTITION BY qid)),
g2 AS (SELECT *, round(CASE WHEN kind = 'body' THEN 0.4 * hn + 0.4 * rn + 0.15 * keyword ELSE 0.45 * hn + 0.15 * rn + 0.25 * keyword + 0.10 * least(1, marker + 0.3 * reference) - 0.18 * (CASE WHEN keyword < 0.35 THEN 1 ELSE 0 END + CASE WHEN marker <= 0 AND reference <= 0 THEN 0.35 ELSE 0 END) END + 1e-9, 6) AS guarded_score,
  round(CASE kind WHEN 'figure' THEN least(1, 0.2 * keyword + 0.35 * marker + 0.3 * reference + CASE WHEN contains(low, '[figure caption]') THEN 0.1 ELSE 0 END) WHEN 'table' THEN least(1, 0.4 * keyword + 0.2 * marker + 0.2 * reference + CASE WHEN contains(low, '[table caption]') THEN 0.12 ELSE 0 END + CASE WHEN contains(low, '[table text]') THEN 0.04 ELSE 0 END) ELSE 0.5 * keyword + 0.35 * reference END + 1e-9, 6) AS completeness,
  CASE kind WHEN 'table' THEN contains(low, '[table text]') AND keyword >= 0.55 AND (contains(low, '[table caption]') OR keyword >= 0.78) AND (reference >= 1 OR (len(tables) = 0 AND contains(low, '[table caption]'))) WHEN 'figure' THEN contains(low, '[figure caption]') AND reference >= 1 AND keyword >= 0.45 ELSE true END AS is_complete FROM g1),
guarded AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY guarded_score DESC, keyword DESC, marker DESC, chunk_id) AS grank FROM g2)"""


@query(f"WITH {GUARDED} SELECT qid, chunk_id, kind, round(keyword + 1e-9, 6) AS keyword, marker, reference, guarded_score, completeness, is_complete, grank AS rank FROM guarded")
def guarded_norm(spark, sf_dir):
    out = K.guarded(reranked(spark, sf_dir))
    return out.select("qid", "chunk_id", "kind", T.six("keyword").alias("keyword"), "marker", "reference", "guarded_score", "completeness", "is_complete", "rank")


@query(f"""WITH {GUARDED}, gf AS (SELECT *, first(completeness) OVER w AS c1, first(guarded_score) OVER w AS s1, first(is_complete) OVER w AS i1, first(reference) OVER w AS r1 FROM guarded WINDOW w AS (PARTITION BY qid ORDER BY grank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ga AS (SELECT *, grank > 1 AND kind IN ('table', 'figure') AND NOT i1 AND is_complete AND completeness - c1 >= 0.18 AND (guarded_score + CASE WHEN kind = 'figure' THEN 0.65 ELSE 0.2 END >= s1 OR (kind = 'table' AND reference > r1 AND completeness >= 0.95)) AS able FROM gf),
gb AS (SELECT *, first(CASE WHEN able THEN grank END) OVER (PARTITION BY qid ORDER BY able DESC, completeness DESC, grank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best FROM ga),
gp AS (SELECT *, coalesce(grank = best, false) AS promoted FROM gb)
SELECT qid, chunk_id, grank AS rank_before, row_number() OVER (PARTITION BY qid ORDER BY promoted DESC, grank) AS rank, promoted,
  CASE WHEN kind NOT IN ('table', 'figure') THEN 'intent_not_guarded' WHEN promoted THEN 'promoted_complete_evidence' WHEN grank > 1 THEN 'not_promoted' WHEN is_complete THEN 'top1_already_complete' WHEN best IS NOT NULL THEN 'demoted_incomplete_evidence' ELSE 'no_better_complete_evidence' END AS reason FROM gp""")
def rank1_guard(spark, sf_dir):
    return K.rank1_guard(K.guarded(reranked(spark, sf_dir))).select("qid", "chunk_id", "rank_before", "rank", "promoted", "reason")


@query()
def comparison_coverage_selection(spark, sf_dir):
    """Greedy choice over variants; the tests hold it against a plain loop."""
    h = reranked(spark, sf_dir).withColumn("query_scores", F.array("rerank_score", T.six(F.col("bm25_score") / 20), T.six(F.col("vector_score") * 1.2)))
    return K.comparison_coverage(h, 10)


GROUP = "CASE WHEN section IN ('Introduction', 'Background') THEN 'INTRO' WHEN section IN ('Methods') THEN 'METHOD' WHEN section = 'Results' THEN 'RESULT' WHEN section = 'Discussion' THEN 'DISCUSSION' WHEN section = 'Abstract' THEN 'ABSTRACT' WHEN section = 'Title' THEN 'TITLE' ELSE 'UNKNOWN' END"


@query(f"""WITH {RERANKED}, x0 AS (SELECT qid, chunk_id, doc_id, rank, rank <= 10 AS shown, {GROUP} AS g FROM reranked WHERE rank <= 15),
x1 AS (SELECT *, g IN ('INTRO', 'METHOD', 'RESULT', 'DISCUSSION') AS body, g IN ('RESULT', 'DISCUSSION') AS strong, CASE g WHEN 'TITLE' THEN 0 WHEN 'ABSTRACT' THEN 1 END AS front FROM x0),
bd AS (SELECT qid, doc_id, bool_or(shown AND body) AS has_body, min(CASE WHEN shown AND front IS NOT NULL THEN front * 1000 + rank END) % 1000 AS victim, min(CASE WHEN NOT shown AND body THEN (NOT strong)::INT * 1000 + rank END) % 1000 AS fresh FROM x1 GROUP BY qid, doc_id),
bs AS (SELECT qid, min(victim * 1000 + fresh) AS vf FROM bd WHERE NOT has_body AND victim IS NOT NULL AND fresh IS NOT NULL GROUP BY qid)
SELECT x.qid, chunk_id, doc_id, CASE WHEN rank = vf % 1000 THEN vf // 1000 ELSE rank END AS place, coalesce(rank = vf % 1000, false) AS swapped_in FROM x1 x LEFT JOIN bs USING (qid) WHERE coalesce(rank = vf % 1000, false) OR (shown AND NOT coalesce(rank = vf // 1000, false))""")
def body_coverage(spark, sf_dir):
    return K.body_coverage(reranked(spark, sf_dir), 10)


SEEDS = f"{RERANKED}, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id) - 1 AS pos FROM chunks), seeds AS (SELECT r.*, p.pos FROM reranked r JOIN placed p USING (chunk_id) WHERE rank <= 8)"


def seeds(spark, sf_dir):
    """The eight best hits of each question, as a table that a plan may read many times."""
    return stored(reranked(spark, sf_dir).where(F.col("rank") <= 8), "seeds")


def placed(spark, sf_dir, some):
    """The places of all chunks of the documents that some hits are from: no other document's chunks can be their neighbours."""
    return N.positions(served(spark, sf_dir).chunks.join(some.select("doc_id").distinct(), "doc_id", "left_semi"))


@query(f"""WITH {SEEDS}, w0 AS (SELECT s.qid, s.chunk_id AS seed_id, s.rank AS sr, s.rerank_score AS ss, p.chunk_id, p.doc_id, p.pos, p.pos - s.pos AS step, abs(p.pos - s.pos) * 2 - (p.pos < s.pos)::INT AS o FROM seeds s JOIN placed p ON s.doc_id = p.doc_id AND p.pos BETWEEN s.pos - 2 AND s.pos + 2),
w1 AS (SELECT * FROM w0 QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY sr, o) = 1), w2 AS (SELECT * FROM w1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sr, o) <= 30)
SELECT qid, chunk_id, doc_id, pos, seed_id, step <> 0 AS is_neighbor, round(CASE WHEN step <> 0 THEN greatest(ss - 0.01, 0) ELSE ss END + 1e-9, 6) AS rerank_score, row_number() OVER (PARTITION BY qid ORDER BY doc_id, pos) AS place FROM w2""")
def neighbor_window(spark, sf_dir):
    some = seeds(spark, sf_dir)
    return N.expand(some.select("qid", "chunk_id", "rank", "rerank_score"), placed(spark, sf_dir, some))


LONG = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_\\x{{4e00}}-\\x{{9fff}}]{{2,}}'))"
AUDIT = f"""{SEEDS}, n0 AS (SELECT s.qid, s.question, s.intent, s.chunk_id AS seed_id, s.rank AS sr, s.rerank_score AS ss, p.chunk_id, p.section, p.text, abs(p.pos - s.pos) AS distance, p.pos - s.pos AS step FROM seeds s JOIN placed p ON s.doc_id = p.doc_id AND abs(p.pos - s.pos) = 1 WHERE (s.qid, p.chunk_id) NOT IN (SELECT (qid, chunk_id) FROM seeds)),
n1 AS (SELECT * FROM n0 QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY distance, sr) = 1),
n2 AS (SELECT *, len(list_intersect({LONG.format('question')}, {LONG.format('text')})) AS overlap, lower(text) AS low FROM n1 QUALIFY row_number() OVER (PARTITION BY qid, seed_id ORDER BY distance, step, chunk_id) <= 2),
n3 AS (SELECT *, least(1.3, CASE WHEN regexp_matches(low, '[0-9]') THEN 0.3 ELSE 0 END + CASE WHEN {S.any_of('low', X.result)} THEN 0.3 ELSE 0 END + CASE WHEN contains(low, '[table text]') OR contains(low, '[table caption]') THEN 0.2 ELSE 0 END + CASE WHEN contains(low, '[figure caption]') OR contains(low, 'fig.') THEN 0.1 ELSE 0 END + CASE WHEN section IN ('Results', 'Discussion', 'Abstract') THEN 0.2 ELSE 0 END + CASE WHEN overlap >= 2 THEN 0.2 ELSE 0 END) AS bonus FROM n2),
n4 AS (SELECT *, round(least(ss * 0.45 + bonus * ss * 0.1, ss * 0.45 * 1.3) + 1e-9, 6) AS neighbor_score FROM n3),
audit AS (SELECT qid, chunk_id, seed_id, distance, overlap, neighbor_score, section, CASE WHEN length(text) < 50 THEN 'text_too_short' WHEN section IN ('Title', 'Introduction') AND overlap < 3 THEN 'weak_section_insufficient_overlap' WHEN neighbor_score < 0.05 THEN 'score_below_floor' WHEN NOT overlap >= 2 THEN 'no_semantic_signal' ELSE 'semantic_and_score_passed' END AS reason FROM n4),
audited AS (SELECT *, CASE reason WHEN 'text_too_short' THEN 'excluded' WHEN 'semantic_and_score_passed' THEN 'dry_run_promoted' ELSE 'context_only' END AS status FROM audit)"""


def audited(spark, sf_dir):
    some = seeds(spark, sf_dir)
    return N.audit(some.select("qid", "chunk_id", "rank", "rerank_score"), placed(spark, sf_dir, some), R.routed(questions(spark, sf_dir)))


@query(f"WITH {AUDIT} SELECT qid, chunk_id, seed_id, distance, overlap, neighbor_score, status, reason, section FROM audited")
def neighbor_audit(spark, sf_dir):
    return audited(spark, sf_dir)


@query(f"WITH {AUDIT}, rd AS (SELECT unnest(['status', 'section', 'reason', 'distance']) AS dim, unnest([status, section, reason, distance::VARCHAR]) AS bucket, neighbor_score FROM audited) SELECT dim, bucket, count(*) AS n, round(avg(neighbor_score) + 1e-9, 6) AS mean_score FROM rd GROUP BY dim, bucket")
def neighbor_audit_rollup(spark, sf_dir):
    return N.audit_rollup(audited(spark, sf_dir))


PROSE_RESULT = "(^|[^a-z])(result|yield|tion|ment|edst|ener)([^a-z]|$)"
RES = f"regexp_matches(lower(text), '{PROSE_RESULT}')"
LEDGER = f"""{SEEDS}, ledger AS (SELECT *, 'E' || rank AS evidence_id, lower(trim(section)) AS section_type, length(text) AS text_length, contains(lower(text), '[table text]') OR contains(lower(text), 'table_text') AS has_table_text, contains(lower(text), '[table caption]') OR contains(lower(text), 'table_caption') AS has_table_caption,
  contains(lower(text), '[figure caption]') OR contains(lower(text), 'fig.') OR contains(lower(text), 'figure_caption') AS has_figure_caption, regexp_matches(text, '[0-9]') AS has_numeric, {RES} AS has_result_terms FROM seeds)"""


def ledger_rows(spark, sf_dir):
    return E.ledger(seeds(spark, sf_dir), PROSE_RESULT)


@query(f"WITH {LEDGER} SELECT qid, evidence_id, chunk_id, section_type, text_length, has_table_text, has_table_caption, has_figure_caption, has_numeric, has_result_terms FROM ledger")
def evidence_ledger(spark, sf_dir):
    return ledger_rows(spark, sf_dir).select("qid", "evidence_id", "chunk_id", "section_type", "text_length", "has_table_text", "has_table_caption", "has_figure_caption", "has_numeric", "has_result_terms")


TABQ, FIGQ = "regexp_matches(lower(question), '\\btable\\b|\\btab\\.|表')", "regexp_matches(lower(question), '\\bfig(ure|\\.)|图')"


def unit(x: str) -> str:
    return f"CASE WHEN {x} BETWEEN 0 AND 1 THEN {x} ELSE 1 / (1 + exp(-({x}))) END"


BEST3 = "greatest(rerank_score, vector_score, fusion_score)"
SUPPORT = f"""{LEDGER}, sup0 AS (SELECT *, round(len(list_intersect({LONG.format('question')}, {LONG.format('text')})) / greatest(len({LONG.format('question')}), 1)::DOUBLE + 1e-9, 6) AS query_overlap FROM ledger),
support AS (SELECT *, round({unit(BEST3)} + CASE WHEN contains(section_type, 'result') THEN 0.25 WHEN contains(section_type, 'discussion') THEN 0.18 WHEN contains(section_type, 'abstract') THEN 0.08 ELSE 0 END + 0.08 * has_numeric::INT + 0.10 * has_result_terms::INT + 0.18 * has_table_text::INT + 0.14 * has_table_caption::INT + 0.14 * has_figure_caption::INT
  + least(query_overlap * 0.3, 0.3) + CASE WHEN {TABQ} AND (has_table_text OR has_table_caption) THEN 0.3 ELSE 0 END + CASE WHEN {FIGQ} AND has_figure_caption THEN 0.3 ELSE 0 END + 1e-9, 6) AS support_score FROM sup0)"""


def supported(spark, sf_dir):
    return E.support(ledger_rows(spark, sf_dir))


@query(f"WITH {SUPPORT} SELECT qid, evidence_id, query_overlap, support_score FROM support WHERE support_score >= 0")
def support_scores(spark, sf_dir):
    return supported(spark, sf_dir).select("qid", "evidence_id", "query_overlap", "support_score")


FACTOID = f"{SUPPORT}, chosen AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN {TABQ} THEN has_table_text OR has_table_caption WHEN {FIGQ} THEN has_figure_caption ELSE true END DESC, support_score DESC, rank) AS place FROM support QUALIFY place <= 3)"


@query(f"WITH {FACTOID} SELECT qid, evidence_id, chunk_id, support_score, place FROM chosen")
def support_factoid(spark, sf_dir):
    return E.factoid(supported(spark, sf_dir)).select("qid", "evidence_id", "chunk_id", "support_score", "place")


PRIO = "CASE WHEN contains(lower(section), 'result') THEN 1 WHEN contains(lower(section), 'discussion') THEN 2 WHEN contains(lower(section), 'abstract') THEN 3 WHEN contains(lower(section), 'introduction') THEN 4 ELSE 5 END"


@query(f"""WITH {SUPPORT}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {PRIO}, has_result_terms DESC, has_numeric DESC, support_score DESC, rank) AS summary_rank, count(*) OVER (PARTITION BY qid) AS n FROM support)
SELECT qid, evidence_id, summary_rank, CASE WHEN contains(section_type, 'title') THEN 'low_value_section' WHEN text_length < 12 THEN 'too_short' WHEN query_overlap > 0 OR {PRIO} <= 4 OR has_result_terms OR has_numeric OR has_table_text OR has_table_caption OR has_figure_caption OR summary_rank <= greatest(2, least(4, n)) THEN 'pass' ELSE 'low_quality' END AS quality FROM r""")
def summary_quality(spark, sf_dir):
    return E.summary_quality(supported(spark, sf_dir)).select("qid", "evidence_id", "summary_rank", "quality")


@query()
def support_summary(spark, sf_dir):
    """Greedy and diverse; the tests hold it against fixtures."""
    return E.summary(E.summary_quality(supported(spark, sf_dir)))


CMP = S.OBJECTS
BRANCHES = f"""{SUPPORT}, br0 AS (SELECT qid, {CMP} AS p FROM routed WHERE intent = 'comparison'), br AS (SELECT qid, unnest(p[1:4]) AS branch, unnest(range(least(4, len(p)))) AS branch_no FROM br0 WHERE len(p) >= 2),
br1 AS (SELECT b.*, list_distinct(regexp_extract_all(lower(branch), '[a-z0-9][a-z0-9_+''-]{{2,}}')) AS terms, s.evidence_id, s.chunk_id, s.section, s.support_score, lower(concat_ws(chr(10), s.title, s.section, s.text)) AS hay, lower(s.title) AS lt FROM br b JOIN support s USING (qid)),
br2 AS (SELECT *, list_filter(terms, lambda t: contains(hay, t)) AS m FROM br1), br3 AS (SELECT *, len(m) AS n_matched, len(list_filter(m, lambda t: regexp_matches(t, '[0-9]'))) AS ent, len(list_filter(m, lambda t: length(t) >= 5)) AS spec FROM br2),
pairs AS (SELECT qid, branch_no, branch, evidence_id, chunk_id, n_matched, support_score, round(least(least(greatest(support_score, 0), 1.5) * 0.18 + least(ent * 0.18, 0.36) + least(spec * 0.16, 0.48) + CASE WHEN section = 'Results' THEN 0.1 WHEN section = 'Discussion' THEN 0.06 WHEN section = 'Abstract' THEN 0.04 ELSE 0 END + CASE WHEN len(list_filter(m, lambda t: contains(lt, t))) > 0 THEN 0.08 ELSE 0 END, 1), 4) AS confidence,
  CASE WHEN spec >= 2 OR (ent >= 1 AND spec >= 1) THEN 'direct' WHEN spec >= 1 OR ent >= 1 THEN 'indirect' ELSE 'missing' END AS status FROM br3),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY qid, branch_no ORDER BY CASE status WHEN 'direct' THEN 2 WHEN 'indirect' THEN 1 ELSE 0 END DESC, confidence DESC, support_score DESC, evidence_id) = 1),
cov AS (SELECT qid, branch_no, branch, evidence_id, confidence, CASE WHEN shared THEN 'indirect' ELSE status END AS status, shared FROM (SELECT *, status = 'direct' AND count(*) OVER (PARTITION BY qid, evidence_id, status = 'direct') > 1 AS shared FROM best))"""


def branch_pairs(spark, sf_dir):
    return E.branch_support(E.branches(R.routed(questions(spark, sf_dir))), supported(spark, sf_dir))


@query(f"WITH {BRANCHES} SELECT * FROM pairs")
def branch_support(spark, sf_dir):
    return branch_pairs(spark, sf_dir)


@query(f"WITH {BRANCHES} SELECT * FROM cov")
def branch_coverage(spark, sf_dir):
    return E.branch_coverage(branch_pairs(spark, sf_dir))


@query(f"""WITH {BRANCHES}, lead0 AS (SELECT * FROM pairs WHERE status <> 'missing' QUALIFY row_number() OVER (PARTITION BY qid, branch_no ORDER BY CASE status WHEN 'direct' THEN 2 ELSE 1 END DESC, confidence DESC, support_score DESC, evidence_id) = 1),
ld AS (SELECT qid, evidence_id, min(branch_no) AS ld FROM lead0 GROUP BY ALL), y AS (SELECT s.qid, s.evidence_id, s.support_score, s.rank AS r, ld, row_number() OVER (PARTITION BY qid, doc_id ORDER BY ld IS NULL, support_score DESC, s.rank) AS nth FROM support s LEFT JOIN ld USING (qid, evidence_id))
SELECT qid, evidence_id, support_score, row_number() OVER (PARTITION BY qid ORDER BY ld NULLS LAST, nth, support_score DESC, r) AS place FROM y QUALIFY place <= 6""")
def support_comparison(spark, sf_dir):
    scored = stored(supported(spark, sf_dir), "scored")  # read twice, so the search is made once
    pairs = E.branch_support(E.branches(R.routed(questions(spark, sf_dir))), scored)
    return E.comparison(scored, pairs).select("qid", "evidence_id", "support_score", "place")


EXIST_WORDS = X.existence


def listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


LOOSE = listed([p for p in X.core_phrases if " " in p or not p.isascii()])
ENTITY = f"NOT list_contains({listed(X.generic_terms)}, t) AND (regexp_matches(t, '^[A-Z0-9-]{{2,}}$') OR NOT list_contains({LOOSE}, t))"
EXISTS = f"""{FACTOID}, ex0 AS (SELECT qid, {S.any_of('lower(question)', EXIST_WORDS)} AS asks_existence, list_distinct(list_filter({listed(X.core_phrases)}, lambda t: contains(lower(regexp_replace(question, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')), lower(t))) || regexp_extract_all(question, '\\b(?:[A-Z][A-Z0-9-]+|mRNA)\\b')) AS t FROM routed),
ex1 AS (SELECT qid, count(*) AS n, lower(string_agg(concat_ws(' ', title, section, text), ' ')) AS x FROM chosen GROUP BY qid),
ex2 AS (SELECT qid, asks_existence, t AS ts, coalesce(n, 0) AS n_support, list_filter(t, lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z0-9-]{{2,}}$') THEN regexp_matches(coalesce(x, ''), '\\b' || lower(t) || '\\b') ELSE contains(coalesce(x, ''), lower(t)) END) AS ms FROM ex0 LEFT JOIN ex1 USING (qid)),
exist AS (SELECT qid, asks_existence, round(CASE WHEN len(ts) > 0 THEN len(ms) / len(ts)::DOUBLE ELSE 0 END + 1e-9, 6) AS term_part, n_support,
  len(ts) > 0 AND len(ms) * 5 >= len(ts) * 3 AND (len(list_filter(ts, lambda t: {ENTITY})) = 0 OR len(list_filter(ms, lambda t: {ENTITY})) > 0) AND len(ms) > len(list_filter(ms, lambda t: {ENTITY})) AS strong FROM ex2)"""
EXIST_STATUS = "CASE WHEN n_support = 0 THEN 'none' WHEN strong THEN 'strong' ELSE 'weak' END AS support_status"


def chosen(spark, sf_dir):
    return E.factoid(supported(spark, sf_dir))


@query(f"WITH {EXISTS} SELECT qid, asks_existence, term_part, n_support, {EXIST_STATUS} FROM exist")
def existence_gate(spark, sf_dir):
    return E.existence(R.routed(questions(spark, sf_dir)), chosen(spark, sf_dir))


PLAN = BRANCHES + EXISTS[len(SUPPORT):] + f"""
, per AS (SELECT qid, count(*) AS n, count(DISTINCT doc_id) AS docs, bool_and(section = 'Abstract') AS abs_, bool_or(has_table_text OR has_table_caption) AS tab, bool_or(has_figure_caption) AS fig FROM chosen GROUP BY qid),
pcv AS (SELECT qid, count(*) AS branches, sum((status = 'direct')::INT) AS dir, sum((status = 'indirect')::INT) AS ind, bool_or(shared) AS sh FROM cov GROUP BY qid),
pl0 AS (SELECT r.qid, r.question, r.intent, coalesce(n, 0) AS n, coalesce(docs, 0) AS docs, coalesce(abs_, false) AS abs_, coalesce(tab, false) AS tab, coalesce(fig, false) AS fig, coalesce(branches, 0) AS branches, coalesce(dir, 0) AS dir, coalesce(ind, 0) AS ind, coalesce(sh, false) AS sh, asks_existence, {EXIST_STATUS} FROM routed r LEFT JOIN per USING (qid) LEFT JOIN pcv USING (qid) LEFT JOIN exist e USING (qid)),
pl1 AS (SELECT *, CASE WHEN n = 0 THEN CASE WHEN asks_existence THEN 'existence_no_support' WHEN intent = 'summary' THEN 'summary_no_support' ELSE 'no_support_pack' END WHEN asks_existence AND support_status = 'weak' THEN 'existence_weak_support'
  WHEN ({TABQ} OR {FIGQ}) AND (({TABQ} AND tab) OR ({FIGQ} AND fig)) THEN 'structured_evidence_found' WHEN {TABQ} OR {FIGQ} THEN 'missing_explicit_structured_evidence' WHEN intent IN ('factoid', 'unknown') THEN 'factoid_supported' WHEN intent = 'summary' AND n = 1 THEN 'summary_support_count' WHEN intent = 'summary' AND abs_ THEN 'summary_abstract_only'
  WHEN intent = 'summary' AND docs = 1 THEN 'summary_single_doc_limited' WHEN intent = 'summary' THEN 'summary_multi_support' WHEN intent = 'experiment' THEN 'experiment_queries_only_allow_summary' WHEN branches = 0 THEN 'comparison_evidence_incomplete' WHEN sh THEN 'shared_evidence_limited_comparison' WHEN dir = branches THEN 'direct_all_branches_independent'
  WHEN dir > 0 AND ind > 0 THEN 'branch_partial_support' WHEN dir > 0 THEN 'comparison_branch_coverage' ELSE 'comparison_indirect_support' END AS reason FROM pl0),
plans AS (SELECT qid, intent, CASE WHEN n = 0 THEN 'refuse' WHEN reason IN ('factoid_supported', 'summary_multi_support') OR (reason = 'structured_evidence_found' AND NOT dir + ind < branches) THEN 'full' ELSE 'partial' END AS mode, reason, n AS n_support, greatest(branches - dir - ind, 0)::BIGINT AS missing_branches FROM pl1)"""


def planned(spark, sf_dir):
    plans, picked, _ = planned_with_coverage(spark, sf_dir)
    return plans, picked


def planned_with_coverage(spark, sf_dir):
    routes = R.routed(questions(spark, sf_dir))
    scored = stored(supported(spark, sf_dir), "scored")  # read by all that follows
    picked = stored(E.factoid(scored), "picked")
    coverage = E.branch_coverage(E.branch_support(E.branches(routes), scored))
    return E.plan(routes, picked, coverage, E.existence(routes, picked)), picked, coverage


@query(f"WITH {PLAN} SELECT * FROM plans")
def answer_plan(spark, sf_dir):
    return planned(spark, sf_dir)[0]


def squeeze(x: str, n: int) -> str:
    y = f"trim(regexp_replace({x}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"
    return f"CASE WHEN length({y}) <= {n} THEN {y} ELSE rtrim(substr({y}, 1, {n - 3})) || '...' END"


ANSWER = f"""{PLAN}, li AS (SELECT qid, string_agg({squeeze('text', 160)} || ' [' || evidence_id || ']', ' ' ORDER BY place) AS l FROM chosen WHERE place <= 3 GROUP BY qid),
answers AS (SELECT qid, mode, CASE WHEN mode = 'refuse' OR l IS NULL THEN '{E.REFUSAL.replace("'", "''")}' ELSE CASE WHEN mode = 'partial' THEN 'Limited evidence: ' ELSE '' END || l END AS answer FROM plans LEFT JOIN li USING (qid))"""


@query(f"WITH {ANSWER} SELECT * FROM answers")
def extractive_answer(spark, sf_dir):
    plans, picked = planned(spark, sf_dir)
    return E.extractive_answers(plans, picked)


CITE = f"""{ANSWER}, mk AS (SELECT qid, unnest(list_distinct(m)) AS evidence_id, m, answer FROM (SELECT qid, answer, regexp_extract_all(answer, '\\[(E\\d+)\\]', 1) AS m FROM answers)),
cites AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY list_position(m, evidence_id)) AS citation_no, evidence_id, chunk_id, doc_id, {squeeze('text', 1200)} AS quote FROM mk JOIN chosen USING (qid, evidence_id))"""


@query(f"WITH {CITE} SELECT * FROM cites")
def citation_bind(spark, sf_dir):
    plans, picked = planned(spark, sf_dir)
    return E.bind_citations(E.extractive_answers(plans, picked), picked)


@query(f"""WITH {CITE}, nc AS (SELECT qid, count(*) AS n FROM cites GROUP BY qid), v AS (SELECT p.*, a.answer, coalesce(n, 0) AS n_citations, p.mode <> 'refuse' AND coalesce(n, 0) = 0 AS bare FROM plans p JOIN answers a USING (qid) LEFT JOIN nc USING (qid))
SELECT qid, CASE WHEN bare THEN 'refuse' WHEN mode = 'full' AND missing_branches > 0 THEN 'partial' ELSE mode END AS mode, CASE WHEN bare THEN 'post_generation_zero_citation_refuse' ELSE reason END AS reason, CASE WHEN bare THEN '{E.REFUSAL.replace("'", "''")}' ELSE answer END AS answer, n_citations FROM v""")
def final_validate(spark, sf_dir):
    plans, picked = planned(spark, sf_dir)
    answers = E.extractive_answers(plans, picked)
    return E.validated(plans, answers, E.bind_citations(answers, picked))


MARKS = "list_distinct(regexp_extract_all(answer, '\\[(E\\d+)\\]', 1))"
LOOSE_NUMBERS = f"list_filter({S.NUMBERS.format(chr(114) + 'egexp_replace(answer, ' + chr(39) + chr(92) + '[E' + chr(92) + 'd+' + chr(92) + ']' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, lambda n: NOT contains(lower(replace(coalesce(txt, ''), ' ', '')), n))"
FLAGS = f"""{ANSWER}, al AS (SELECT qid, list(evidence_id) AS ids, string_agg(text, chr(10)) AS txt FROM chosen GROUP BY qid), cvg AS (SELECT qid, list(evidence_id) FILTER (status <> 'missing') AS allowed, list(evidence_id) FILTER (status = 'direct') AS direct, bool_or(status = 'indirect') AS indirect FROM cov GROUP BY qid),
fl0 AS (SELECT a.qid, a.mode, a.answer, p.reason, p.missing_branches, coalesce(ids, []) AS ids, txt, coalesce(allowed, []) AS allowed, coalesce(direct, []) AS direct, coalesce(indirect, false) AS indirect, {MARKS} AS marks FROM answers a JOIN plans p USING (qid) LEFT JOIN al USING (qid) LEFT JOIN cvg USING (qid)),
fl1 AS (SELECT *, len(allowed) > 0 AND mode IN ('full', 'partial') AS subset, {S.any_of('lower(answer)', [w.lower() for w in X.overclaims])} AS over FROM fl0)"""


def flag(when: str, name: str) -> str:
    return f"CASE WHEN {when} THEN '{name}' END"


FLAG_LIST = ", ".join([
    flag("len(list_filter(marks, lambda m: NOT list_contains(ids, m))) > 0", "invalid_citation_ids"), flag("subset AND len(list_filter(marks, lambda m: NOT list_contains(allowed, m))) > 0", "comparison_disallowed_citation"), flag("length(answer) > 1200", "output_too_long"),
    flag("mode <> 'refuse' AND len(marks) = 0", "missing_citations"), flag("subset AND len(list_filter(direct, lambda m: NOT list_contains(marks, m))) > 0", "missing_direct_branch_citation"), flag("mode = 'partial' AND over", "partial_overclaim"),
    flag(f"mode = 'partial' AND (over OR NOT {S.any_of('answer', X.partial_limits)})", "partial_abstention_tone"), flag(f"reason = 'existence_weak_support' AND {S.any_of('answer', X.existence_overclaims)}", "existence_overclaim"),
    flag(f"missing_branches > 0 AND NOT {S.any_of('answer', X.branch_limits)}", "missing_branch_limit_not_disclosed"), flag(f"indirect AND NOT {S.any_of('answer', X.indirect_limits)}", "indirect_branch_limit_not_disclosed"),
    flag(f"reason = 'existence_weak_support' AND NOT {S.any_of('answer', X.existence_disclaimers)}", "missing_existence_weak_disclaimer"), flag(f"len({LOOSE_NUMBERS}) > 0", "unsupported_number"), flag("mode = 'refuse' AND len(marks) > 0", "refusal_with_citation"),
])


@query(f"WITH {FLAGS} SELECT qid, list_filter([{FLAG_LIST}], lambda x: x IS NOT NULL) AS flags FROM fl1")
def answer_flags(spark, sf_dir):
    """The checks of a rewritten answer, here of the extractive one, whose set of citations can't have changed."""
    plans, picked, coverage = planned_with_coverage(spark, sf_dir)
    answers = E.extractive_answers(plans, picked)
    return E.answer_flags(answers, picked, plans, coverage, answers)


@query(f"WITH {FACTOID} SELECT qid, evidence_id, row_number() OVER (PARTITION BY qid ORDER BY place) AS citation_rank FROM chosen QUALIFY citation_rank <= CASE intent WHEN 'factoid' THEN 4 WHEN 'summary' THEN 8 WHEN 'comparison' THEN 10 ELSE 6 END")
def citation_budget(spark, sf_dir):
    return E.citation_budget(chosen(spark, sf_dir)).select("qid", "evidence_id", "citation_rank")


@query(f"""WITH {RERANKED}, c AS (SELECT qid, avg({unit(BEST3)}) AS a, count(DISTINCT doc_id) AS d FROM reranked WHERE rank <= 3 GROUP BY qid), e AS (SELECT qid, round(least(a + least(d * 0.05, 0.15), 0.99) + 1e-9, 6) AS confidence FROM c) SELECT *, confidence < 0.58 AS needs_external FROM e""")
def confidence_top3(spark, sf_dir):
    return E.confidence(reranked(spark, sf_dir))


SIGTOK = f"list_filter(list_distinct({S.tok('question')}), lambda t: length(t) > 1)"
SIGTXT = "concat_ws(' ', title, section, substr(text, 1, 800))"


@query(f"""WITH {RERANKED}, x AS (SELECT qid, {fifth('rerank_score')} AS s, len(list_intersect({SIGTOK}, list_distinct({S.tok(SIGTXT)}))) / greatest(len({SIGTOK}), 1)::DOUBLE AS o,
  (regexp_matches(lower(text), '[0-9]')::INT + {S.any_of('lower(text)', PROSE.result)}::INT + {S.any_of('lower(text)', PROSE.definition)}::INT) / 3::DOUBLE AS f FROM reranked WHERE rank <= 5),
p AS (SELECT qid, round(avg(s) + 1e-9, 6) AS mean_score, round(max(o) + 1e-9, 6) AS overlap, round(avg(f) + 1e-9, 6) AS features FROM x GROUP BY qid)
SELECT *, CASE WHEN 0.4 * mean_score + 0.35 * overlap + 0.25 * features >= 0.55 THEN 'strong' WHEN 0.4 * mean_score + 0.35 * overlap + 0.25 * features >= 0.35 THEN 'partial' ELSE 'none' END AS grade FROM p""")
def evidence_signals(spark, sf_dir):
    return E.signals(reranked(spark, sf_dir), PROSE_SETTINGS)


ESW = f"len(list_intersect({LONG.format('question')}, {LONG.format('sentence')})) / greatest(len({LONG.format('question')}), 1)::DOUBLE"
ESN = f"CASE WHEN len({S.NUMBERS.format('question')}) > 0 THEN len(list_intersect({S.NUMBERS.format('question')}, {S.NUMBERS.format('sentence')})) / greatest(len({S.NUMBERS.format('question')}), 1)::DOUBLE ELSE 0 END"


@query(f"""WITH {SEEDS}, es0 AS (SELECT qid, question, chunk_id, rerank_score, {S.sentences('text')} AS l FROM seeds), es1 AS (SELECT qid, question, chunk_id, rerank_score, unnest(l) AS sentence, unnest(range(len(l))) AS n FROM es0),
es2 AS (SELECT qid, chunk_id, sentence, n, round(0.40 * {ESW} + 0.35 * {ESN} + 0.25 * ({fifth('rerank_score')}) + 1e-9, 6) AS score FROM es1), es3 AS (SELECT * FROM es2 WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY qid, sentence ORDER BY score DESC, chunk_id, n) = 1)
SELECT qid, chunk_id, sentence, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id, n) AS place FROM es3 QUALIFY place <= 5""")
def evidence_sentences(spark, sf_dir):
    return E.evidence_sentences(seeds(spark, sf_dir))


@query(f"""WITH {SEEDS}, l AS (SELECT qid, rank, '[' || rank || '] doc ' || doc_id || ' / ' || section || chr(10) || text AS l, CASE WHEN intent = 'summary' THEN printf('%02d', {PRIO}) ELSE printf('%020d', doc_id) END AS o FROM seeds)
SELECT qid, substr(string_agg(l, chr(10) || chr(10) ORDER BY o, rank), 1, 32000) AS context, count(*) AS n_chunks FROM l GROUP BY qid""")
def context_builder(spark, sf_dir):
    return E.contexts(seeds(spark, sf_dir))


# --- the older assessment, lookups, the whole engine


NAMED = " + ".join(f"{S.any_of('lower(question)', names)}::INT" for names, _ in X.named_branches)
MET = " + ".join(f"({S.any_of('lower(question)', names)} AND len(list_filter(xs, lambda v: {S.any_of('v', words)})) > 0)::INT" for names, words in X.named_branches)
ASSESS = f"""{RERANKED}, as0 AS (SELECT qid, avg({fifth(BEST3)}) AS s, count(DISTINCT doc_id) AS d, avg({S.any_of("lower(concat_ws(' ', title, substr(text, 1, 400)))", X.negative)}::INT) AS neg, list(lower(concat_ws(' ', title, substr(text, 1, 600)))) AS xs, bool_or(len(regexp_extract_all({norm('question')}, '\\b(?:table)\\s*([a-z]?\\d+)\\b', 1)) > 0) AS asks,
  round(max(len(list_intersect({SIGTOK}, list_distinct({S.tok(SIGTXT)}))) / greatest(len({SIGTOK}), 1)::DOUBLE) + 1e-9, 6) AS o, round(avg((regexp_matches(lower(text), '[0-9]')::INT + {S.any_of('lower(text)', X.result)}::INT + {S.any_of('lower(text)', X.definition)}::INT) / 3::DOUBLE) + 1e-9, 6) AS f FROM reranked WHERE rank <= 5 GROUP BY qid),
ms AS (SELECT qid, bool_or(contains(lower(text), 'table 1') AND contains(lower(text), '[table')) AS ok FROM reranked GROUP BY qid),
as1 AS (SELECT r.qid, r.intent, r.question, s, d, neg, o, f, xs, asks AND NOT ok AS m, CASE intent WHEN 'summary' THEN 0.32 WHEN 'comparison' THEN 0.30 ELSE 0.34 END AS least_score, CASE WHEN intent IN ('summary', 'comparison') THEN 0.44 ELSE 0.46 END AS partial_below,
  CASE WHEN intent = 'comparison' AND xs IS NOT NULL AND {NAMED} > 0 THEN ({MET}) / ({NAMED})::DOUBLE ELSE 1.0 END AS cov FROM routed r LEFT JOIN as0 USING (qid) LEFT JOIN ms USING (qid)),
as2 AS (SELECT *, CASE WHEN s IS NULL THEN 'empty_support_refuse' WHEN m THEN 'missing_structured_reference' WHEN s < least_score OR (o < 0.05 AND f < 0.32) THEN 'weak_evidence' WHEN intent = 'comparison' AND cov < 0.40 THEN 'comparison_branch_coverage' WHEN intent = 'comparison' AND d = 1 THEN 'comparison_single_doc' ELSE '' END AS reason FROM as1),
assessed AS (SELECT qid, intent, CASE WHEN reason IN ('empty_support_refuse', 'missing_structured_reference', 'weak_evidence') THEN 'none' WHEN reason <> '' OR neg > 0.55 OR s < partial_below OR (o < 0.1 AND f < 0.5) THEN 'partial' ELSE 'strong' END AS level, reason <> '' AS refuse, reason,
  round(coalesce(s, 0) + 1e-9, 6) AS mean_score, round(coalesce(o, 0) + 1e-9, 6) AS overlap, round(coalesce(f, 0) + 1e-9, 6) AS features, round(cov + 1e-9, 6) AS coverage, round(coalesce(neg, 0) + 1e-9, 6) AS negative FROM as2)"""


@query(f"WITH {ASSESS} SELECT * FROM assessed")
def evidence_assessment(spark, sf_dir):
    return A.assessed(R.routed(questions(spark, sf_dir)), reranked(spark, sf_dir))


@query(f"""WITH {GUARDED}, sc AS (SELECT qid, chunk_id, rank, round({fifth(BEST3)} + 0.35 * CASE WHEN len(anchors) > 0 THEN len(list_filter(anchors, lambda a: contains(lower(text), a))) / len(anchors)::DOUBLE ELSE 0 END
  + CASE kind WHEN 'table' THEN CASE WHEN contains(lower(text), '[table text]') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(text), '[table caption]') THEN 0.2 ELSE 0 END WHEN 'figure' THEN CASE WHEN contains(lower(text), '[figure caption]') THEN 0.4 ELSE 0 END ELSE 0 END
  + CASE WHEN len(list_filter(tables, lambda r: contains(lower(text), 'table ' || r))) + len(list_filter(figures, lambda r: contains(lower(text), 'figure ' || r))) > 0 THEN 0.45 ELSE 0 END - rank * 1e-6 + 1e-9, 6) AS support_score FROM g0)
SELECT qid, chunk_id, support_score, row_number() OVER (PARTITION BY qid ORDER BY support_score DESC, rank) AS place FROM sc QUALIFY place <= 5""")
def support_chunks(spark, sf_dir):
    return A.support_chunks(reranked(spark, sf_dir)).select("qid", "chunk_id", "support_score", "place")


@query(f"WITH {RERANKED} SELECT qid, chunk_id, r.rank, d.dense_rank, b.bm25_rank FROM (SELECT qid, chunk_id, rank FROM reranked WHERE rank <= 10) r LEFT JOIN (SELECT qid, chunk_id, dense_rank FROM d) d USING (qid, chunk_id) LEFT JOIN (SELECT qid, chunk_id, bm25_rank FROM b) b USING (qid, chunk_id)")
def rank_lookups(spark, sf_dir):
    """Where each final hit stood in the two runs."""
    _, _, d, b = runs(spark, sf_dir)
    final = reranked(spark, sf_dir).where("rank <= 10").select("qid", "chunk_id", "rank")
    out = A.with_ranks(final, {"dense": d.withColumnRenamed("dense_rank", "rank"), "bm25": b.withColumnRenamed("bm25_rank", "rank")})
    return out


@query(f"WITH {RERANKED} SELECT qid, list(chunk_id ORDER BY rank) AS chunk_ids, list(rerank_score ORDER BY rank) AS scores FROM reranked WHERE rank <= 3 GROUP BY qid")
def first_hits(spark, sf_dir):
    rows = A.first_hits(reranked(spark, sf_dir), "rerank_score")
    return rows.select("qid", F.transform("hits", lambda h: h["chunk_id"]).alias("chunk_ids"), F.transform("hits", lambda h: h["score"]).alias("scores"))


@query()
def engine_answers(spark, sf_dir):
    """The engine as a user calls it: a library from all documents, all questions asked at once."""
    library = Library.build(document_rows(spark, sf_dir))
    return ask(questions(spark, sf_dir), library)["answers"]

"""Queries of text functions, readers, writers and lookups over the driver tables, each with its SQL."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Lexicon
from ..functions.session import scratch
from ..operators import assessment as A
from ..operators import retrieval as R
from ..sources import readers, sinks
from . import sql as S
from .engine import Library
from .retrieval_queries import chunk_rows, document_rows, questions, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
X = Lexicon()


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


TEXTS = "texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
WS = "[ \\t\\n\\v\\f\\r]+"


def listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# --- text


@query(f"WITH {S.CHUNKS} SELECT chunk_id, CASE WHEN chunk_index = 0 THEN NULL ELSE page_start END AS page FROM chunks")
def page_sentinel(spark, sf_dir):
    """A page of -1 is none."""
    return chunk_rows(spark, sf_dir).select("chunk_id", T.page_or_null(F.when(F.col("chunk_index") == 0, -1).otherwise(F.col("page_start"))).alias("page"))


@query("""WITH x AS (SELECT vec_id, (embedding[1]::DOUBLE * 8) AS v FROM embeddings WHERE embedding[1] IS NOT NULL) SELECT vec_id, round(CASE WHEN v BETWEEN 0 AND 1 THEN v ELSE 1 / (1 + exp(-v)) END + 1e-9, 6) AS unit, round(CASE WHEN v BETWEEN 0 AND 1 THEN v ELSE greatest(0, least(1, v / 5)) END + 1e-9, 6) AS fifth FROM x""")
def normalised_scores(spark, sf_dir):
    """Scores on any scale brought to 0..1 in the two ways, here of a vector's first component."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", (F.get("embedding", F.lit(0)).cast("double") * 8).alias("v")).where("v is not null")
    return x.select("vec_id", T.six(T.unit_score(F.col("v"))).alias("unit"), T.six(T.fifth_score(F.col("v"))).alias("fifth"))


NUM = "CASE WHEN contains({0}, '.') THEN regexp_replace(regexp_replace({0}, '^0+(\\d)', '\\1'), '\\.?0*$', '') ELSE regexp_replace({0}, '^0+(\\d)', '\\1') END"
UNIT = "CASE WHEN {0} IN ('hr', 'hour', 'hours') THEN 'h' WHEN {0} IN ('time', 'times', 'x') THEN 'fold' ELSE {0} END"
PART = "regexp_extract(x, '{}', {})"
RANGE_, SINGLE = rf"\b(\d+(?:\.\d+)?)\s*(?:-|~|to)\s*(\d+(?:\.\d+)?)\s*({T.UNITS})$", rf"^(\d+(?:\.\d+)?)\s*({T.UNITS})?$"


@query(f"""WITH {TEXTS} SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '{T.ENTITY}') || regexp_extract_all(lower(text), '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}(?:酶|酸|菌|家族|转运体|转运蛋白|通道|泵|系统)'))) AS entities FROM texts""")
def entity_names(spark, sf_dir):
    """Names of enzymes, genes and compounds by their form."""
    return document_rows(spark, sf_dir).select("doc_id", T.entities("text").alias("entities"))


NUMBER_TEXT = "'item ' || item_id || ': 0' || (item_id % 7) || '.50 - ' || (item_id % 11) || '.0 g/l, ' || item_id || ' hours, 3x, ' || (item_id % 5) || ' to ' || (item_id % 9) || ' %'"


@query("""WITH b AS (SELECT item_id, (item_id % 7)::VARCHAR || '.5' AS a, (item_id % 11)::VARCHAR AS b, (item_id % 5)::VARCHAR AS c, (item_id % 9)::VARCHAR AS d FROM benchmark)
SELECT item_id, list_sort(list_distinct([a || 'g/l', b || 'g/l', a || '-' || b || 'g/l', c || '%', d || '%', c || '-' || d || '%', item_id::VARCHAR, a, item_id || 'h', '3fold', c])) AS anchors FROM b""")
def number_ranges(spark, sf_dir):
    """Numbers with units in plain form, ranges with both ends; the text is made from the item's number."""
    i = F.col("item_id")
    part = lambda n: (i % n).cast("string")
    made = F.concat(F.lit("item "), i.cast("string"), F.lit(": 0"), part(7), F.lit(".50 - "), part(11), F.lit(".0 g/l, "), i.cast("string"), F.lit(" hours, 3x, "), part(5), F.lit(" to "), part(9), F.lit(" %"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.number_anchors(made).alias("anchors"))


@query(f"WITH {TEXTS}, l AS (SELECT doc_id, {S.sentences('text')} AS l FROM texts) SELECT doc_id, len(l) AS n, l AS sentences FROM l")
def sentence_split(spark, sf_dir):
    """Sentences of 24 characters or more, long ones by clauses."""
    x = document_rows(spark, sf_dir).select("doc_id", T.sentences("text").alias("sentences"))
    return x.select("doc_id", F.size("sentences").cast("long").alias("n"), "sentences")


@query(rf"""WITH {TEXTS} SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-z])-\n([a-z])', '\1\2', 'g'), '\n[ \t]*\n+', chr(1), 'g'), '[ \t]*\n[ \t]*', ' ', 'g'), chr(1), chr(10) || chr(10)) AS joined,
regexp_replace(text, '(?is)(^|\n)[ \t#]*(references|bibliography)[ \t]*\n.*$', '') AS body FROM texts""")
def cleaned_text(spark, sf_dir):
    """Words joined over line ends; the text before its references."""
    return document_rows(spark, sf_dir).select("doc_id", T.unbroken("text").alias("joined"), T.before_references("text").alias("body"))


@query(r"SELECT conv_id, turn, nullif(regexp_extract(coalesce('{' || text || '}', ''), '(?s)\{.*\}'), '') AS json FROM conversations")
def json_span(spark, sf_dir):
    """From the first opening to the last closing brace of what a model says."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.first_json(F.concat(F.lit("{"), "text", F.lit("}"))).alias("json"))


CAPTIONED = "coalesce(text, '') || '. Figure ' || (doc_id % 9 + 1) || '. A caption. Table ' || (doc_id % 4 + 1) || ': cells'"


@query(rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({CAPTIONED}, '([.!?] )((?:Figure|Fig\.|Table) ?[A-Z]?\d+[.:|])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> '') AS l FROM documents),
e AS (SELECT doc_id, unnest(range(len(l))) AS part, unnest(l) AS text FROM p) SELECT doc_id, part, CASE WHEN regexp_matches(text, '^(Figure|Fig\.) ?[A-Z]?\d+') THEN 'figure_caption' WHEN regexp_matches(text, '^Table ?[A-Z]?\d+') THEN 'table_caption' ELSE 'paragraph' END AS kind, text FROM e""")
def caption_split(spark, sf_dir):
    """Inline captions cut from a paragraph; each document gets two."""
    made = F.concat(F.coalesce("text", F.lit("")), F.lit(". Figure "), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(". A caption. Table "), (F.col("doc_id") % 4 + 1).cast("string"), F.lit(": cells"))
    x = document_rows(spark, sf_dir).select("doc_id", F.posexplode(T.split_captions(made)).alias("part", "p"))
    return x.select("doc_id", F.col("part").cast("long").alias("part"), "p.kind", "p.text")


SECTION_NAMES = {
    "Abstract": "^(abstract|summary|摘要)$", "Introduction": "^(introduction|引言|前言)$", "Background": "^background$", "Results and Discussion": "^results? and discussions?$", "Methods": "^(materials? and methods?|methods?|experimental( section| procedures?)?|材料与方法)$",
    "Results": "^(results?|findings|结果)$", "Discussion": "^(discussions?|讨论)$", "Conclusion": "^(conclusions?|concluding remarks|结论)$", "Acknowledgements": "^acknowledge?ments?$", "References": "^(references|bibliography|literature cited|参考文献)$",
}
HEADS = ("2.1 Methods", "# ABSTRACT:", "Results and discussion", "3. Findings", "参考文献", "Concluding remarks.", "Acknowledgments", "Experimental procedures", "前言", "Other")


@query(f"""WITH {S.BLOCKS}, h AS (SELECT doc_id, ord, CASE WHEN ord % 2 = 0 THEN {listed(HEADS)}[((doc_id + ord) % {len(HEADS)} + 1)::INT] ELSE text END AS head FROM blocks),
n AS (SELECT *, lower(trim(regexp_replace(head, '^[#\\s]*(\\d+(\\.\\d+)*\\.?)?\\s*|[:.\\s]+$', '', 'g'))) AS s FROM h) SELECT doc_id, ord, CASE {' '.join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, p in SECTION_NAMES.items())} END AS section FROM n""")
def section_names(spark, sf_dir):
    """The usual section that a heading names; every other block is replaced by a heading."""
    from ..operators.corpus import blocks

    heads = F.element_at(F.array(*map(F.lit, HEADS)), ((F.col("doc_id") + F.col("ord")) % len(HEADS) + 1).cast("int"))
    return blocks(document_rows(spark, sf_dir)).select("doc_id", "ord", T.section_name(F.when(F.col("ord") % 2 == 0, heads).otherwise(F.col("text"))).alias("section"))


FORMS = ("Compare {0} and {1}.", "{0} vs. {1}?", "comparison between {0} and {1}", "What is {0}?", "比较 {0} 和 {1} 的作用", "两类：一类是{0}，另一类是{1}。", "Compare role and {1}", "")
PAIR = "(SELECT item_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL)"


def _sql_form(form: str) -> str:
    out = "'" + form.replace("{0}", "' || a || '").replace("{1}", "' || b || '") + "'"
    return out


def _branch_sql() -> str:
    edge = f"'{T.BRANCH_EDGE}'"

    def named(x: str) -> str:
        x = f"trim({x}, {edge})"
        for cut in T.BRANCH_CUTS:
            x = f"trim(regexp_replace({x}, '{cut}', ''), {edge})"
        return x

    generic = "(" + ", ".join(f"'{g}'" for g in X.generic_branches) + ")"

    def problem(x: str) -> str:
        low = f"lower(trim({x}))"
        parts = f"regexp_extract_all({low}, '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]+')"
        return f"CASE WHEN {low} = '' THEN 'empty_branch' WHEN {low} IN {generic} THEN 'generic_branch' WHEN length({x}) > 80 OR octet_length(encode({low})) > 120 THEN 'branch_too_long' WHEN regexp_matches({low}, '^[a-z0-9_.-]{{1,4}}$') THEN NULL WHEN length(array_to_string({parts}, '')) < 2 THEN 'branch_too_short' WHEN len(list_filter({parts}, lambda t: t NOT IN {generic})) = 0 THEN 'generic_branch' END"

    tried = " UNION ALL ".join(f"SELECT item_id, {i} AS k, {named(f'''regexp_extract(q, '{form}', 1)''')} AS l, {named(f'''regexp_extract(q, '{form}', 2)''')} AS r FROM q WHERE regexp_matches(q, '{form}')" for i, form in enumerate(T.BRANCH_FORMS))
    return f"""WITH p AS (SELECT item_id, coalesce(array_to_string(w[1:2], ' '), '') AS a, coalesce(array_to_string(w[3:4], ' '), '') AS b FROM {PAIR}),
f AS (SELECT item_id, [{', '.join(_sql_form(x) for x in FORMS)}][(item_id % {len(FORMS)} + 1)::INT] AS question FROM p), q AS (SELECT item_id, question, trim(trim(regexp_replace(question, '{WS}', ' ', 'g')), '？?。.') AS q FROM f),
t AS ({tried}), j AS (SELECT *, coalesce(CASE WHEN l = '' OR r = '' THEN 'empty_branch' WHEN l = r THEN 'duplicate_branch' END, {problem('l')}, {problem('r')}, 'ok') AS reason FROM t),
g AS (SELECT item_id, min(k) FILTER (reason = 'ok') AS k, arg_min(reason, k) AS first FROM j GROUP BY item_id)
SELECT q.item_id, question, CASE WHEN looks THEN j.l END AS "left", CASE WHEN looks THEN j.r END AS "right", CASE WHEN q = '' THEN 'empty_question' WHEN NOT looks THEN 'not_comparison_intent' WHEN g.k IS NOT NULL THEN 'ok' ELSE coalesce(g.first, 'no_supported_pattern') END AS reason
FROM (SELECT *, regexp_matches(q, '{T.COMPARING}') AS looks FROM q) q LEFT JOIN g USING (item_id) LEFT JOIN j ON j.item_id = q.item_id AND j.k = g.k"""


@query(_branch_sql())
def branch_pairs(spark, sf_dir):
    """The two branches of comparisons in all forms, made from each item's first words."""
    w = F.filter(F.split("text", " "), lambda x: x != "")
    x = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.array_join(F.slice(w, 1, 2), " ").alias("a"), F.array_join(F.slice(w, 3, 2), " ").alias("b"))

    def made(form: str) -> F.Column:
        out = F.lit(form)
        for mark, c in (("{0}", "a"), ("{1}", "b")):
            out = F.replace(out, F.lit(mark), F.col(c))
        return out

    x = x.select("item_id", F.element_at(F.array(*map(made, FORMS)), (F.col("item_id") % len(FORMS) + 1).cast("int")).alias("question"))
    return x.select("item_id", "question", T.branches("question").alias("_b")).select("item_id", "question", "_b.left", "_b.right", "_b.reason")


KEYS = ("the", "and of", "der-die", "q'x", "tion", "zzzz")
FORMS_OF = "list_distinct(list_filter([{0}, regexp_replace({0}, '[ \\t\\n\\v\\f\\r/_-]+', '', 'g'), replace({0}, '''', '')], lambda v: v <> ''))"


def normal_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(translate(lower({x}), '′’‘–—−_', '''''''--- '), 'fig.', 'figure '), '{WS}', ' ', 'g'))"


@query(f"""WITH {TEXTS}, n AS MATERIALIZED (SELECT doc_id, {normal_sql('text')} AS n FROM texts), f AS (SELECT doc_id, [n, regexp_replace(n, '[ \\t\\n\\v\\f\\r/_-]+', '', 'g'), replace(n, '''', '')] AS fs FROM n),
h AS (SELECT doc_id, list_filter({listed(KEYS)}, lambda k: len(list_filter({FORMS_OF.format(normal_sql('k'))}, lambda v: len(list_filter(fs, lambda g: contains(g, v))) > 0)) > 0) AS hits FROM f) SELECT doc_id, hits, len(hits) >= ceil({len(KEYS)} * 0.75) AS meets FROM h""")
def keyword_match(spark, sf_dir):
    """Keywords that a document has in some form, and whether they are three quarters of all."""
    keys = F.array(*map(F.lit, KEYS))
    return document_rows(spark, sf_dir).select("doc_id", T.keyword_hits("text", keys).alias("hits"), T.meets_keywords("text", keys).alias("meets"))


NAMES = {"thing one": ["der die", "the"], "thing two": ["die"]}


@query(f"WITH {TEXTS} SELECT doc_id, replace(replace(replace({normal_sql('text')}, 'der die', 'thing one'), 'die', 'thing two'), 'the', 'thing one') AS text FROM texts")
def canonical_names(spark, sf_dir):
    """Other names of a thing replaced by one, the longest first."""
    return document_rows(spark, sf_dir).select("doc_id", T.canonical("text", NAMES).alias("text"))


@query(f"WITH {TEXTS} SELECT doc_id, {S.letters('text')} AS v FROM texts")
def letter_vectors(spark, sf_dir):
    """The deterministic stand-in for an embedding."""
    return document_rows(spark, sf_dir).select("doc_id", T.letter_vector("text").alias("v"))


# --- claims, lookups


BIB = "(?i)\\bet al\\b|\\bdoi\\b|\\bvol\\.|\\bpp\\.|\\bjournal\\b|\\b(19|20)\\d\\d;|\\[\\d+\\]"
CLAIMS = f"""claims AS (SELECT doc_id AS qid, coalesce(text, '') || CASE doc_id % 4 WHEN 1 THEN ' et al. 2001; J. doi' WHEN 2 THEN ' et al' ELSE '' END AS fact, CASE WHEN doc_id % 5 = 0 THEN 'unclear' ELSE 'supported' END AS status, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE source END AS source FROM documents),
good AS (SELECT * FROM claims WHERE status = 'supported' AND coalesce(trim(source), '') <> '' AND NOT (len(regexp_extract_all(fact, '{BIB}')) >= 2 OR (len(regexp_extract_all(fact, '{BIB}')) >= 1 AND {S.wc('fact')} < 40)))"""


def claims(spark, sf_dir):
    i = F.col("doc_id")
    fact = F.concat(F.coalesce("text", F.lit("")), F.when(i % 4 == 1, " et al. 2001; J. doi").when(i % 4 == 2, " et al").otherwise(""))
    return document_rows(spark, sf_dir).select(i.alias("qid"), fact.alias("fact"), F.when(i % 5 == 0, "unclear").otherwise("supported").alias("status"), F.when(i % 7 == 0, " ").otherwise(F.col("source")).alias("source"))


@query(f"WITH {CLAIMS} SELECT qid, source FROM good")
def claim_filter(spark, sf_dir):
    """Claims that are supported, have a source and are no bibliography."""
    return A.valid_claims(claims(spark, sf_dir)).select("qid", "source")


@query(f"""WITH {S.QUESTIONS}, {CLAIMS}, i AS (SELECT qid, ['factoid', 'summary', 'comparison', 'unknown'][(qid % 4 + 1)::INT] AS intent FROM questions), c AS (SELECT qid % 9 AS qid FROM good)
SELECT i.qid, count(c.qid) AS n_claims, count(c.qid) >= CASE WHEN any_value(intent) = 'factoid' THEN 1 ELSE 2 END AS suffices FROM i LEFT JOIN c USING (qid) GROUP BY i.qid""")
def claims_suffice(spark, sf_dir):
    """One claim is enough for a fact, two for all else."""
    q = questions(spark, sf_dir).select("qid", F.element_at(F.array(*map(F.lit, ("factoid", "summary", "comparison", "unknown"))), (F.col("qid") % 4 + 1).cast("int")).alias("intent"))
    c = claims(spark, sf_dir)
    return A.claims_suffice(q, A.valid_claims(c).withColumn("qid", F.col("qid") % 9))


@query(f"WITH {S.CHUNKS} SELECT chunk_id, CASE WHEN chunk_index % 2 = 0 THEN title ELSE '[' || source_file || ']' END AS title, source_file AS origin FROM chunks")
def sidecar_join(spark, sf_dir):
    """Columns filled from a table by key where they are null."""
    rows = chunk_rows(spark, sf_dir)
    side = rows.select("chunk_id", F.concat(F.lit("["), "source_file", F.lit("]")).alias("title"), F.col("source_file").alias("origin"))
    bare = rows.select("chunk_id", F.when(F.col("chunk_index") % 2 == 0, F.col("title")).alias("title"))
    return A.with_sidecar(bare, side, ["title", "origin"]).select("chunk_id", "title", "origin")


SQUEEZED = f"lower(trim(regexp_replace(quote, '{WS}', ' ', 'g')))"


@query(f"""WITH {S.CHUNKS}, u AS (SELECT chunk_id, doc_id % 3 AS qid, substr(text, 1, 30) || CASE n WHEN 1 THEN '  ' ELSE '' END AS quote, (n * 7 + chunk_index) % 5 / 10::DOUBLE AS score FROM chunks, range(3) r(n)),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid, chunk_id, {SQUEEZED} ORDER BY score DESC, quote) = 1) SELECT qid, b.chunk_id, quote, score, c.section FROM b JOIN chunks c USING (chunk_id)""")
def evidence_units(spark, sf_dir):
    """Evidence units with their chunk's columns, one for each chunk and quote."""
    rows = chunk_rows(spark, sf_dir)
    units = rows.select("chunk_id", (F.col("doc_id") % 3).alias("qid"), "text", "chunk_index", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n"))
    quote = F.concat(F.substring("text", 1, 30), F.when(F.col("n") == 1, "  ").otherwise(""))
    units = units.select("qid", "chunk_id", quote.alias("quote"), (((F.col("n") * 7 + F.col("chunk_index")) % 5) / 10.0).alias("score"))
    return A.unique_units(units, rows).select("qid", "chunk_id", "quote", "score", "section")


@query("""WITH r AS (SELECT 'run_' || o_orderkey AS path, o_orderstatus AS dataset, o_orderdate AS modified FROM orders) SELECT dataset, arg_max(path, (modified, path)) AS path, max(modified) AS modified FROM r GROUP BY dataset""")
def baseline_report(spark, sf_dir):
    """The newest report of each dataset, here of orders by status."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderdate").alias("modified"))
    return A.latest_baseline(o)


@query("""WITH x AS (SELECT toxic = 1 AS due, quality = 0 AS did FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL), a AS (SELECT count(*) AS n, sum(due::INT)::BIGINT AS due, sum(did::INT)::BIGINT AS refused, sum((due AND did)::INT)::BIGINT AS "right", sum((NOT due AND did)::INT)::BIGINT AS wrong FROM x)
SELECT *, CASE WHEN due > 0 THEN round("right" / due::DOUBLE + 1e-9, 4) END AS recall, CASE WHEN refused > 0 THEN round("right" / refused::DOUBLE + 1e-9, 4) END AS precision FROM a""")
def abstention_rates(spark, sf_dir):
    """How often what should be refused was: toxic documents should, those of low quality were."""
    x = table(spark, sf_dir, "labels").dropna(subset=["toxic", "quality"])
    return A.abstention(x.select((F.col("toxic") == 1).alias("should_refuse"), F.when(F.col("quality") == 0, "refuse").otherwise("full").alias("mode")))


TERMS_OF = "list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9][a-z0-9_+''-]{2,}'))"


@query(f"""WITH br AS (SELECT item_id AS qid, item_id % 3 AS branch_no, {TERMS_OF} AS terms FROM benchmark b), s AS (SELECT d.doc_id % 50 AS qid, lower(d.text) AS x FROM documents d WHERE d.text IS NOT NULL),
m AS (SELECT qid, branch_no, round(max(CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(x, t))) / len(terms)::DOUBLE ELSE 0 END) + 1e-9, 6) AS best FROM br JOIN s USING (qid) GROUP BY qid, branch_no)
SELECT *, best >= 0.45 AS covered, best >= 0.2 AND best < 0.45 AS soft FROM m""")
def branch_matches(spark, sf_dir):
    """How well each branch is met by its question's support: items against the documents of the same number."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") % 3).alias("branch_no"), F.filter(T.terms("text"), lambda t: t.rlike("^[a-z0-9]")).alias("terms"))
    return A.branch_matches(b, document_rows(spark, sf_dir).where("text is not null").select((F.col("doc_id") % 50).alias("qid"), "text"))


def squeeze_sql(x: str, n: int) -> str:
    y = f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"
    return f"CASE WHEN length({y}) <= {n} THEN {y} ELSE rtrim(substr({y}, 1, {n - 3})) || '...' END"


@query(f"""WITH s AS (SELECT doc_id // 3 AS qid, doc_id % 3 + 1 AS place, coalesce(text, '') AS text FROM documents), m AS (SELECT DISTINCT qid, ['full', 'partial', 'refuse'][(qid % 3 + 1)::INT] AS mode FROM s),
l AS (SELECT qid, string_agg(place || '. ' || {squeeze_sql('text', 200)} || ' [' || place || ']', chr(10) ORDER BY place) AS l FROM s GROUP BY qid) SELECT qid, mode, CASE WHEN mode = 'refuse' THEN 'The library''s evidence is not enough to answer this question.' ELSE l END AS answer FROM m LEFT JOIN l USING (qid)""")
def structured_answers(spark, sf_dir):
    """Numbered lines of support, or the refusal: each three documents are a question's support."""
    q = F.floor(F.col("doc_id") / 3).cast("long").alias("qid")
    s = document_rows(spark, sf_dir).select(q, (F.col("doc_id") % 3 + 1).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    modes = s.select("qid", F.element_at(F.array(F.lit("full"), F.lit("partial"), F.lit("refuse")), (F.col("qid") % 3 + 1).cast("int")).alias("mode")).distinct()
    return A.structured_answers(modes, s)


def _extract(prompt: pd.Series) -> pd.Series:
    """A stand-in for a model: the first line as a claim, supported if the prompt is long."""
    return pd.Series(["Here: " + json.dumps({"claims": [{"fact": p.split("\n")[0], "status": "supported" if len(p) > 200 else "unclear", "source": "c1"}]}) for p in prompt])


@query(f"""WITH {S.QUESTIONS}, c AS (SELECT doc_id AS qid, coalesce(text, '') AS context FROM documents), x AS (SELECT qid, question, length(question || chr(10) || context) > 200 AS ok, string_split(question || chr(10) || context, chr(10))[1] AS fact FROM questions JOIN c USING (qid)),
g AS (SELECT qid, fact FROM x WHERE ok AND NOT (len(regexp_extract_all(fact, '{BIB}')) >= 2 OR (len(regexp_extract_all(fact, '{BIB}')) >= 1 AND {S.wc('fact')} < 40))) SELECT q.qid, CASE WHEN fact IS NULL THEN [] ELSE [fact] END AS claims, 'Claims: ' || fact AS answer FROM questions q LEFT JOIN g USING (qid)""")
def two_phase_answers(spark, sf_dir):
    """A model that extracts claims and one that writes them, both stand-ins."""
    contexts = document_rows(spark, sf_dir).select(F.col("doc_id").alias("qid"), F.coalesce("text", F.lit("")).alias("context"))
    return A.two_phase(questions(spark, sf_dir), contexts, _extract, lambda s: "Claims: " + s)


# --- readers and writers: what is written is read again


def written_lines(df, name: str, suffix: str = "") -> str:
    path = scratch(df.sparkSession, name) + suffix
    df.write.json(path)
    return path


@query(f"WITH {S.CHUNKS} SELECT chunk_id, doc_id::VARCHAR AS doc_id, title, section, chunk_index, token_count, text FROM chunks")
def chunk_reader(spark, sf_dir):
    """All chunks as JSON lines and back."""
    rows = chunk_rows(spark, sf_dir)
    path = written_lines(rows.withColumns({"doc_id": F.col("doc_id").cast("string"), "chunk_index": F.col("chunk_index").cast("string")}), "chunk-lines")
    return readers.chunk_lines(spark, path).select("chunk_id", "doc_id", "title", "section", "chunk_index", "token_count", "text")


@query("SELECT lang, count(*) AS n, count(*) FILTER (lang = 'de') AS bad FROM documents WHERE lang IN ('en', 'de') GROUP BY lang")
def tolerant_lines(spark, sf_dir):
    """JSON lines with broken ones, comments and blanks: a line for each document; English ones are good, German ones broken, the rest no data."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    row = F.to_json(F.struct("doc_id", "lang"))
    line = F.when(F.col("lang") == "en", row).when(F.col("lang") == "de", F.replace(row, F.lit("}"), F.lit(""))).when(F.col("lang").isNotNull(), F.concat(F.lit("# "), row)).otherwise("  ")
    path = scratch(spark, "tolerant")
    d.select(line.alias("value")).write.text(path)
    good, bad = readers.lines_of(spark, path, "doc_id long, lang string")
    both = good.select("lang", F.lit(0).alias("b")).unionByName(bad.select(F.regexp_extract("line", r'"lang":"(\w+)"', 1).alias("lang"), F.lit(1).alias("b")))
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("bad"))


@query("SELECT 'd' || doc_id AS doc_id, coalesce(text, '') AS raw_text, coalesce(source, '') || '.pdf' AS source_file, coalesce(text, '') <> '' AS has_blocks FROM documents")
def parsed_reader(spark, sf_dir):
    """Parsed documents (pages with blocks) written as JSON and read again."""
    d = document_rows(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.concat(F.coalesce("source", F.lit("")), F.lit(".pdf")).alias("source_file"), F.coalesce("text", F.lit("")).alias("text"))
    block = F.struct(F.lit("b1").alias("block_id"), F.lit("paragraph").alias("type"), F.col("text").alias("text"), F.array(F.lit("Results")).alias("section_path"), F.lit(1).cast("long").alias("page"))
    kept = F.when(F.col("text") != "", F.array(block)).otherwise(F.slice(F.array(block), 1, 0))
    docs = d.select("doc_id", "source_file", F.lit(1).cast("long").alias("total_pages"), F.lit("parsed").alias("parser_stage"), F.array(F.struct(F.lit(1).cast("long").alias("page"), F.col("text").alias("text"), kept.alias("blocks"))).alias("pages"))
    path = written_lines(docs, "parsed")
    read = spark.read.schema(readers.PARSED).json(path)
    return readers.parsed_rows(read, F.lit("none")).select("doc_id", "raw_text", "source_file", "has_blocks")


@query(f"WITH {S.BLOCKS}, k AS (SELECT doc_id, ord, text, (ord // 10 + 1)::BIGINT AS page FROM blocks) SELECT doc_id::VARCHAR AS doc_id, count(*) AS n, max(page) AS total_pages, string_agg(text, chr(10) ORDER BY page, ord) AS text FROM k GROUP BY doc_id")
def parsed_writer(spark, sf_dir):
    """Blocks written as one JSON line for each document, and read as blocks again."""
    from ..operators.corpus import blocks

    rows = blocks(document_rows(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("doc_id"), "ord", F.lit("paragraph").alias("kind"), "text", (F.floor(F.col("ord") / 10) + 1).cast("long").alias("page"))
    path = scratch(spark, "parsed-out")
    sinks.write_parsed(rows, path)
    read = readers.parsed_rows(spark.read.schema(readers.PARSED).json(path), F.lit("none"))
    per = readers.block_rows(read).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return per.join(read.select("doc_id", "total_pages"), "doc_id").select("doc_id", "n", "total_pages", F.array_join(F.transform("p", lambda v: v["text"]), "\n").alias("text"))


@query(f"WITH {S.KINDS}, l AS (SELECT doc_id, ord, CASE kind WHEN 'heading' THEN '## ' || text WHEN 'table_text' THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END AS l FROM kinds WHERE kind <> 'noise') SELECT doc_id, string_agg(l, chr(10) || chr(10) ORDER BY ord) AS markdown FROM l GROUP BY doc_id")
def markdown_preview(spark, sf_dir):
    """Headings, paragraphs and tables of each document as Markdown."""
    from ..operators.corpus import blocks

    return sinks.preview(blocks(document_rows(spark, sf_dir)).withColumn("kind", T.line_kind("text")))


@query("""SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'json' WHEN doc_id % 3 = 0 THEN 'txt' ELSE 'pdf' END AS source_file FROM documents""")
def preferred_inputs(spark, sf_dir):
    """Documents by the reader that is preferred: JSON before text before PDF, of overlapping sets."""
    d = document_rows(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("raw_text"), F.col("doc_id").alias("i"))
    kind = lambda rows, name: rows.withColumn("source_file", F.lit(name))
    return readers.preferred(kind(d.where("i % 2 = 0"), "json"), kind(d.where("i % 3 = 0"), "txt"), kind(d, "pdf")).select("doc_id", "source_file")


@query("SELECT item_id::VARCHAR AS id, text AS question, CASE WHEN item_id % 2 = 0 THEN ['a', 'b'] ELSE [] END AS tags, item_id AS expected_min_citations FROM benchmark")
def sample_reader(spark, sf_dir):
    """Evaluation samples as JSON lines and back."""
    tags = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), tags.alias("tags"), F.col("item_id").alias("expected_min_citations"))
    return readers.samples(spark, written_lines(rows, "samples", ".jsonl")).select("id", "question", "tags", "expected_min_citations")


@query("SELECT item_id::VARCHAR AS id, text AS query, item_id % 3 = 0 AS exclude_from_primary_metrics FROM benchmark")
def spec_reader(spark, sf_dir):
    """Query specifications; what isn't said is false."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.when(F.col("item_id") % 3 == 0, True).alias("exclude_from_primary_metrics"))
    return readers.query_specs(spark, written_lines(rows, "specs")).select("id", "query", "exclude_from_primary_metrics")


@query("SELECT 'doc_' || p_partkey AS doc_id, p_name AS old_name, p_name || '.pdf' AS new_name FROM part")
def name_map_reader(spark, sf_dir):
    """The map of file names, here of parts."""
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("doc_"), F.col("p_partkey").cast("string")).alias("doc_id"), F.col("p_name").alias("old_name"), F.concat("p_name", F.lit(".pdf")).alias("new_name"))
    return readers.name_map(spark, written_lines(rows, "names"))


@query("""WITH n AS (SELECT DISTINCT s_name || '.pdf' AS old_name FROM supplier), r AS (SELECT old_name, row_number() OVER (ORDER BY lower(substr(old_name, 1, 1)), old_name) AS k FROM n) SELECT old_name, printf('doc_%04d.pdf', k) AS new_name, NULL::VARCHAR AS problem FROM r""")
def rename_files(spark, sf_dir):
    """Numbers for files by name, here of suppliers."""
    return sinks.rename_plan(table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(".pdf")).alias("old_name")).distinct())


@query("SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no, role, text AS content FROM conversations")
def turn_reader(spark, sf_dir):
    """Sessions as objects of lists by id, and back as turns."""
    c = table(spark, sf_dir, "conversations")
    per = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    line = F.to_json(F.create_map(F.col("conv_id").cast("string"), F.transform("t", lambda v: F.struct(v["role"].alias("role"), v["content"].alias("content")))))
    path = scratch(spark, "turns")
    per.select(line.alias("value")).write.text(path)
    return readers.turn_rows(spark.read.text(path))


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM (SELECT 'search' AS event_type, o_custkey AS user_id FROM orders) GROUP BY event_type")
def audit_log(spark, sf_dir):
    """Events appended to a log and read again: one for each order."""
    path = scratch(spark, "audit")
    sinks.audit_events(table(spark, sf_dir, "orders"), "search", ["o_orderkey", "o_custkey"]).write.mode("append").json(path)
    x = spark.read.schema("timestamp_utc timestamp, event_type string, payload string").json(path)
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("payload", "$.o_custkey").cast("long")).alias("users"))


@query("SELECT 'rows_' || o_orderstatus AS metric, '| rows_' || o_orderstatus || ' | ' || printf('%.4f', count(*)::DOUBLE) || ' |' AS line FROM orders GROUP BY o_orderstatus")
def report_table(spark, sf_dir):
    """Markdown rows of metrics."""
    m = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("rows_"), "o_orderstatus").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return sinks.report_lines(m)


def _library_sql() -> str:
    from .analytics_queries import QUALITY

    kept = f"q AS (SELECT *, {S.wc('text')} AS w, length(text) AS n, {QUALITY} AS qs, contains(text, '[TABLE TEXT]') AS tab FROM chunks), kept AS (SELECT * FROM q WHERE CASE WHEN tab THEN n >= 20 AND w >= 3 AND qs >= 0.05 ELSE n >= 50 AND w >= 10 AND qs >= 0.3 END)"
    return f"WITH {S.CHUNKS}, {kept}, t AS (SELECT chunk_id, {S.tok(S.HEADED)} AS t FROM kept), s AS (SELECT count(*) AS n_rows, round(avg(len(t)), 6) AS avgdl FROM t), p AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM t) GROUP BY ALL) GROUP BY term) SELECT term, df, tf, n_rows, avgdl FROM p, s"


@query(_library_sql())
def index_cache(spark, sf_dir):
    """The library's tables saved and loaded by version; another version finds nothing. Terms with their document frequency."""
    path = scratch(spark, "library")
    Library.build(document_rows(spark, sf_dir)).save(path, "v1")
    if Library.load(spark, path, "v2") is not None:
        raise AssertionError("a library of another version was loaded")
    library = Library.load(spark, path, "v1")
    stats = library.stats.select("n_rows", F.round("avgdl", 6).alias("avgdl"))
    terms = R.document_frequency(library.postings).join(library.postings.groupBy("term").agg(F.sum("tf").alias("tf")), "term")
    return terms.crossJoin(F.broadcast(stats))  # one row

"""DuckDB SQL of the stand-in tables that the queries share: chunks, questions, term statistics, runs, hits."""

from __future__ import annotations

TOK = r"[A-Za-z0-9_+-]+|[\x{4e00}-\x{9fff}]"


def tok(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{TOK}'), lambda t: lower(t))"


def wc(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> ''))"


def word_list(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '')"


def letters(x: str) -> str:
    return f"list_transform(range(26), lambda i: (length(lower({x})) - length(replace(lower({x}), chr((97 + i)::INT), '')))::DOUBLE)"


LINES = "lines AS (SELECT doc_id, source, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents)"
BLOCKS = LINES + """,
blocks AS (SELECT doc_id, n, unnest(range(n)) AS ord, unnest(l) AS text FROM (SELECT doc_id, len(l) AS n, l FROM lines WHERE len(l) > 0))"""
CHUNKS = LINES + f""",
chunks0 AS (SELECT doc_id, source AS source_file, l, len(l) AS n, unnest(range((len(l) + 3) // 4)) AS chunk_index FROM lines WHERE len(l) > 0),
chunks1 AS (SELECT *, array_to_string(l[chunk_index * 4 + 1 : chunk_index * 4 + 4], chr(10)) AS body, substr(l[1], 1, 80) AS title, chunk_index * 4 AS o FROM chunks0),
chunks AS (SELECT doc_id::VARCHAR || '_c' || chunk_index AS chunk_id, doc_id, source_file, title,
    CASE WHEN o = 0 THEN 'Title' WHEN o * 100 < n * 25 THEN 'Abstract' WHEN o * 100 < n * 45 THEN 'Introduction' WHEN o * 100 < n * 60 THEN 'Methods' WHEN o * 100 < n * 80 THEN 'Results' ELSE 'Discussion' END AS section,
    chunk_index // 3 + 1 AS page_start, chunk_index // 3 + 1 AS page_end, chunk_index, {wc('body')} AS token_count,
    CASE WHEN contains(body, ' | ') THEN '[TABLE TEXT] ' || body ELSE body END AS text FROM chunks1)"""
PREFIXES = ("Compare ", "Summary of ", "Protocol for ", "What is in table 1: ", "")
QUESTIONS = f"questions AS (SELECT item_id AS qid, {list(PREFIXES)}[(item_id % 5 + 1)::INT] || text AS question FROM benchmark)"
HEADED = "concat_ws(chr(10), 'title ' || nullif(title, ''), 'section ' || nullif(section, ''), 'source_file ' || nullif(source_file, ''), 'doc_id ' || doc_id, text)"


def any_of(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(x, w.replace("'", "''")) for w in words) + ")"


def bm25_ctes(name: str, rows: str, text: str, key: str, limit: int, questions: str = "questions", tokens=tok, where: str = "true") -> str:
    return f"""
{name}_t AS (SELECT {key} AS k, {tokens(text)} AS t, ({where}) AS ok FROM {rows}),
{name}_st AS (SELECT count(*) AS n, coalesce(avg(len(t)), 0) AS avgdl FROM {name}_t),
{name}_p AS (SELECT k, ok, dl, term, count(*) AS tf FROM (SELECT k, ok, len(t) AS dl, unnest(t) AS term FROM {name}_t) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_q AS (SELECT qid, term, count(*) AS qf FROM (SELECT qid, unnest({tokens('question')}) AS term FROM {questions}) GROUP BY ALL),
{name}_s AS (SELECT qid, k, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / greatest(avgdl, 1)))), 6) AS bm25_score
    FROM {name}_p JOIN {name}_q USING (term) JOIN {name}_df USING (term) CROSS JOIN {name}_st WHERE ok GROUP BY qid, k),
{name} AS (SELECT qid, k AS {key}, bm25_score, row_number() OVER (PARTITION BY qid ORDER BY bm25_score DESC, k) AS bm25_rank FROM {name}_s WHERE bm25_score > 0 QUALIFY bm25_rank <= {limit})"""


def dense_ctes(name: str, questions: str, rows: str, key: str, limit: int, floor: float) -> str:
    """questions: qid, v; rows: key, v."""
    return f"""
{name}_a AS (SELECT q.qid, r.{key}, round(CASE WHEN list_dot_product(q.v, q.v) = 0 OR list_dot_product(r.v, r.v) = 0 THEN 0 ELSE list_cosine_similarity(q.v, r.v) END, 6) AS vector_score FROM {questions} q CROSS JOIN {rows} r WHERE q.qid::VARCHAR <> r.{key}::VARCHAR),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY vector_score DESC, {key}) AS dense_rank FROM {name}_a QUALIFY dense_rank <= {limit}) WHERE vector_score >= {floor})"""


COMPARE = "regexp_replace(question, '(?i)^\\s*(?:please )?(?:请|请你|请基于文库|请根据文库)?\\s*(?:compare|difference between|比较|对比|相比)?\\s*', '')"
LEAD, REST = f"regexp_extract({COMPARE}, '^[^.?!:：。？！]*')", f"regexp_extract({COMPARE}, '(?s)^[^.?!:：。？！]*[.?!:：。？！](.*)$', 1)"
BETWEEN = r"(?i)\s*(?:,|，|、|以及|及|\band\b|和|与|\bvs\.?|\bversus\b)\s*"


def objects(span: str) -> str:
    cut = f"regexp_replace({span}, '(在当前文库|在文库|在本研究|请分别说明|请说明|分别说明|说明).*$', '')"
    return f"list_filter(list_transform(string_split(regexp_replace({cut}, '{BETWEEN}', chr(1), 'g'), chr(1)), lambda p: trim(p, ' ;；，,。')), lambda p: length(p) >= 2)"


#: What a comparison names; without the case that all stands after a colon, which no question of the tables has.
OBJECTS = objects(LEAD)
SHARED = f"trim(regexp_replace(translate(regexp_replace(trim({REST}), '^请(分别)?说明|^它们', ''), ':：', '  '), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"


def noise(x: str) -> str:
    return f"regexp_matches(trim({x}), '(?i)^(page )?\\d{{1,4}}( of \\d+)?$|^https?://\\S+$|\\bdoi[:.]|^(copyright|©|\\(c\\))|all rights reserved|^licensed under|^received:? |^accepted:? |^www\\.')"


def heading(x: str) -> str:
    y = f"trim({x})"
    names = "abstract|introduction|background|methods|materials and methods|results|results and discussion|discussion|conclusions?|references"
    return f"((regexp_matches({y}, '^#{{1,3}} \\S|^\\d+(\\.\\d+)*\\.? [A-Z]\\S*( \\S+){{0,9}}$') OR regexp_matches(lower({y}), '^({names})$')) AND NOT {noise(x)} AND NOT regexp_matches({y}, '[.;,]$'))"


def reference(x: str) -> str:
    return f"regexp_matches(trim({x}), '^(\\[\\d{{1,3}}\\]|\\d{{1,3}}\\.) .*(19|20)\\d\\d')"


def cells(x: str) -> str:
    w = word_list(x)
    return f"(len(string_split({x}, '|')) >= 4 OR (len({w}) >= 4 AND len(list_filter({w}, lambda w: regexp_matches(w, '^[-+]?\\d'))) * 2 > len({w})))"


def kind(x: str) -> str:
    return f"CASE WHEN {noise(x)} THEN 'noise' WHEN {heading(x)} THEN 'heading' WHEN {reference(x)} THEN 'reference' WHEN {cells(x)} THEN 'table_text' WHEN regexp_matches({x}, '(?i)^fig(ure|\\.) ?[a-z]?\\d+') THEN 'figure_caption' WHEN regexp_matches({x}, '(?i)^table ?[a-z]?\\d+') THEN 'table_caption' ELSE 'paragraph' END"


#: KINDS has the blocks with their kinds, in the order of BLOCKS; each predicate is computed once.
KINDS = f"{BLOCKS}, kinds AS MATERIALIZED (SELECT doc_id, ord, text, {kind('text')} AS kind FROM blocks)"


def sentences(x: str) -> str:
    """The list of a text's sentences: pieces after end marks, those above 360 characters by clauses folded up to 300."""
    flat = f"trim(regexp_replace({x}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"
    pieces = f"list_filter(list_transform(string_split(regexp_replace({flat}, '([.!?。！？]) |[；;] ?', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p, ' ;；')), lambda p: p <> '')"
    parts = "list_filter(list_transform(string_split(regexp_replace(p, ',\\s+|，\\s*', chr(1), 'g'), chr(1)), lambda q: trim(q, ' ,，')), lambda q: q <> '')"
    fold = f"string_split(list_reduce({parts}, lambda a, c: a || CASE WHEN length(string_split(a, chr(1))[-1]) + 1 + length(c) <= 300 THEN '，' ELSE chr(1) END || c), chr(1))"
    return f"list_filter(flatten(list_transform({pieces}, lambda p: CASE WHEN length(p) <= 360 THEN [p] ELSE {fold} END)), lambda z: length(z) >= 24)[1:80]"


NUMBERS = "list_distinct(list_transform(regexp_extract_all(lower({}), '[0-9]+(?:\\.[0-9]+)? ?(?:%|g/l|mg/l|mg|mm|um|fold|h\\b)?'), lambda n: replace(n, ' ', '')))"

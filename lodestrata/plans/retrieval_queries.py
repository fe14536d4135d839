"""Queries of search, fusion and boosts over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Lexicon, Settings
from ..functions.session import settle
from ..operators import corpus
from ..operators import retrieval as R
from ..operators.index import Index
from . import sql as S
from .engine import Library

S0 = Settings()
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


_SERVED: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, what: str, make):
    """What ``make`` builds, built once a session for the same files: a stored index serves all questions that come after it."""
    docs = table(spark, sf_dir, "documents")
    jvm = spark.sparkContext._jvm
    where = [jvm.org.apache.hadoop.fs.Path(f) for f in docs.inputFiles()]
    files = tuple((str(s.getPath()), s.getLen(), s.getModificationTime()) for p in where for s in [p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)])
    key = (spark.sparkContext.applicationId, what, files)
    if key not in _SERVED:
        _SERVED[key] = make()
    return _SERVED[key]


def served(spark: SparkSession, sf_dir: str) -> Library:
    """The library of all chunks of the documents."""
    return once(spark, sf_dir, "chunks", lambda: Library.of(chunk_rows(spark, sf_dir)))


def served_documents(spark: SparkSession, sf_dir: str) -> Index:
    """The lexical index of whole documents."""
    return once(spark, sf_dir, "documents", lambda: Index.build(document_rows(spark, sf_dir), F.col("text"), "doc_id"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a question; the item's number chooses the words before it."""
    items = table(spark, sf_dir, "benchmark")
    before = F.element_at(F.array(*map(F.lit, S.PREFIXES)), (F.col("item_id") % 5 + 1).cast("int"))
    return items.select(F.col("item_id").alias("qid"), F.concat(before, "text").alias("question"))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


DOC_BM25 = S.bm25_ctes("b", "documents", "coalesce(text, '')", "doc_id", 10)


@query(f"WITH {S.QUESTIONS}, {DOC_BM25} SELECT qid, doc_id, bm25_score, bm25_rank FROM b")
def bm25_topk(spark, sf_dir):
    """The ten best documents for each benchmark question, from the stored index."""
    return served_documents(spark, sf_dir).search(questions(spark, sf_dir), 10, key="doc_id")


@query(f"WITH {S.QUESTIONS}, {S.bm25_ctes('b', 'documents', 'coalesce(text, chr(32))', 'doc_id', 10, where='source IN (' + chr(39) + 'src1' + chr(39) + ',' + chr(39) + 'src2' + chr(39) + ',' + chr(39) + 'src3' + chr(39) + ')')} SELECT qid, doc_id, bm25_score, bm25_rank FROM b")
def bm25_filtered(spark, sf_dir):
    """Only documents of three sources may be found; statistics stay those of all documents."""
    docs = document_rows(spark, sf_dir)
    only = R.filtered(docs.withColumnRenamed("source", "source_file"), source_files=["src1", "src2", "src3"]).select("doc_id")
    return served_documents(spark, sf_dir).search(questions(spark, sf_dir), 10, only=only, key="doc_id")


@query(f"WITH {S.QUESTIONS}, {DOC_BM25} SELECT qid, doc_id, bm25_score, bm25_rank FROM b")
def bm25_scan(spark, sf_dir):
    """The same from the texts themselves, without an index."""
    return R.bm25(questions(spark, sf_dir), document_rows(spark, sf_dir), 10, F.col("text"), key="doc_id")


@query(f"WITH questions AS (SELECT item_id AS qid, text || ' ' || text || ' the the of' AS question FROM benchmark), {DOC_BM25} SELECT qid, doc_id, bm25_score, bm25_rank FROM b")
def bm25_repeat_terms(spark, sf_dir):
    """A question's repeated terms count repeatedly."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat_ws(" ", "text", "text", F.lit("the the of")).alias("question"))
    return R.bm25(q, document_rows(spark, sf_dir), 10, F.col("text"), key="doc_id")


def ascii_tok(x: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: CASE WHEN t IN ('table', 'figure') THEN [t, t] ELSE [t] END))"


@query(f"WITH {S.QUESTIONS}, {S.bm25_ctes('b', 'documents', 'coalesce(text, chr(32))', 'doc_id', 20, tokens=ascii_tok)} SELECT qid, doc_id, bm25_score, bm25_rank FROM b")
def bm25_diagnostic(spark, sf_dir):
    """ASCII tokens, structure words twice."""
    return R.bm25(questions(spark, sf_dir), document_rows(spark, sf_dir), 20, F.col("text"), key="doc_id", tokenize=T.ascii_tokens)


@query(f"WITH t AS (SELECT doc_id, unnest(list_distinct({S.tok('coalesce(text, chr(32))')})) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term")
def corpus_df(spark, sf_dir):
    return R.document_frequency(R.term_counts(document_rows(spark, sf_dir), F.col("text"), key="doc_id"))


@query(f"SELECT count(*) AS n_rows, round(coalesce(avg(len({S.tok('coalesce(text, chr(32))')})), 0), 6) AS avgdl FROM documents")
def corpus_statistics(spark, sf_dir):
    return R.corpus_stats(document_rows(spark, sf_dir), F.col("text")).withColumn("avgdl", F.round("avgdl", 6))


VECTORS = "ev AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings), qv AS (SELECT vec_id AS qid, v FROM ev WHERE vec_id % 20 = 0)"


def vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    return rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), "v"), rows


@query(f"WITH {VECTORS}, {S.dense_ctes('d', 'qv', 'ev', 'vec_id', 10, -2)} SELECT qid, vec_id, vector_score, dense_rank FROM d")
def dense_topk(spark, sf_dir):
    """Exact cosine search for every twentieth vector among all others."""
    q, rows = vectors(spark, sf_dir)
    return R.dense(q, rows, 10, -2.0, "vec_id")


@query(f"WITH {VECTORS}, {S.dense_ctes('d', 'qv', 'ev', 'vec_id', 40, 0.3)} SELECT qid, vec_id, vector_score, dense_rank FROM d")
def dense_floor(spark, sf_dir):
    """The floor applies after the limit."""
    q, rows = vectors(spark, sf_dir)
    return R.dense(q, rows, 40, 0.3, "vec_id")


@query(f"WITH {VECTORS}, few AS (SELECT * FROM ev WHERE label IN (1, 2, 3)), {S.dense_ctes('d', 'qv', 'few', 'vec_id', 10, 0.05)} SELECT qid, vec_id, vector_score, dense_rank FROM d")
def dense_filtered(spark, sf_dir):
    q, rows = vectors(spark, sf_dir)
    return R.dense(q, rows.where(F.col("label").isin(1, 2, 3)), 10, 0.05, "vec_id")


@query(f"""WITH {VECTORS}, a AS (SELECT vec_id, v[1:16] AS v FROM ev), qa AS (SELECT qid, v[1:16] AS v FROM qv), {S.dense_ctes('full_', 'qv', 'ev', 'vec_id', 5, -2)}, {S.dense_ctes('cut', 'qa', 'a', 'vec_id', 5, -2)}
SELECT coalesce(f.qid, c.qid) AS qid, coalesce(f.vec_id, c.vec_id) AS vec_id, f.vector_score AS full_score, c.vector_score AS cut_score, f.dense_rank AS full_rank, c.dense_rank AS cut_rank,
  CASE WHEN f.vec_id IS NULL THEN 'cut_only' WHEN c.vec_id IS NULL THEN 'full_only' WHEN abs(f.vector_score - c.vector_score) < 0.01 THEN 'same' WHEN f.vector_score > c.vector_score THEN 'full' ELSE 'cut' END AS verdict
FROM full_ f FULL JOIN cut c ON f.qid = c.qid AND f.vec_id = c.vec_id""")
def dense_ab(spark, sf_dir):
    """Two collections compared: whole vectors against their first sixteen components."""
    q, rows = vectors(spark, sf_dir)
    cut = lambda df: df.withColumn("v", F.slice("v", 1, 16))
    f = R.dense(q, rows, 5, -2.0, "vec_id").toDF("qid", "vec_id", "full_score", "full_rank")
    c = R.dense(cut(q), cut(rows), 5, -2.0, "vec_id").toDF("qid", "vec_id", "cut_score", "cut_rank")
    both = f.join(c, ["qid", "vec_id"], "full_outer")
    verdict = F.when(F.col("full_rank").isNull(), "cut_only").when(F.col("cut_rank").isNull(), "full_only").when(F.abs(F.col("full_score") - F.col("cut_score")) < 0.01, "same").when(F.col("full_score") > F.col("cut_score"), "full").otherwise("cut")
    return both.withColumn("verdict", verdict)


RUNS = f"""{S.CHUNKS}, {S.QUESTIONS}, qv AS (SELECT qid, {S.letters('question')} AS v FROM questions), cv AS (SELECT chunk_id, {S.letters('text')} AS v FROM chunks),
{S.dense_ctes('d', 'qv', 'cv', 'chunk_id', 40, 0.05)}, {S.bm25_ctes('b', 'chunks', S.HEADED, 'chunk_id', 40)}"""


def runs(spark, sf_dir):
    q, library = questions(spark, sf_dir), served(spark, sf_dir)
    d = R.dense(q.select("qid", T.letter_vector("question").alias("v")), library.vectors)
    return q, library.chunks, d, library.index.search(q)


def fused_sql(name: str, d: str, b: str, limit: int, dw: str = "1.0", bw: str = "1.0") -> str:
    return f"""{name}_p AS (SELECT qid, chunk_id, vector_score, 0.0::DOUBLE AS bm25_score, {dw} / (60 + dense_rank)::DOUBLE AS part FROM {d} UNION ALL SELECT qid, chunk_id, 0.0, bm25_score, {bw} / (60 + bm25_rank)::DOUBLE FROM {b}),
{name}_g AS (SELECT qid, chunk_id, max(vector_score) AS vector_score, max(bm25_score) AS bm25_score, round(sum(part), 8) AS fusion_score FROM {name}_p GROUP BY qid, chunk_id),
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fusion_score DESC, vector_score > 0 DESC, vector_score DESC, bm25_score DESC, chunk_id) AS rank FROM {name}_g QUALIFY rank <= {limit})"""


FUSED = f"{RUNS}, {fused_sql('f', 'd', 'b', 40)}"


def fused(spark, sf_dir):
    q, rows, d, b = runs(spark, sf_dir)
    return q, rows, R.fuse([(d, "vector_score", "dense_rank", 1.0), (b, "bm25_score", "bm25_rank", 1.0)], 40)


@query(f"WITH {FUSED} SELECT qid, chunk_id, vector_score, bm25_score, fusion_score, rank FROM f")
def rrf_hybrid(spark, sf_dir):
    return fused(spark, sf_dir)[2]


@query(f"""WITH {RUNS} SELECT qid, chunk_id, vector_score, dense_rank, bm25_score, bm25_rank, round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0), 8) AS merged_score,
row_number() OVER (PARTITION BY qid ORDER BY merged_score DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, chunk_id) AS rank FROM d FULL JOIN b USING (qid, chunk_id)""")
def full_outer_scores(spark, sf_dir):
    _, _, d, b = runs(spark, sf_dir)
    return R.merged_by_key(d, b)


X = S0.lexicon
INTENT = f"""CASE WHEN {S.any_of('lower(question)', X.comparison)} THEN 'comparison' WHEN {S.any_of('lower(question)', X.summary)} THEN 'summary' WHEN {S.any_of('lower(question)', X.experiment)} THEN 'experiment'
WHEN {S.any_of('lower(question)', X.factoid)} THEN 'factoid' WHEN regexp_matches(question, '[?？]') THEN 'factoid' ELSE 'unknown' END"""
ROUTED = f"""routed AS (SELECT qid, question, intent, intent = 'experiment' AS requires_external_tools, 40 + CASE intent WHEN 'comparison' THEN 8 WHEN 'summary' THEN 5 WHEN 'experiment' THEN 5 ELSE 0 END AS search_limit,
10 + CASE intent WHEN 'comparison' THEN 2 ELSE 0 END AS rerank_top_k FROM (SELECT *, {INTENT} AS intent FROM questions))"""


@query(f"WITH {S.QUESTIONS}, {ROUTED} SELECT qid, question, intent, requires_external_tools, search_limit::BIGINT AS search_limit, rerank_top_k::BIGINT AS rerank_top_k FROM routed")
def intent_route(spark, sf_dir):
    return R.routed(questions(spark, sf_dir))


HITS = f"{FUSED}, {ROUTED}, hits AS (SELECT f.*, c.* EXCLUDE (chunk_id), r.* EXCLUDE (qid) FROM f JOIN chunks c USING (chunk_id) JOIN routed r USING (qid))"


def hits(spark, sf_dir):
    """Fused hits with the chunks' and the questions' columns."""
    q, rows, f = fused(spark, sf_dir)
    return R.with_rows(f, rows).join(R.routed(q), "qid")


@query(f"""WITH {HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank) AS nth FROM hits)
SELECT * FROM (SELECT qid, chunk_id, doc_id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN intent = 'comparison' THEN nth > 3 ELSE false END, n.rank) AS rank FROM n) WHERE rank <= 20""")
def per_doc_cap(spark, sf_dir):
    """At most three chunks of a document before the overflow, for comparisons."""
    return R.diversified(hits(spark, sf_dir), 20).select("qid", "chunk_id", "doc_id", "rank")


#: Words of the driver's own prose in the place of names, so that the boosts have something to find.
PROSE = Lexicon(aliases=(("the", "and"), ("der", "die"), ("de", "la"), ("of",)), review=("tion",), result=("tion", "ment", "keit"), definition=("is the", "est", "ist"))
PROSE_SETTINGS = Settings(lexicon=PROSE)


def title_boost_sql() -> str:
    q, t, body = "lower(question)", "lower(title)", "lower(substr(text, 1, 600))"
    b = " + ".join(f"CASE WHEN {S.any_of(q, g)} AND {S.any_of(t, g)} THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN {S.any_of(q, g)} AND section = 'Abstract' AND {S.any_of(body, g)} THEN 0.08::DOUBLE * 0.7::DOUBLE ELSE 0 END" for g in PROSE.aliases)
    m = " + ".join(f"({S.any_of(q, g)} AND {S.any_of(t, g)})::INT" for g in PROSE.aliases)
    return f"boosted AS (SELECT * EXCLUDE (fusion_score), round(fusion_score + CASE WHEN bo > 0 THEN greatest(0, bo + CASE WHEN contains({t}, 'tion') THEN -0.048 WHEN ma >= 2 THEN 0.028 ELSE 0 END) ELSE 0 END, 8) AS fusion_score FROM (SELECT *, {b} AS bo, {m} AS ma FROM hits))"


ORDER = "fusion_score DESC, vector_score > 0 DESC, vector_score DESC, bm25_score DESC, chunk_id"


@query(f"WITH {HITS}, {title_boost_sql()} SELECT qid, chunk_id, fusion_score, row_number() OVER (PARTITION BY qid ORDER BY {ORDER}) AS rank FROM boosted")
def title_boost(spark, sf_dir):
    out = R.reranked_by_fusion(R.title_boost(hits(spark, sf_dir), PROSE_SETTINGS))
    return out.select("qid", "chunk_id", "fusion_score", "rank")


def marker_sql(q: str = "lower(question)", t: str = "lower(text)") -> str:
    return f"""CASE WHEN {S.any_of(q, X.table)} THEN CASE WHEN contains({t}, '[table text]') THEN 0.1 ELSE 0 END + CASE WHEN contains({t}, '[table caption]') THEN 0.06 ELSE 0 END ELSE 0 END
+ CASE WHEN {S.any_of(q, X.figure)} AND contains({t}, '[figure caption]') THEN 0.08 ELSE 0 END"""


@query(f"WITH {HITS}, boosted AS (SELECT * EXCLUDE (fusion_score), round(fusion_score + {marker_sql()}, 8) AS fusion_score FROM hits) SELECT qid, chunk_id, fusion_score, row_number() OVER (PARTITION BY qid ORDER BY {ORDER}) AS rank FROM boosted")
def structure_boost(spark, sf_dir):
    return R.reranked_by_fusion(R.structure_boost(hits(spark, sf_dir))).select("qid", "chunk_id", "fusion_score", "rank")


VARIANTS = f"""parts AS (SELECT qid, question, intent, CASE WHEN intent = 'comparison' THEN {S.OBJECTS} ELSE [] END AS p, {S.SHARED} AS shared FROM routed),
variants AS (SELECT qid, intent, unnest([question] || CASE WHEN len(p) >= 2 THEN list_transform(p[1:4], lambda o: trim(o || ' ' || shared)) ELSE [] END) AS question, unnest(range(1 + CASE WHEN len(p) >= 2 THEN least(4, len(p)) ELSE 0 END)) AS variant FROM parts),
weighted AS (SELECT qid, variant, question, CASE WHEN variant > 0 THEN 0.9 WHEN intent = 'comparison' THEN 1.1 ELSE 1.0 END::DOUBLE AS weight, CASE WHEN variant > 0 THEN 0.9 WHEN intent = 'comparison' THEN 1.1 ELSE 1.0 END::DOUBLE AS bm25_weight FROM variants)"""


@query(f"WITH {S.QUESTIONS}, {ROUTED}, {VARIANTS} SELECT * FROM weighted")
def query_variants(spark, sf_dir):
    return R.variants(R.routed(questions(spark, sf_dir)))


def alias_boost_sql(x: Lexicon) -> str:
    q, t, body = "lower(question)", "lower(title)", "lower(substr(text, 1, 600))"
    b = " + ".join(f"CASE WHEN {S.any_of(q, g)} AND {S.any_of(t, g)} THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN {S.any_of(q, g)} AND section = 'Abstract' AND {S.any_of(body, g)} THEN 0.08::DOUBLE * 0.7::DOUBLE ELSE 0 END" for g in x.aliases)
    m = " + ".join(f"({S.any_of(q, g)} AND {S.any_of(t, g)})::INT" for g in x.aliases)
    return f"boosted AS (SELECT * EXCLUDE (fusion_score), round(fusion_score + CASE WHEN bo > 0 THEN greatest(0, bo + CASE WHEN {S.any_of(t, x.review)} THEN -0.048 WHEN ma >= 2 THEN 0.028 ELSE 0 END) ELSE 0 END, 8) AS fusion_score FROM (SELECT *, {b} AS bo, {m} AS ma FROM hits))"


HYBRID = f"""{S.CHUNKS}, {S.QUESTIONS}, {ROUTED}, {VARIANTS}, vq AS (SELECT qid || '/' || variant AS qid, qid AS q0, question, weight, bm25_weight FROM weighted), vv AS (SELECT qid, {S.letters('question')} AS v FROM vq), cv AS (SELECT chunk_id, {S.letters('text')} AS v FROM chunks),
{S.dense_ctes('vd', 'vv', 'cv', 'chunk_id', 40, 0.05)}, {S.bm25_ctes('vb', 'chunks', S.HEADED, 'chunk_id', 40, questions='vq')},
vp AS (SELECT q0 AS qid, chunk_id, vector_score, 0.0::DOUBLE AS bm25_score, weight / (60 + dense_rank)::DOUBLE AS part FROM vd JOIN vq USING (qid) UNION ALL SELECT q0, chunk_id, 0.0, bm25_score, bm25_weight / (60 + bm25_rank)::DOUBLE FROM vb JOIN vq USING (qid)),
vg AS (SELECT qid, chunk_id, max(vector_score) AS vector_score, max(bm25_score) AS bm25_score, round(sum(part), 8) AS fusion_score FROM vp GROUP BY qid, chunk_id),
f AS (SELECT * FROM vg QUALIFY row_number() OVER (PARTITION BY qid ORDER BY fusion_score DESC, vector_score > 0 DESC, vector_score DESC, bm25_score DESC, chunk_id) <= 120),
hits AS (SELECT f.*, c.* EXCLUDE (chunk_id), r.* EXCLUDE (qid) FROM f JOIN chunks c USING (chunk_id) JOIN routed r USING (qid)), {alias_boost_sql(X)},
marked AS (SELECT * EXCLUDE (fusion_score), round(fusion_score + {marker_sql()}, 8) AS fusion_score FROM boosted), placed0 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {ORDER}) AS r0 FROM marked),
nth AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY r0) AS nth FROM placed0)"""


@query(f"""WITH {HYBRID} SELECT qid, chunk_id, doc_id, fusion_score, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN intent = 'comparison' THEN nth > 3 ELSE false END, r0) AS rank FROM nth QUALIFY rank <= 40""")
def hybrid_search(spark, sf_dir):
    """Variants, both runs, fusion, boosts, diversity in one plan."""
    library = served(spark, sf_dir)
    return R.hybrid(questions(spark, sf_dir), library.chunks, S0, library.index, library.vectors).select("qid", "chunk_id", "doc_id", "fusion_score", "rank")


@query(f"""WITH {S.CHUNKS}, {S.QUESTIONS}, {S.bm25_ctes('b1', 'chunks', S.HEADED, 'chunk_id', 10, where="source_file = 'src1' AND section = 'Nowhere'")}, {S.bm25_ctes('b2', 'chunks', S.HEADED, 'chunk_id', 10, where="source_file = 'src1'")}
SELECT qid, chunk_id, bm25_score, bm25_rank, 1 AS attempt FROM b2 WHERE qid NOT IN (SELECT qid FROM b1) UNION ALL SELECT qid, chunk_id, bm25_score, bm25_rank, 0 FROM b1""")
def filter_ladder(spark, sf_dir):
    """The first filter variant with hits wins: here the strict one has none."""
    q, rows = questions(spark, sf_dir), chunk_rows(spark, sf_dir)
    steps = [{"source_files": ["src1"], "sections": ["Nowhere"]}, {"source_files": ["src1"]}]
    index = served(spark, sf_dir).index
    return R.first_answering(q, [lambda some, f=f: index.search(some, 10, only=R.filtered(rows, **f)) for f in steps])


BODY = "('" + "', '".join(X.body_sections) + "')"


@query(f"""WITH {HITS}, seen AS (SELECT * FROM hits WHERE rank <= 10), pool AS (SELECT * FROM hits WHERE section IN {BODY}),
per0 AS (SELECT qid, doc_id, min(rank) AS doc_rank, sum((section IN {BODY})::INT) AS nb FROM seen GROUP BY qid, doc_id),
per AS (SELECT qid, doc_id, doc_rank FROM per0 WHERE nb < 3 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY doc_rank, doc_id) <= 5),
fresh AS (SELECT p.qid, p.chunk_id, p.doc_id, doc_rank, round(greatest(vector_score, bm25_score * 0.01) + 1e-9, 6) AS expansion_score, vector_score, bm25_score FROM pool p JOIN per USING (qid, doc_id) WHERE (p.qid, p.chunk_id) NOT IN (SELECT (qid, chunk_id) FROM seen)),
two AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY expansion_score DESC, vector_score DESC, bm25_score DESC, chunk_id) AS n FROM fresh QUALIFY n <= 2)
SELECT qid, chunk_id, doc_id, doc_rank, expansion_score, row_number() OVER (PARTITION BY qid ORDER BY doc_rank, doc_id, n) AS added FROM two QUALIFY added <= 8""")
def body_expand(spark, sf_dir):
    return R.body_expansion(hits(spark, sf_dir).withColumn("shown", F.col("rank") <= 10))

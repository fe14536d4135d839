"""Queries over stored tables: indexes that change, vector cells, tables that change by commits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.session import scratch, stored
from ..operators.index import Index
from ..operators.vector_index import VectorIndex
from ..sources.commits import Table
from . import sql as S
from .retrieval_queries import VECTORS, chunk_rows, document_rows, once, questions, served_documents, table, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


#: Source src1 gets other texts, src2 goes, and each benchmark item becomes a document.
CHANGED = """changed AS (SELECT doc_id, CASE WHEN source = 'src1' THEN concat_ws(' ', 'revised edition', text) ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src2' UNION ALL SELECT -1 - item_id, text FROM benchmark)"""


def changed_documents(spark, sf_dir):
    docs = document_rows(spark, sf_dir)
    fresh = docs.where("source = 'src1'").select("doc_id", F.concat_ws(" ", F.lit("revised edition"), "text").alias("text"))
    return fresh.unionByName(table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")), docs.where("source = 'src2'").select("doc_id")


def changed_index(spark, sf_dir) -> Index:
    """The index of all documents after a change of some, a removal of others, and additions: two more segments."""
    fresh, gone = changed_documents(spark, sf_dir)
    start = served_documents(spark, sf_dir).branched()
    return start.changed(fresh, F.col("text"), "doc_id").changed(None, key="doc_id", removed=gone)


CHANGED_BM25 = S.bm25_ctes("b", "changed", "coalesce(text, '')", "doc_id", 10)


@query(f"WITH {S.QUESTIONS}, {CHANGED}, {CHANGED_BM25} SELECT qid, doc_id, bm25_score, bm25_rank FROM b")
def index_changed_topk(spark, sf_dir):
    """Search after additions, changes and deletions, from deltas and tombstones."""
    return changed_index(spark, sf_dir).search(questions(spark, sf_dir), 10, key="doc_id")


@query(f"WITH {CHANGED}, t AS (SELECT doc_id, {S.tok('coalesce(text, chr(32))')} AS t FROM changed), d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM t) GROUP BY term) SELECT term, df, (SELECT count(*) FROM t) AS n_rows, (SELECT round(avg(len(t)), 6) FROM t) AS avgdl FROM d")
def index_compacted_terms(spark, sf_dir):
    """Document frequencies, rows and mean length, kept by deltas and then compacted."""
    index = changed_index(spark, sf_dir)
    kept, (n, avgdl) = index.document_frequency(), index.statistics()
    if not kept.exceptAll(index.compacted().document_frequency()).isEmpty():
        raise AssertionError("compaction counts other frequencies than the deltas")
    return kept.withColumns({"n_rows": F.lit(n), "avgdl": F.round(F.lit(avgdl), 6)})


def vector_index(spark, sf_dir) -> VectorIndex:
    """The inverted-file index of all embeddings."""
    rows = vectors(spark, sf_dir)[1]
    return once(spark, sf_dir, "vectors", lambda: VectorIndex.build(rows, "vec_id"))


@query(f"WITH {VECTORS}, {S.dense_ctes('d', 'qv', 'ev', 'vec_id', 10, -2)} SELECT qid, vec_id, vector_score, dense_rank FROM d")
def ivf_topk(spark, sf_dir):
    """Search in all cells of the vector index: the exact neighbours."""
    index = vector_index(spark, sf_dir)
    return index.search(vectors(spark, sf_dir)[0], 10, index.cells)


@query(f"WITH {VECTORS}, few AS (SELECT * FROM ev WHERE label IN (1, 2, 3)), {S.dense_ctes('d', 'qv', 'few', 'vec_id', 10, 0.05)} SELECT qid, vec_id, vector_score, dense_rank FROM d")
def ivf_filtered(spark, sf_dir):
    """A filter by a scalar column inside the cells."""
    index = vector_index(spark, sf_dir)
    return index.search(vectors(spark, sf_dir)[0], 10, index.cells, 0.05, F.col("label").isin(1, 2, 3))


@query("SELECT count(*) AS n_questions, true AS recall_enough FROM embeddings WHERE vec_id % 20 = 0")
def ivf_recall(spark, sf_dir):
    """Whether the calibrated number of cells finds 90 % of the true neighbours, over all questions."""
    q, rows = vectors(spark, sf_dir)
    index = vector_index(spark, sf_dir)
    true = stored(index.search(q, 10, index.cells).select("qid", "vec_id"), "true")
    hits = index.search(q, 10).select("qid", "vec_id").join(true, ["qid", "vec_id"], "left_semi")
    return q.agg(F.count(F.lit(1)).alias("n_questions")).withColumn("recall_enough", F.lit(hits.count() >= 0.9 * true.count()))


FRESH = "fresh AS (SELECT * REPLACE (text || ' (new)' AS text, CASE WHEN chunk_index % 2 = 0 THEN -1 ELSE page_start END AS page_start) FROM chunks WHERE source_file = 'src1')"


@query(f"WITH {S.CHUNKS}, {FRESH} SELECT chunk_id, doc_id, page_start, text FROM chunks WHERE source_file IS DISTINCT FROM 'src1' AND source_file IS DISTINCT FROM 'src2' UNION ALL SELECT chunk_id, doc_id, page_start, text FROM fresh")
def committed_changes(spark, sf_dir):
    """An upsert and a deletion as commits; the first version stays readable and untouched files stay as they are."""
    rows = chunk_rows(spark, sf_dir).select("chunk_id", "doc_id", "source_file", "chunk_index", "page_start", "text")
    t = Table(spark, scratch(spark, "table"))
    t.create(rows)
    fresh = rows.where("source_file = 'src1'").withColumns({"text": F.concat("text", F.lit(" (new)")), "page_start": F.when(F.col("chunk_index") % 2 == 0, None).otherwise(F.col("page_start"))})
    t.upsert(fresh)
    t.delete(rows.where("source_file = 'src2'"))
    return t.read().select("chunk_id", "doc_id", "page_start", "text")


@query(f"WITH {S.CHUNKS} SELECT chunk_id, doc_id, text FROM chunks WHERE source_file IS DISTINCT FROM 'src1' UNION ALL SELECT chunk_id || 'n', doc_id, lower(text) FROM chunks WHERE source_file = 'src1' AND section <> 'Discussion'")
def committed_rebuild(spark, sf_dir):
    """Documents replaced by their new chunks in one version."""
    rows = chunk_rows(spark, sf_dir).select("chunk_id", "doc_id", "section", "text")
    t = Table(spark, scratch(spark, "table"))
    t.create(rows)
    ids = table(spark, sf_dir, "documents").where("source = 'src1'").select("doc_id")
    t.rebuild(rows.where("section <> 'Discussion'").withColumns({"chunk_id": F.concat("chunk_id", F.lit("n")), "text": F.lower("text")}), ids)
    return t.read().select("chunk_id", "doc_id", "text")

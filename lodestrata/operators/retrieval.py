"""Lexical and dense search, fusion, boosts. Questions are rows keyed by qid, so any number of them is one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Lexicon, Settings
from ..functions.session import stored
from .ranking import ranked, top

SETTINGS = Settings()
#: Question terms that may be sent to all tasks (about 50 bytes each).
BROADCAST_ROWS = 1_000_000
#: Components of the rows that meet a part of the questions in one task (32 MB).
SLICE = 1 << 22
#: Hits (about 100 bytes each) that may be sent to all tasks, and bytes of texts whose letters are counted together.
BROADCAST_HITS, LETTERS = 1 << 18, 1 << 20


def filtered(rows: DataFrame, doc_ids: list | None = None, sections: list | None = None, source_files: list | None = None, most: int | None = SETTINGS.max_filter_items) -> DataFrame:
    """Rows whose doc_id, section and source_file are in the lists (each cut to ``most``); typed predicates that reach the scan."""
    for c, values in (("doc_id", doc_ids), ("section", sections), ("source_file", source_files)):
        if values:
            rows = rows.where(F.col(c).isin(list(values)[:most] if most else list(values)))
    return rows


def filter_ladder(doc_ids: list | None, sections: list | None, source_files: list | None) -> list[tuple[str, dict]]:
    """Filter variants from the first to try to the last, without repeats: sections go first, then files, then all."""
    steps = []
    if sections:
        steps.append(("without_sections", {"doc_ids": doc_ids, "source_files": source_files}))
    steps.append(("as_given", {"doc_ids": doc_ids, "sections": sections, "source_files": source_files}))
    if source_files:
        steps.append(("documents_only", {"doc_ids": doc_ids}))
    steps.append(("none", {}))
    out: list[tuple[str, dict]] = []
    for name, f in steps:
        f = {k: v for k, v in f.items() if v}
        if f not in [x for _, x in out]:
            out.append((name, f))
    return out


def first_answering(questions: DataFrame, attempts: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The rows of the first attempt that has any, for each question, with ``attempt``, its number. Each attempt is made for the questions
    that none before it has answered, and when there are none left the rest is not made: answered questions reach no later rung."""
    out = None
    for i, attempt in enumerate(attempts):
        found = stored(attempt(questions).withColumn("attempt", F.lit(i)), "attempt")
        out = found if out is None else out.unionByName(found)
        if i + 1 == len(attempts):
            break
        questions = stored(questions.join(found.select("qid").distinct(), "qid", "left_anti"), "unanswered")
        if questions.isEmpty():
            break
    return out


def question_terms(questions: DataFrame, tokenize=T.tokens) -> DataFrame:
    """qid, term, qf: how often a question has a term; repeats count."""
    each = questions.select("qid", F.explode(tokenize("question")).alias("term"))
    return each.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qf"))


def term_counts(rows: DataFrame, text: Column, wanted: DataFrame | None = None, key: str = "chunk_id", tokenize=T.tokens) -> DataFrame:
    """Postings key, dl (tokens of the row), term, tf; only of the wanted terms if given, before anything is shuffled for them.

    A term's postings are combined in the map task, so a frequent term makes one row for each text at most.
    """
    each = rows.select(key, tokenize(text).alias("_t")).select(key, F.size("_t").cast("long").alias("dl"), F.explode("_t").alias("term"))
    if wanted is not None:
        each = each.join(wanted.select("term").distinct(), "term", "left_semi")
    return each.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def wanted_postings(rows: DataFrame, text: Column, wanted: DataFrame, key: str = "chunk_id", tokenize=T.tokens) -> DataFrame:
    """Postings key, dl, term, tf of the wanted terms, dealt by key, and one of the empty term for each row, from one pass over the texts."""
    each = rows.select(key, tokenize(text).alias("_t")).select(key, F.size("_t").cast("long").alias("dl"), F.explode(F.concat("_t", F.array(F.lit("")))).alias("term"))
    asked = wanted.select("term").unionByName(rows.sparkSession.createDataFrame([("",)], "term string")).distinct()
    return each.join(asked, "term", "left_semi").repartition(key).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(rows: DataFrame, text: Column, tokenize=T.tokens) -> DataFrame:
    """One row: n_rows, avgdl."""
    return rows.select(F.size(tokenize(text)).alias("_n")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.avg("_n"), F.lit(0.0)).alias("avgdl"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(questions: DataFrame, rows: DataFrame, limit: int | None = SETTINGS.bm25_limit, text: Column | None = None, k1: float = SETTINGS.k1, b: float = SETTINGS.b, key: str = "chunk_id", tokenize=T.tokens, only: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """qid, key, bm25_score, bm25_rank: the ``limit`` best rows of each question with a score above 0, ties by key.

    Statistics are of all rows even if only some (``only``, by key; ``pairs``, by qid and key) may be found; without a limit all are ranked. A question's repeated term counts repeatedly.
    Texts are split once: the postings of the questions' terms, and each row's length as that of an empty term, are a stored table that
    is dealt by key, so all postings of a row meet in one task and its score for a question is summed there before it is shuffled.
    """
    text = T.headed("title", "section", "source_file", "doc_id", "text") if text is None else text
    wanted = stored(question_terms(questions, tokenize), "terms")
    held = stored(wanted_postings(rows, text, wanted, key, tokenize), "postings")
    postings, lengths = held.where("term != ''"), held.where("term = ''")
    stats = lengths.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    idf = F.log1p((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0)))
    found = postings if only is None else postings.join(only.select(key), key, "left_semi")
    weights = wanted.join(document_frequency(postings), "term").crossJoin(F.broadcast(stats))  # the statistics are one row
    if wanted.count() <= BROADCAST_ROWS:  # postings stay where they are; with more terms both sides are dealt by term
        weights = F.broadcast(weights)
    each = found.join(weights, "term").withColumn("_w", idf * F.col("tf") * (k1 + 1) / norm)
    scored = each.groupBy("qid", key).agg(F.round(F.sum(F.col("qf") * F.col("_w")), 6).alias("bm25_score")).where("bm25_score > 0")
    if pairs is not None:
        scored = scored.join(pairs, ["qid", key], "left_semi")
    order = [F.desc("bm25_score"), F.col(key)]
    return ranked(scored, ["qid"], order, "bm25_rank") if limit is None else top(scored, ["qid"], order, limit, "bm25_rank")


def dense(questions: DataFrame, rows: DataFrame, limit: int = SETTINGS.dense_limit, floor: float = SETTINGS.score_floor, key: str = "chunk_id", block: int = 2048, own: bool = False) -> DataFrame:
    """qid, key, vector_score, dense_rank: exact cosine search, 6 places; the floor applies after the limit.

    questions: qid, v; rows: key, v (arrays of double). Up to ``block`` questions go to all tasks, and rows stay where they are. More
    never meet the driver: questions and rows are cut into parts (of ``block`` questions, and of SLICE components of rows), and each pair of parts is a task's, which
    keeps the ``limit`` best of its rows for each of its questions; these meet in a window. The pairs grow with questions times rows, as the
    search is exact; a task's memory doesn't grow.
    With own=False a row whose key is the question's id isn't its own neighbour. Null, zero and other-length vectors score 0.
    """
    spark, schema = rows.sparkSession, f"qid {dict(questions.dtypes)['qid']}, {key} {dict(rows.dtypes)[key]}, vector_score double"
    asked, rows = questions.select("qid", "v"), rows.select(key, "v")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(0, size.width or 0)
    if not size.n:
        return spark.createDataFrame([], schema + ", dense_rank int")
    if size.n <= block:
        some = asked.toArrow().combine_chunks()

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Nearest(some["qid"].combine_chunks(), matrix_of(some["v"].combine_chunks(), width), limit, own)
            for b in batches:
                near.add(b.column(key), matrix_of(b.column("v"), width))
            if near.held:
                yield from near.rows(key).to_batches()

        out = rows.mapInArrow(search, schema)
    else:
        parts = -(-size.n // block)
        slices = max(1, -(-rows.count() * max(1, width) // SLICE))
        place = lambda c, n: F.pmod(F.xxhash64(c, "v"), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = asked.select("qid", "v", place("qid", parts).alias("part"), every(slices).alias("slice"))
        dealt = rows.select(key, "v", place(key, slices).alias("slice"), every(parts).alias("part"))

        def meet(some: pa.Table, rows: pa.Table) -> pa.Table:
            near = Nearest(some["qid"].combine_chunks(), matrix_of(some["v"].combine_chunks(), width), limit, own)
            for lo in range(0, len(rows), 4096):
                one = rows.slice(lo, 4096)
                near.add(one[key].combine_chunks(), matrix_of(one["v"].combine_chunks(), width))
            return near.rows(key) if near.held else pa.table({"qid": near.ids[:0], key: rows[key][:0], "vector_score": pa.array([], pa.float64())})

        to = lambda n: F.col(n).cast("long").alias(n)
        asked, dealt = asked.select("qid", "v", to("part"), to("slice")), dealt.select(key, "v", to("part"), to("slice"))
        out = asked.groupBy("part", "slice").cogroup(dealt.groupBy("part", "slice")).applyInArrow(meet, schema)
    return top(out, ["qid"], [F.desc("vector_score"), F.col(key)], limit, "dense_rank").where(F.col("vector_score") >= floor)


class Nearest:
    """The ``limit`` best rows of each question so far, ties to the smaller key, null first.

    Single precision rules out most rows: what it gives is off by less than ``slack``, so no row of the best is lost. The others are scored in double
    precision, and kept until there are many, when they are cut to the best.
    """

    def __init__(self, ids: pa.Array, vectors: np.ndarray, limit: int, own: bool):
        self.ids, self.vectors, self.limit, self.own = ids, vectors, limit, own
        self.lengths = np.linalg.norm(vectors, axis=1)
        self.unit, self.slack = unit(vectors, self.lengths), 4e-6 + 2.5e-7 * (vectors.shape[1] + 8)
        self.least, self.held, self.n = np.full(len(ids), -np.inf), [], 0

    def add(self, keys: pa.Array, x: np.ndarray) -> None:
        if not len(keys) or not len(self.ids) or not x.shape[1]:
            return
        with np.errstate(invalid="ignore", over="ignore"):
            lengths = np.linalg.norm(x, axis=1)
            near = unit(x, lengths)
            most = self.limit + (not self.own) + int(np.isinf(lengths).sum())  # rows that may not count are no reason to leave out others
            whole = pa.types.is_integer(self.ids.type) and pa.types.is_integer(keys.type)
            ids, names = (c.cast(pa.int64()) if whole else c for c in (self.ids, keys))
            same = None if self.own or ids.type != names.type else pc.fill_null(pc.index_in(names, value_set=ids), -1).to_numpy()
            step = max(1, (1 << 22) // len(keys))
            for lo in range(0, len(self.ids), step):
                score = self.unit[lo : lo + step] @ near.T
                least = self.least[lo : lo + step]
                if most < len(keys):
                    least = np.maximum(least, np.partition(score, -most, axis=1)[:, -most])
                q, at = np.nonzero(score >= (least - self.slack).astype(np.float32)[:, None])
                for i in range(0, len(q), 1 << 18):
                    self._exact(q[i : i + (1 << 18)] + lo, at[i : i + (1 << 18)], keys, x, lengths, same)

    def _exact(self, q: np.ndarray, at: np.ndarray, keys: pa.Array, x: np.ndarray, lengths: np.ndarray, same: np.ndarray | None) -> None:
        scale = self.lengths[q] * lengths[at]
        score = np.round(np.divide(np.einsum("ij,ij->i", self.vectors[q], x[at]), scale, out=np.zeros(len(q)), where=scale > 0), 6)
        keep = np.isfinite(score) & (score >= self.least[q])
        if same is not None:
            keep &= same[at] != q
        self.held.append(pa.table({"q": q[keep], "s": score[keep], "key": keys.take(pa.array(at[keep]))}))
        self.n += int(keep.sum())
        if self.n > max(1 << 20, 4 * self.limit * len(self.ids)):
            self._cut()

    def _cut(self) -> None:
        t = pa.concat_tables(self.held)
        by_key = np.empty(len(t), np.int64)
        by_key[pc.sort_indices(t["key"], null_placement="at_start").to_numpy()] = np.arange(len(t))
        order = np.lexsort((by_key, -t["s"].to_numpy(), t["q"].to_numpy()))
        q = t["q"].to_numpy()[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        t = t.take(pa.array(order[nth < self.limit]))
        last = np.flatnonzero(nth == self.limit - 1)
        self.least[q[last]] = t["s"].to_numpy()[np.flatnonzero(nth[nth < self.limit] == self.limit - 1)]
        self.held, self.n = [t], len(t)

    def rows(self, key: str) -> pa.Table:
        """qid, key, vector_score"""
        self._cut()
        t = self.held[0]
        return pa.table({"qid": self.ids.take(t["q"].combine_chunks()), key: t["key"], "vector_score": t["s"]})


def unit(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The vectors at length 1 in single precision; those without a length that is a number above 0 as zeros."""
    fine = (lengths > 0) & np.isfinite(lengths)
    return np.divide(x, lengths[:, None], out=np.zeros(x.shape), where=fine[:, None]).astype(np.float32)


class Best:
    """The ``limit`` best rows of each question that a task has seen so far, ties to the smaller key: one table of limit columns for the questions."""

    def __init__(self, ids: list, limit: int, own: bool):
        self.ids, self.limit, self.own = ids, limit, own
        self.score = np.full((len(ids), limit), -np.inf)
        self.key = np.empty((len(ids), limit), object)
        self.type: pa.DataType | None = None

    def add(self, which: np.ndarray, score: np.ndarray, keys: pa.Array, asked: dict) -> None:
        """score: of questions ``which`` (rows) with keys (columns). asked: a question's place by its id, for rows that are questions themselves."""
        if not len(which):
            return
        self.type = keys.type
        names = np.empty(len(keys), object)
        names[:] = keys.to_pylist()
        if not self.own:
            row = {q: i for i, q in enumerate(which.tolist())}
            for j, k in enumerate(names):
                if (i := row.get(asked.get(k, -1))) is not None:
                    score[i, j] = -np.inf
        least = self.score[which, -1]
        q, at = np.nonzero((score >= least[:, None]) & np.isfinite(score))
        for i in np.unique(q):
            new = at[q == i]
            if len(new) > 4 * self.limit:  # most batches: only what can be among the best is sorted
                last = np.partition(score[i, new], -self.limit)[-self.limit]
                new = new[score[i, new] >= last]
            k = which[i]
            have = np.isfinite(self.score[k])
            s, n = np.r_[self.score[k][have], score[i, new]], [*self.key[k][have], *names[new]]
            order = sorted(range(len(n)), key=lambda x: (-s[x], n[x] is None, n[x]))[: self.limit]
            self.score[k, : len(order)] = s[order]
            self.key[k, : len(order)] = [n[x] for x in order]

    def rows(self, key: str) -> Iterator[pa.RecordBatch]:
        q, at = np.nonzero(np.isfinite(self.score))
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array([self.ids[i] for i in q]), pa.array(self.key[q, at].tolist(), self.type), pa.array(self.score[q, at])], names=["qid", key, "vector_score"])


def rows_of(vectors: list, width: int) -> np.ndarray:
    """matrix_of for collected vectors."""
    return matrix_of(pa.array([None if v is None else list(v) for v in vectors], pa.list_(pa.float64())), width)


def matrix_of(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; null ones, those of another length, and null components as zeros."""
    fine = np.array(pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False))
    out = np.zeros((len(vectors), width))
    out[fine] = pc.fill_null(vectors.filter(pa.array(fine)).flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def letter_vectors(rows: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, v: ``text.letter_vector`` of each row's text, its letters counted in one pass over the bytes instead of one for each letter."""
    place = np.full(256, 26, np.int64)
    place[ord("a") : ord("z") + 1] = np.arange(26)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, n = b.column("low"), b.num_rows
            wide = pa.types.is_large_string(low.type)
            off = np.frombuffer(low.buffers()[1], np.int64 if wide else np.int32)[low.offset : low.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
            data = np.frombuffer(low.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
            off, out = off - off[0], np.zeros((n, 27))
            for lo in range(0, len(data), LETTERS):
                hi = min(lo + LETTERS, len(data))
                first, last = np.searchsorted(off, lo, "right") - 1, np.searchsorted(off, hi, "left")  # rows with bytes from lo to hi
                row = np.repeat(np.arange(last - first), np.diff(np.clip(off[first : last + 1], lo, hi)))
                out[first:last] += np.bincount(row * 27 + place[data[lo:hi]], minlength=(last - first) * 27).reshape(-1, 27)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 26, pa.int32()), pa.array(out[:, :26].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(key), vectors], names=[key, "v"])

    low = F.lower(F.coalesce(text, F.lit(""))).alias("low")
    return rows.select(key, low).mapInArrow(count, f"{key} {dict(rows.dtypes)[key]}, v array<double>")


def with_rows(found: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits with their rows' columns. Hits are stored first, so their number is known: up to BROADCAST_HITS go to the rows, whose texts aren't shuffled; more meet by key."""
    found = stored(found, "fused")
    return (F.broadcast(found) if found.count() <= BROADCAST_HITS else found).join(rows, key)


def fuse(runs: list[tuple[DataFrame, str, str, float]], limit: int, k: int = SETTINGS.rrf_k, key: str = "chunk_id") -> DataFrame:
    """Weighted reciprocal rank fusion of runs (rows, score column, rank column, weight): qid, key, vector_score, bm25_score,
    fusion_score, rank. A weight may be a column of the run. Scores are each row's best; ties go to dense rows, then by key."""
    both = None
    for rows, score, rank, weight in runs:
        w = F.col(weight) if isinstance(weight, str) else F.lit(float(weight))
        is_dense = score == "vector_score"
        part = rows.select("qid", key, (F.col(score) if is_dense else F.lit(0.0)).alias("vector_score"), (F.lit(0.0) if is_dense else F.col(score)).alias("bm25_score"), (w / (k + F.col(rank))).alias("_part"))
        both = part if both is None else both.unionByName(part)
    fused = both.groupBy("qid", key).agg(F.max("vector_score").alias("vector_score"), F.max("bm25_score").alias("bm25_score"), F.round(F.sum("_part"), 8).alias("fusion_score"))
    return top(fused, ["qid"], fused_order(key), limit)


def fused_order(key: str = "chunk_id") -> list[Column]:
    return [F.desc("fusion_score"), F.desc(F.col("vector_score") > 0), F.desc("vector_score"), F.desc("bm25_score"), F.col(key)]


def routed(questions: DataFrame, lexicon: Lexicon = SETTINGS.lexicon, s: Settings = SETTINGS) -> DataFrame:
    """questions with intent, requires_external_tools, search_limit, rerank_top_k by the first rule that fits."""
    q = F.lower("question")
    intent = (
        F.when(T.has_any(q, lexicon.comparison), "comparison").when(T.has_any(q, lexicon.summary), "summary").when(T.has_any(q, lexicon.experiment), "experiment")
        .when(T.has_any(q, lexicon.factoid), "factoid").when(F.col("question").rlike("[?？]"), "factoid").otherwise("unknown")
    )
    out = questions.withColumn("intent", intent)
    more = F.when(F.col("intent") == "comparison", 8).when(F.col("intent").isin("summary", "experiment"), 5).otherwise(0)
    return out.withColumns({"requires_external_tools": F.col("intent") == "experiment", "search_limit": (more + s.search_limit).cast("long"), "rerank_top_k": (F.when(F.col("intent") == "comparison", 2).otherwise(0) + s.rerank_top_k).cast("long")})


def expanded(question: Column | str, lexicon: Lexicon = SETTINGS.lexicon) -> Column:
    """The question with the other names of each thing it names and, if it asks for a route, the terms of each thing's pathway."""
    low = F.lower(T.col(question))
    extra, route = [], T.has_any(question, lexicon.route_markers)
    for name, terms in lexicon.pathways:
        asked = F.when(route & F.contains(low, F.lit(name)), F.array(*map(F.lit, terms))).otherwise(F.array().cast("array<string>"))
        extra.append(F.filter(asked, lambda a: ~F.contains(low, a)))
    for group in lexicon.aliases:
        named = T.has_any(low, group)
        extra.append(F.filter(F.when(named, F.array(*map(F.lit, group))).otherwise(F.array().cast("array<string>")), lambda a: ~F.contains(low, a)))
    return F.concat_ws(" ", T.col(question), F.array_distinct(F.concat(*extra)))


COMPARE = r"(?i)^\s*(?:please )?(?:请|请你|请基于文库|请根据文库)?\s*(?:compare|difference between|比较|对比|相比)?\s*"
BETWEEN = T.edges(r"(?i)\s*(?:,|，|、|以及|及|\band\b|和|与|\bvs\.?|\bversus\b)\s*")


def _objects(span: Column) -> Column:
    parts = F.transform(F.split(F.regexp_replace(span, r"(在当前文库|在文库|在本研究|请分别说明|请说明|分别说明|说明).*$", ""), BETWEEN), lambda p: F.btrim(p, F.lit(" ;；，,。")))
    return F.filter(parts, lambda p: F.char_length(p) >= 2)


def _spans(question: Column | str) -> tuple[Column, Column, Column]:
    """(what stands before the first colon or sentence end, what stands after it, whether it is a colon)"""
    body = F.regexp_replace(F.coalesce(T.col(question), F.lit("")), COMPARE, "")
    return F.regexp_extract(body, r"^[^.?!:：。？！]*", 0), F.regexp_extract(body, r"(?s)^[^.?!:：。？！]*[.?!:：。？！](.*)$", 1), body.rlike(r"^[^.?!:：。？！]*[:：]")


def compared_objects(question: Column | str) -> Column:
    """What a comparison names: the parts between and, vs, versus or commas of its first sentence, at most four; after a colon if there are none before."""
    lead, rest, colon = _spans(question)
    first, second = _objects(lead), _objects(F.regexp_extract(rest, r"^[^.?!。？！]*", 0))
    found = F.when(F.size(first) >= 2, first).when(colon, second).otherwise(first)
    return F.when(F.size(found) >= 2, F.slice(found, 1, 4)).otherwise(F.array().cast("array<string>"))


def compared(question: Column | str) -> Column:
    """A search for each thing that a comparison names: the thing, and what the question says of them all."""
    lead, rest, colon = _spans(question)
    objects = compared_objects(question)
    shared = F.when(F.size(_objects(lead)) >= 2, F.regexp_replace(F.btrim(rest), "^请(分别)?说明|^它们", "")).otherwise(F.when(colon, lead).otherwise(F.lit("")))
    shared = F.btrim(F.regexp_replace(F.translate(shared, ":：", "  "), T.WHITE, " "))
    return F.transform(objects, lambda o: F.btrim(F.concat_ws(" ", o, shared)))


def variants(routed_questions: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """qid, variant (0: the question), question, weight, bm25_weight: the searches that a question stands for."""
    c = F.col("intent") == "comparison"
    parts = F.when(c, compared("question")).otherwise(F.array().cast("array<string>"))
    first = F.array(F.struct(expanded("question", s.lexicon).alias("question"), F.when(c, s.comparison_weight).otherwise(1.0).alias("weight")))
    rest = F.transform(parts, lambda p: F.struct(p.alias("question"), F.lit(s.subquery_weight).alias("weight")))
    each = routed_questions.select("qid", F.col("question").alias("_original"), F.posexplode(F.concat(first, rest)).alias("variant", "v"))
    cjk = F.when(F.col("_original").rlike(T.CJK), s.cjk_bm25_weight).otherwise(1.0)
    return each.select("qid", F.col("variant").cast("long").alias("variant"), F.col("v.question").alias("question"), F.col("v.weight").alias("weight"), (F.col("v.weight") * cjk).alias("bm25_weight"))


def title_boost(hits: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """hits (qid, question, title, section, text, fusion_score, ...) boosted for alias groups that question and title, or abstract, share."""
    q, title, body = F.lower("question"), F.lower(F.coalesce("title", F.lit(""))), F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 600))
    boost, matched = F.lit(0.0), F.lit(0)
    for group in s.lexicon.aliases:
        named, in_title = T.has_any(q, group), T.has_any(title, group)
        boost = boost + F.when(named & in_title, s.title_boost).otherwise(0.0) + F.when(named & (F.lower(F.coalesce("section", F.lit(""))) == "abstract") & T.has_any(body, group), s.title_boost * 0.7).otherwise(0.0)
        matched = matched + (named & in_title).cast("int")
    hits = hits.withColumns({"_b": boost, "_m": matched})
    change = F.when(T.has_any(title, s.lexicon.review), -s.title_boost * 0.6).when(F.col("_m") >= 2, s.title_boost * 0.35).otherwise(0.0)
    boosted = F.when(F.col("_b") > 0, F.greatest(F.lit(0.0), F.col("_b") + change)).otherwise(0.0)
    return hits.withColumn("fusion_score", F.round(F.col("fusion_score") + boosted, 8)).drop("_b", "_m")


def marker_boost(question: Column, text: Column, s: Settings = SETTINGS) -> Column:
    """What a question about tables or figures adds to text that has them."""
    q, t = F.lower(question), F.lower(F.coalesce(text, F.lit("")))
    has = lambda m: F.contains(t, F.lit(m))
    table = F.when(has("[table text]"), s.table_text_boost).otherwise(0.0) + F.when(has("[table caption]"), s.table_caption_boost).otherwise(0.0)
    return F.when(T.has_any(q, s.lexicon.table), table).otherwise(0.0) + F.when(T.has_any(q, s.lexicon.figure) & has("[figure caption]"), s.figure_caption_boost).otherwise(0.0)


def structure_boost(hits: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    return hits.withColumn("fusion_score", F.round(F.col("fusion_score") + marker_boost(F.col("question"), F.col("text"), s), 8))


def reranked_by_fusion(hits: DataFrame) -> DataFrame:
    return ranked(hits, ["qid"], fused_order())


def diversified(hits: DataFrame, limit: int, cap: int = SETTINGS.per_doc_cap) -> DataFrame:
    """The first ``limit`` hits; for comparisons at most cap of a document come before the rest."""
    nth = F.when(F.col("intent") == "comparison", F.col("_nth") > cap).otherwise(F.lit(False))
    return top(ranked(hits, ["qid", "doc_id"], [F.col("rank")], "_nth"), ["qid"], [nth, F.col("rank")], limit).drop("_nth")


def body_expansion(pool: DataFrame, s: Settings = SETTINGS, docs: int = 5, per_doc: int = 2, total: int = 8, first_rank: int = 20) -> DataFrame:
    """Body chunks added for the first documents of which fewer than three are shown: qid, chunk_id, doc_id, doc_rank, expansion_score, added (from 1).

    pool: qid, chunk_id, doc_id, section, rank, shown, vector_score, bm25_score of all raw hits, each once; ``shown`` marks
    those in the answer so far. At most per_doc are added for each of ``docs`` documents, ``total`` in all.
    """
    body, w = F.col("section").isin(*s.lexicon.body_sections), Window.partitionBy("qid", "doc_id")
    rows = pool.withColumns({"doc_rank": F.min(F.when(F.col("shown"), F.col("rank"))).over(w), "_n": F.sum((F.col("shown") & body).cast("int")).over(w)})
    rows = rows.where((F.col("doc_rank") <= first_rank) & (F.col("_n") < 3))
    rows = rows.withColumn("_d", F.dense_rank().over(Window.partitionBy("qid").orderBy("doc_rank", "doc_id"))).where((F.col("_d") <= docs) & ~F.col("shown") & body)
    rows = rows.withColumn("expansion_score", T.six(F.greatest("vector_score", F.col("bm25_score") * 0.01)))
    rows = top(rows, ["qid", "doc_id"], [F.desc("expansion_score"), F.desc("vector_score"), F.desc("bm25_score"), F.col("chunk_id")], per_doc, "_k")
    return top(rows, ["qid"], [F.col("doc_rank"), F.col("doc_id"), F.col("_k")], total, "added").select("qid", "chunk_id", "doc_id", "doc_rank", "expansion_score", "added")


def body_candidates(questions: DataFrame, rows: DataFrame, needs: DataFrame, k: int, s: Settings = SETTINGS) -> DataFrame:
    """The k best body chunks of each document that a question still needs them of (needs: qid, doc_id): qid, chunk_id, doc_id, section,
    bm25_score. One lexical search for all; statistics are those of all rows, as in any filtered search."""
    body = rows.where(F.col("section").isin(*s.lexicon.body_sections)).select("chunk_id", "doc_id", "section").join(needs.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = body.join(needs.select("qid", "doc_id"), "doc_id")
    found = bm25(questions, rows, limit=None, only=body, pairs=pairs.select("qid", "chunk_id")).drop("bm25_rank").join(pairs, ["qid", "chunk_id"])
    return top(found, ["qid", "doc_id"], [F.desc("bm25_score"), F.col("chunk_id")], k, "_k").select("qid", "chunk_id", "doc_id", "section", "bm25_score")


def expanded_bodies(pool: DataFrame, questions: DataFrame, rows: DataFrame, s: Settings = SETTINGS, per_doc: int = 2, **limits) -> DataFrame:
    """body_expansion over the pool and, for documents of which it has fewer than per_doc body chunks to add, a second search among their own."""
    body = F.col("section").isin(*s.lexicon.body_sections)
    per = pool.groupBy("qid", "doc_id").agg(F.max("shown").alias("_shown"), F.sum((~F.col("shown") & body).cast("int")).alias("_n"))
    more = body_candidates(questions, rows, per.where(F.col("_shown") & (F.col("_n") < per_doc)), 3 * per_doc, s)
    more = more.join(pool.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    more = more.withColumns({"rank": F.lit(None).cast("long"), "shown": F.lit(False), "vector_score": F.lit(0.0)})
    names = ["qid", "chunk_id", "doc_id", "section", "rank", "shown", "vector_score", "bm25_score"]
    return body_expansion(pool.select(names).unionByName(more.select(names)), s, per_doc=per_doc, **limits)


def hybrid(questions: DataFrame, rows: DataFrame, s: Settings = SETTINGS, index=None, vectors: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """The whole search: routes, variants, dense and lexical runs, fusion, boosts, diversity: hits by qid and rank with the rows' columns.

    qid may be of any type; a variant's own id is the text of both. index (``index.Index``) and vectors (chunk_id, v) are what a library has
    stored of rows: then no text is read before fusion. only: chunk_ids that may be found.
    """
    routes = routed(questions, s.lexicon, s)
    hits = with_rows(hybrid_ids(routes, rows, s, index, vectors, only), rows).join(routes, "qid")
    return diversified(reranked_by_fusion(structure_boost(title_boost(hits, s), s)), s.search_limit, s.per_doc_cap)


def hybrid_ids(routes: DataFrame, rows: DataFrame, s: Settings = SETTINGS, index=None, vectors: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """The fused runs of all variants: qid, chunk_id, vector_score, bm25_score, fusion_score."""
    each = variants(routes, s).withColumn("qid2", F.concat_ws("/", F.col("qid").cast("string"), F.col("variant").cast("string")))
    run = each.select(F.col("qid2").alias("qid"), "question")
    weights = each.select(F.col("qid2").alias("qid"), F.col("qid").alias("_q"), "weight", "bm25_weight")
    vectors = letter_vectors(rows) if vectors is None else vectors
    vectors = vectors if only is None else vectors.join(only.select("chunk_id"), "chunk_id", "left_semi")
    d = dense(run.select("qid", T.letter_vector("question").alias("v")), vectors, s.dense_limit, s.score_floor)
    b = bm25(run, rows, s.bm25_limit, only=only) if index is None else index.search(run, s.bm25_limit, only=only)
    back = lambda df: df.join(weights, "qid").drop("qid").withColumnRenamed("_q", "qid")
    return fuse([(back(d), "vector_score", "dense_rank", "weight"), (back(b), "bm25_score", "bm25_rank", "bm25_weight")], max(3 * s.search_limit, s.search_limit + 12), s.rrf_k).drop("rank")


def merged_by_key(dense_run: DataFrame, bm25_run: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Full outer join of the two runs with unweighted reciprocal ranks: merged_score, rank."""
    both = dense_run.join(bm25_run, ["qid", key], "full_outer")
    r = lambda c: F.coalesce(1.0 / (60 + F.col(c)), F.lit(0.0))
    both = both.withColumn("merged_score", F.round(r("dense_rank") + r("bm25_rank"), 8))
    return ranked(both, ["qid"], [F.desc("merged_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.col(key)])


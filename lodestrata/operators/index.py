"""A lexical index in tables, searched without the texts: postings in blocks by term and range of rows, each with a bound of what it can score.

A range's blocks of one bucket are one packed row, since most terms are rare: rows by term would be nearly as many as postings. Postings
are bytes in it, so they pass between the JVM and Python as a whole and not number by number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import Settings
from ..functions.session import scratch, settle, stored
from ..sources.commits import Conflict, Log
from .ranking import top
from .retrieval import BROADCAST_ROWS, question_terms

SETTINGS = Settings()
#: Rows of a range are 2**RANGE; a question's first ranges, by bound, that are scored before others are ruled out; ranges up to which all are scored at once.
RANGE, FIRST, FEW = 10, 4, 64
#: Tokens for which an index gets a bucket of files more, and most of them.
BUCKET_TOKENS, MOST_BUCKETS = 4_000_000, 1024
SLACK = 2e-6
#: Questions that are scored together, terms of a range that are.
TOGETHER, TERMS = 1024, 2048
#: Rows whose tokens are packed together, and how segments are laid out.
PACKED, LAYOUT = 1 << 14, 3
#: Columns of postings, and the numbers that their bytes hold.
FLAT = ("at", "tf", "dl")
NUMBER = np.dtype("<i4")
#: What parts a row's tokens on their way to the tasks that make blocks.
BETWEEN = "\0"


@dataclass(frozen=True)
class Segment:
    """What one addition has made: a folder, its number of rows and of tokens, and the first number of its rows."""

    name: str
    rows: int
    tokens: int
    base: int


@dataclass(frozen=True)
class Index:
    """Segments of an index at path, as one version of its log lists them.

    Tables of a segment: docs (ord, key, dl); blocks (bucket, range, terms, size, at, tf, dl), the postings of a bucket's terms in 2**RANGE
    neighbouring rows, or in a part of them: size has each term's number of postings, which follow each other in at, tf and dl as bytes (NUMBER); terms (bucket, term, df), how its
    rows change document frequencies, negative where rows go; gone (ord), rows of older segments that it takes away. A segment's name is that of a folder in path, or a whole path. Files of blocks and terms are dealt by bucket, so a search opens those of its terms; the first addition sets how many
    buckets there are.
    """

    spark: SparkSession
    path: str
    segments: tuple[Segment, ...]
    version: int = 0
    n_rows: int = 0
    tokens: int = 0
    tokenize: Callable = T.tokens
    key_type: str = "string"
    buckets: int = 0

    @staticmethod
    def build(rows: DataFrame, text: Column | None = None, key: str = "chunk_id", path: str | None = None, tokenize: Callable = T.tokens) -> Index:
        """A new index of rows, in a folder of its own under spark.checkpoint.dir if no path is named."""
        spark = settle(rows.sparkSession)
        empty = Index(spark, (path or scratch(spark, "index")).rstrip("/"), (), -1, tokenize=tokenize, key_type=dict(rows.dtypes)[key])
        return empty.changed(rows, text, key)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None, tokenize: Callable = T.tokens) -> Index:
        log = Log(spark, f"{path.rstrip('/')}/_log")
        numbers = log.numbers()
        if not numbers or (version is not None and version not in numbers):
            raise ValueError(f"there is no such index at {path}")
        e = log.read(numbers[-1] if version is None else version)
        if e.get("layout") != LAYOUT:
            raise ValueError(f"the index at {path} has another layout; build it anew")
        return Index(settle(spark), path.rstrip("/"), tuple(Segment(**s) for s in e["segments"]), e["version"], e["n_rows"], e["tokens"], tokenize, e["key_type"], e["buckets"])

    def _table(self, name: str, segments: tuple[Segment, ...] | None = None) -> DataFrame | None:
        paths = [f"{s.name if '/' in s.name else f'{self.path}/{s.name}'}/{name}" for s in (self.segments if segments is None else segments)]
        schema = {
            "docs": f"ord long, key {self.key_type}, dl long", "blocks": f"{BLOCKS}, bucket int",
            "terms": "term string, df long, bucket int", "gone": "ord long",
        }[name]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in paths])

    @property
    def docs(self) -> DataFrame:
        """ord, key, dl of the rows that are there."""
        return self._table("docs").join(self._table("gone"), "ord", "left_anti")

    def bucket(self, term: str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(max(1, self.buckets))).cast("int")

    def document_frequency(self) -> DataFrame:
        return self._table("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def statistics(self) -> tuple[int, float]:
        """(rows, their mean length), kept by each change."""
        return self.n_rows, self.tokens / self.n_rows if self.n_rows else 0.0

    def postings(self) -> DataFrame:
        """key, dl, term, tf of all rows that are there."""
        return self.docs.join(_postings(self._table("blocks"), RANGE), "ord").select("key", "dl", "term", "tf")

    def changed(self, fresh: DataFrame | None, text: Column | None = None, key: str = "chunk_id", removed: DataFrame | None = None) -> Index:
        """The index with fresh rows in the place of those of their keys, and without the keys of ``removed``: one more segment, one more version.

        Only fresh rows are tokenised; of the older ones the blocks of the ranges that lose rows are read, to take back what they added to
        document frequencies. Fresh keys are unique, as in a table; rows with a null key are left out.
        """
        name, spark = f"s-{uuid.uuid4().hex}", self.spark
        text = T.headed("title", "section", "source_file", "doc_id", "text") if text is None else text
        base = max((s.base + s.rows for s in self.segments), default=0)
        base = (base + (1 << RANGE) - 1 >> RANGE) << RANGE
        if fresh is None:
            added = (0, 0)
            self._table("docs", ()).write.parquet(f"{self.path}/{name}/docs")
            self._table("blocks", ()).write.parquet(f"{self.path}/{name}/blocks")
        else:
            each = fresh.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), self.tokenize(text).alias("t"))
            each = each.select("key", F.size("t").alias("dl"), F.array_join("t", BETWEEN).alias("t"))
            each = stored(each.withColumn("id", F.monotonically_increasing_id()), "tokens")  # texts are split once
            parts = sorted((r.p, r.n) for r in each.groupBy(F.shiftright("id", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each task
            before, offsets = base, []
            for p, n in parts:
                offsets.append((p, before - (p << 33)))
                before += n
            off = spark.createDataFrame(offsets or [(0, 0)], "_p long, _o long")
            numbered = each.join(F.broadcast(off), F.shiftright("id", 33) == F.col("_p")).select("key", "t", "dl", (F.col("id") + F.col("_o")).alias("ord"))
            docs = numbered.select("ord", "key", F.col("dl").cast("long").alias("dl"))
            docs.write.parquet(f"{self.path}/{name}/docs")
            made = spark.read.schema("ord long, dl long").parquet(f"{self.path}/{name}/docs").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("t")).first()
            added = (made.n, made.t or 0)
            self = replace(self, buckets=self.buckets or min(MOST_BUCKETS, 1 + added[1] // BUCKET_TOKENS))
            self._blocks(numbered, f"{self.path}/{name}/blocks")
        own = Segment(name, added[0], added[1], base)
        lost = self._lost(fresh, key, removed)
        lost.select("ord").write.parquet(f"{self.path}/{name}/gone")
        gone = spark.read.schema("ord long").parquet(f"{self.path}/{name}/gone")
        less = lost.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("t")).first() if self.segments else None
        new = _frequencies(self._table("blocks", (own,)))
        if less is not None and less.n:
            old = self._table("blocks").join(_places(gone, "gone"), "range").mapInArrow(_counted(1 << RANGE), "term string, n long")
            new = new.unionByName(old.groupBy("term").agg((-F.sum("n")).alias("df")))
            new = new.groupBy("term").agg(F.sum("df").alias("df"))
        _by_bucket(new.where("df <> 0").withColumn("bucket", self.bucket("term")), f"{self.path}/{name}/terms")
        out = replace(self, segments=(*self.segments, own), version=self.version + 1, n_rows=self.n_rows + added[0] - (less.n if less else 0), tokens=self.tokens + added[1] - ((less.t or 0) if less else 0))
        return out._published()

    def _published(self) -> Index:
        entry = {"version": self.version, "segments": [vars(s) for s in self.segments], "n_rows": self.n_rows, "tokens": self.tokens, "key_type": self.key_type, "buckets": self.buckets, "layout": LAYOUT}
        if not Log(self.spark, f"{self.path}/_log").publish(self.version, entry):
            raise Conflict(f"version {self.version} of the index is another writer's")
        return self

    def _lost(self, fresh: DataFrame | None, key: str, removed: DataFrame | None) -> DataFrame:
        """ord, dl of the rows that a change takes away."""
        keys = [df.select(F.col(key).alias("key")) for df in (fresh, removed) if df is not None]
        return self.docs.join(reduce(DataFrame.unionByName, keys).distinct(), "key", "left_semi").select("ord", "dl") if keys else self.docs.where("false").select("ord", "dl")

    def _blocks(self, rows: DataFrame, path: str) -> None:
        """Blocks of rows(ord, dl, t: tokens, joined): a task makes those of the rows that it has, and only they are dealt, by bucket, so no token
        travels alone. A range that lies in two batches of a task, or in two tasks, has two blocks of a term, which sum up in all that reads them."""
        _by_bucket(rows.select("ord", "dl", "t").mapInArrow(_pieces(RANGE, max(1, self.buckets)), f"{BLOCKS}, bucket int"), path)

    def branched(self, path: str | None = None) -> Index:
        """An index of its own, with a log of its own, whose segments are this one's: nothing is copied, and changes of either don't reach the other. It needs this one's folders."""
        segments = tuple(replace(s, name=s.name if "/" in s.name else f"{self.path}/{s.name}") for s in self.segments)
        return replace(self, path=(path or scratch(self.spark, "index")).rstrip("/"), segments=segments, version=0)._published()

    def compacted(self, path: str | None = None) -> Index:
        """The same rows as one segment, without those that are gone, as the next version or, with a path, as an index of its own; frequencies are counted anew."""
        name, out = f"s-{uuid.uuid4().hex}", replace(self, path=path.rstrip("/"), version=-1) if path else self
        docs = stored(self.docs, "live")
        own = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("t"), F.max("ord").alias("last")).first()
        docs.write.parquet(f"{out.path}/{name}/docs")
        rows = self._table("blocks")
        if len(self.segments) > 1:
            rows = rows.join(_places(self._table("gone"), "gone"), "range", "left").mapInArrow(_kept(1 << RANGE), f"{BLOCKS}, bucket int")
        _by_bucket(rows, f"{out.path}/{name}/blocks")
        segment = Segment(name, (own.last if own.last is not None else -1) + 1, own.t or 0, 0)  # numbers stay; base + rows is the first free one
        df = _frequencies(out._table("blocks", (segment,)))
        _by_bucket(df.withColumn("bucket", self.bucket("term")), f"{out.path}/{name}/terms")
        self._table("gone", ()).write.parquet(f"{out.path}/{name}/gone")
        return replace(out, segments=(segment,), version=out.version + 1, n_rows=own.n, tokens=own.t or 0)._published()

    def search(self, questions: DataFrame, limit: int = SETTINGS.bm25_limit, k1: float = SETTINGS.k1, b: float = SETTINGS.b, only: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
        """qid, key, bm25_score, bm25_rank of questions(qid, question): the rows that ``retrieval.bm25`` gives, without looking at a text.

        Each range of rows (all are scored where they are few) has a bound for each question: the sum, over its terms, of what the range's greatest count and least length
        could score. The few ranges of greatest bounds are scored first; their limit-th score rules out every range whose bound is
        below it, and the rest is scored, so nothing is lost. Only blocks of the questions' terms in those ranges are read with
        their postings. only: keys that may be found; the statistics stay those of all rows.
        """
        wanted = stored(question_terms(questions, self.tokenize), "terms")
        n, avgdl = self.statistics()
        buckets = [r.b for r in wanted.select(self.bucket("term").alias("b")).distinct().collect()] if self.buckets > 1 else [0]  # MOST_BUCKETS at most
        here = lambda name: self._table(name).where(F.col("bucket").isin(buckets))
        df = here("terms").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = stored(wanted.join(df, "term").select("qid", "term", (F.col("qf") * idf).alias("w")), "weights")
        allowed = None if only is None else stored(self.docs.join(only.select(F.col(key).alias("key")).distinct(), "key", "left_semi").select("ord"), "allowed")
        size = weights.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("qid").alias("q")).first()
        parts = max(1, -(-size.n // BROADCAST_ROWS), -(-size.q // TOGETHER))
        found = None
        for part in range(parts):
            asking = Asking.of(weights if parts == 1 else weights.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part), limit, k1, b, avgdl, RANGE)
            some = self._found(asking, here("blocks"), allowed)
            found = some if found is None else found.unionByName(some)
        found = stored(found, "found").join(self._table("docs").select("ord", F.col("key").alias(key)), "ord")
        return top(found, ["qid"], [F.desc("bm25_score"), F.col(key)], limit, "bm25_rank").select("qid", key, "bm25_score", "bm25_rank")

    def _found(self, asking: Asking, blocks: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """qid, ord, bm25_score: the limit best rows of each question, and what ties with the last. A range's blocks meet in one task."""
        spark, limit = self.spark, asking.limit
        last = max((s.base + s.rows for s in self.segments), default=0) >> RANGE
        schema = f"qid {asking.qid_type}, ord long, bm25_score double"

        def scored(asked: DataFrame) -> DataFrame:
            """asked: a row for each range, with its questions' numbers and the scores that they have to reach."""
            asked = asked.withColumn("allowed", F.lit(None).cast("array<int>")) if allowed is None else asked.join(_places(allowed, "allowed"), "range")
            asked = asked.withColumn("gone", F.lit(None).cast("array<int>")) if len(self.segments) < 2 else asked.join(_places(self._table("gone"), "gone"), "range", "left")
            asked = stored(asked, "asked")
            each = held.join(asked.select("range"), "range", "left_semi").select("term", "range", *FLAT)
            return _best(each.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(asking.scores, schema), limit)

        held = _each(blocks, asking.terms)
        if last <= FEW:
            every = F.array(*map(F.lit, range(len(asking.qids)))).cast("array<int>")
            return scored(spark.range(last + 1).select(F.col("id").alias("range"), every.alias("q"), F.transform(every, lambda x: F.lit(0.0)).alias("least")))
        held = stored(held, "held")  # all blocks are laid open once, and what the questions ask for is read three times
        bounds = stored(held.select("term", "range", "max_tf", "min_dl").groupBy("range").applyInArrow(asking.bounds, "q int, range long, bound double"), "bounds")
        by_range = lambda pairs: pairs.groupBy("range").agg(F.collect_list(F.struct("q", "least")).alias("p")).select("range", "p.q", "p.least")
        first = stored(top(bounds, ["q"], [F.desc("bound"), F.col("range")], FIRST, "_n").select("q", "range"), "first")
        one = stored(scored(by_range(first.withColumn("least", F.lit(0.0)))), "scored")
        numbers = spark.createDataFrame(pa.table({"qid": pa.array(asking.qids, asking.arrow_type), "q": pa.array(range(len(asking.qids)), pa.int32())}))
        least = one.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= limit, F.min("bm25_score")).alias("least")).join(F.broadcast(numbers), "qid").select("q", "least")
        rest = bounds.join(F.broadcast(least), "q", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).where(F.col("bound") >= F.col("least") - SLACK).join(F.broadcast(first), ["q", "range"], "left_anti")
        return _best(one.unionByName(scored(by_range(rest.select("q", "range", "least")))), limit)


@dataclass(frozen=True)
class Asking:
    """Some questions for a search: their ids, their terms, and a matrix of terms by questions of how often each is asked times its idf, as entries by term."""

    qids: list
    qid_type: str
    arrow_type: pa.DataType
    terms: list[str]
    first: np.ndarray
    question: np.ndarray
    weight: np.ndarray
    limit: int
    k1: float
    b: float
    avgdl: float
    range_: int

    @staticmethod
    def of(weights: DataFrame, limit: int, k1: float, b: float, avgdl: float, range_: int) -> Asking:
        """weights: qid, term, w, of TOGETHER questions or so: what all tasks get."""
        t = weights.select("qid", "term", "w").toArrow()
        ids, words = (t.column(c).combine_chunks().dictionary_encode() for c in ("qid", "term"))
        number = words.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(number, kind="stable")
        first = np.searchsorted(number[order], np.arange(len(words.dictionary) + 1))
        question = ids.indices.to_numpy(zero_copy_only=False)[order] if len(t) else np.zeros(0, np.int32)
        return Asking(ids.dictionary.to_pylist(), dict(weights.dtypes)["qid"], ids.dictionary.type, words.dictionary.to_pylist(), first, question, t.column("w").to_numpy()[order], limit, k1, b, avgdl, range_)

    def matrix(self, terms: list[str], place: dict[str, int]) -> np.ndarray:
        """Weights of the terms (rows) in the questions (columns)."""
        n = np.array([place[t] for t in terms], np.int64)
        size = self.first[n + 1] - self.first[n]
        at = np.arange(size.sum()) + np.repeat(self.first[n] - np.cumsum(size) + size, size)
        out = np.zeros((len(n), len(self.qids)))
        out[np.repeat(np.arange(len(n)), size), self.question[at]] = self.weight[at]
        return out

    def part(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / max(self.avgdl, 1.0)))

    @property
    def bounds(self) -> Callable:
        """Of one range's blocks: each question's bound of what a row of it can score, where it is above 0."""
        place = {t: i for i, t in enumerate(self.terms)}

        def bound(blocks: pa.Table) -> pa.Table:
            most = np.zeros(len(self.qids))
            for lo in range(0, len(blocks), TERMS):
                some = blocks.slice(lo, TERMS)
                most += self.part(some["max_tf"].to_numpy().astype(float), some["min_dl"].to_numpy().astype(float)) @ self.matrix(some["term"].to_pylist(), place)
            q = np.nonzero(most > 0)[0]
            return pa.table({"q": pa.array(q, pa.int32()), "range": pa.array(np.full(len(q), blocks["range"][0].as_py()), pa.int64()), "bound": most[q]})

        return bound

    @property
    def scores(self) -> Callable:
        """Of one range's blocks and what is asked of it: each question's limit best rows that reach its score, and what ties with the last."""
        place, width = {t: i for i, t in enumerate(self.terms)}, 1 << self.range_

        def score(blocks: pa.Table, asked: pa.Table) -> pa.Table:
            if not len(blocks) or not len(asked):
                return pa.table({"qid": pa.array([], self.arrow_type), "ord": pa.array([], pa.int64()), "bm25_score": pa.array([], pa.float64())})
            row = asked.to_pylist()[0]
            q, out = np.array(row["q"], np.int64), np.zeros((len(row["q"]), width))
            for lo in range(0, len(blocks), TERMS):
                some = blocks.slice(lo, TERMS)
                flat = {c: _numbers(some[c].combine_chunks()) for c in FLAT}
                part = np.zeros((len(some), width))
                part[np.repeat(np.arange(len(some)), pc.binary_length(some["at"]).to_numpy() // NUMBER.itemsize), flat["at"]] = self.part(flat["tf"].astype(float), flat["dl"].astype(float))
                out += self.matrix(some["term"].to_pylist(), place)[:, q].T @ part
            out = np.round(out, 6)
            if row["allowed"] is not None:
                found = np.zeros(width, bool)
                found[row["allowed"]] = True
                out[:, ~found] = 0
            if row["gone"]:
                out[:, row["gone"]] = 0
            least = np.array(row["least"], float)
            if self.limit < width:
                least = np.maximum(least, np.partition(out, -self.limit, axis=1)[:, -self.limit])
            i, at = np.nonzero((out > 0) & (out >= least[:, None]))
            qids = pa.array(self.qids, self.arrow_type).take(pa.array(q[i]))
            return pa.table({"qid": qids, "ord": pa.array(at + (row["range"] << self.range_), pa.int64()), "bm25_score": out[i, at]})

        return score


#: Columns of packed blocks, but for the bucket, by which their files are dealt.
BLOCKS = "range long, terms array<string>, size array<int>, at binary, tf binary, dl binary"


def _numbers(packed: pa.BinaryArray) -> np.ndarray:
    """The numbers of all rows, one after another."""
    data = packed.buffers()[2]
    if not len(packed) or data is None:
        return np.zeros(0, NUMBER)
    off = np.frombuffer(packed.buffers()[1], np.int64 if pa.types.is_large_binary(packed.type) else np.int32)
    return np.frombuffer(data, np.uint8)[off[packed.offset] : off[packed.offset + len(packed)]].view(NUMBER)


def _bytes(first: np.ndarray, values: np.ndarray) -> pa.BinaryArray:
    """_lists of numbers, as bytes."""
    off = (np.r_[first, len(values)] * NUMBER.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values, NUMBER))])


def _lists(first: np.ndarray, values: pa.Array | np.ndarray) -> pa.ListArray:
    """Lists of the values, of which each begins at a place of ``first`` (ascending, from 0) and ends where the next begins."""
    values = values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(np.r_[first, len(values)], pa.int32()), values)


def _starts(*by: np.ndarray) -> np.ndarray:
    """Where sorted rows begin to differ from the one before in one of the columns."""
    new = np.zeros(len(by[0]), bool)
    new[:1] = True
    for c in by:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _pieces(range_: int, buckets: int) -> Callable:
    """Rows (ord, dl, t) to packed blocks, one for each bucket and range of a batch."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, PACKED):
                b = whole.slice(lo, PACKED)
                b = b.filter(pc.greater(b.column("dl"), 0))
                if not b.num_rows:
                    continue
                words = pc.split_pattern(b.column("t"), BETWEEN).flatten().dictionary_encode()
                if len(words) != pc.sum(b.column("dl")).as_py():
                    raise ValueError("a token is null or holds U+0000, which parts tokens")
                names, n = words.dictionary, b.num_rows
                bucket = np.array([int.from_bytes(xxhash.xxh64_digest(t, 42), "big", signed=True) % buckets for t in names.cast(pa.binary()).to_pylist()] if buckets > 1 else [0] * len(names), np.int64)
                ords, dls = b.column("ord").to_numpy(), b.column("dl").to_numpy()
                order = np.argsort(ords, kind="stable")
                back = np.empty_like(order)
                back[order] = np.arange(n)
                ranges, place = np.unique(ords >> range_, return_inverse=True)
                row, word = np.repeat(np.arange(n), dls), words.indices.to_numpy().astype(np.int64)
                key, tf = np.unique(((bucket[word] * len(ranges) + place[row]) * len(names) + word) * n + back[row], return_counts=True)
                key, row = np.divmod(key, n)
                row, (outer, word) = order[row], np.divmod(key, len(names))
                each = _starts(key)  # a term's postings in a range
                pack = _starts(outer[each])
                first = each[pack]
                size = np.diff(np.r_[each, len(key)])
                bucket_of, range_of = np.divmod(outer[first], len(ranges))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranges[range_of], pa.int64()), _lists(pack, names.take(pa.array(word[each]))), _lists(pack, size), _bytes(first, ords[row] & ((1 << range_) - 1)), _bytes(first, tf), _bytes(first, dls[row]), pa.array(bucket_of, pa.int32())],
                    names=["range", "terms", "size", *FLAT, "bucket"],
                )

    return pieces


@dataclass
class Packed:
    """A batch of packed blocks, laid open: of each term in a row the row, the term and its number of postings; of each posting its term's place and at, tf, dl."""

    row: np.ndarray
    terms: pa.Array
    size: np.ndarray
    flat: dict[str, np.ndarray]

    @staticmethod
    def of(b: pa.RecordBatch) -> Packed:
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False))
        return Packed(row, b.column("terms").flatten(), b.column("size").flatten().to_numpy(), {c: _numbers(b.column(c)) for c in FLAT})

    def only(self, terms: np.ndarray) -> Packed:
        """Those of the chosen terms, by their places."""
        size = self.size[terms].astype(np.int64)
        before = np.cumsum(self.size, dtype=np.int64) - self.size
        at = np.arange(size.sum()) + np.repeat(before[terms] - np.cumsum(size) + size, size)
        return Packed(self.row[terms], self.terms.take(pa.array(terms)), size, {c: v[at] for c, v in self.flat.items()})

    def left(self, rows: pa.ListArray, width: int) -> np.ndarray:
        """Whether each posting's row is not among ``rows``, the places that go from each packed row's range."""
        gone = np.zeros((len(rows), width), bool)
        gone[np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)), rows.flatten().to_numpy()] = True
        return ~gone[np.repeat(self.row, self.size), self.flat["at"]]


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's packed rows a thousand at a time."""
    for lo in range(0, b.num_rows, 1000):
        yield b.slice(lo, 1000)


def _each(packed: DataFrame, terms: list[str]) -> DataFrame:
    """Blocks term, range, max_tf, min_dl, at, tf, dl of packed ones, of the given terms."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.string())
        for b in (part for whole in batches for part in _parts(whole)):
            p = Packed.of(b)
            p = p.only(np.flatnonzero(pc.is_in(p.terms.cast(pa.string()), value_set=wanted).to_numpy(zero_copy_only=False)))
            if not len(p.row):
                continue
            first = np.cumsum(p.size) - p.size
            bound = [pa.array(np.maximum.reduceat(p.flat["tf"], first), pa.int32()), pa.array(np.minimum.reduceat(p.flat["dl"], first), pa.int32())]
            yield pa.RecordBatch.from_arrays([p.terms, pa.array(b.column("range").to_numpy()[p.row]), *bound, *(_bytes(first, p.flat[c]) for c in FLAT)], names=["term", "range", "max_tf", "min_dl", *FLAT])

    return packed.select("range", "terms", "size", *FLAT).mapInArrow(unpack, "term string, range long, max_tf int, min_dl int, at binary, tf binary, dl binary")


def _postings(packed: DataFrame, range_: int) -> DataFrame:
    """ord, term, tf of all postings."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _parts(whole)):
            p = Packed.of(b)
            base = np.repeat(b.column("range").to_numpy()[p.row] << range_, p.size)
            terms = p.terms.take(pa.array(np.repeat(np.arange(len(p.row)), p.size)))
            yield pa.RecordBatch.from_arrays([pa.array(base + p.flat["at"], pa.int64()), terms, pa.array(p.flat["tf"], pa.int64())], names=["ord", "term", "tf"])

    return packed.select("range", "terms", "size", *FLAT).mapInArrow(unpack, "ord long, term string, tf long")


def _frequencies(packed: DataFrame) -> DataFrame:
    """term, df"""
    return packed.select(F.explode(F.arrays_zip("terms", "size")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.size").alias("df"))


def _counted(width: int) -> Callable:
    """Packed blocks with places that go (gone) to term, n: how many of its postings do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _parts(whole)):
            p = Packed.of(b)
            if len(p.row):
                n = np.add.reduceat(~p.left(b.column("gone"), width), np.cumsum(p.size) - p.size, dtype=np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([p.terms.take(pa.array(at)), pa.array(n[at], pa.int64())], names=["term", "n"])

    return count


def _kept(width: int) -> Callable:
    """Packed blocks without the postings that go."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _parts(whole)):
            p = Packed.of(b)
            if not len(p.row):
                continue
            left = p.left(b.column("gone"), width)
            size = np.add.reduceat(left, np.cumsum(p.size) - p.size, dtype=np.int64)
            at = np.flatnonzero(size)
            if not len(at):
                continue
            size, row = size[at], p.row[at]
            pack = _starts(row)
            first = (np.cumsum(size) - size)[pack]
            of = lambda c: pa.array(b.column(c).to_numpy()[row[pack]])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([of("range"), _lists(pack, p.terms.take(pa.array(at))), _lists(pack, size), *(_bytes(first, p.flat[c][left]) for c in FLAT), of("bucket")], names=["range", "terms", "size", *FLAT, "bucket"])

    return keep


def _places(rows: DataFrame, name: str) -> DataFrame:
    """range, name: the places in a range of rows(ord)."""
    at = (F.col("ord") - F.shiftleft(F.shiftright("ord", RANGE), RANGE)).cast("int")
    return rows.groupBy(F.shiftright("ord", RANGE).alias("range")).agg(F.collect_list(at).alias(name))


def _best(scored: DataFrame, limit: int) -> DataFrame:
    place = F.rank().over(Window.partitionBy("qid").orderBy(F.desc("bm25_score")))
    return scored.withColumn("_r", place).where(F.col("_r") <= limit).drop("_r")


def _by_bucket(rows: DataFrame, path: str) -> None:
    """Files by bucket; a large bucket is split, small ones are joined."""
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(path)

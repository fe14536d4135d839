"""A persisted inverted-file index of vectors: cells of a distributed k-means as table partitions, searched by reading a question's nearest cells."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import Settings
from ..functions.session import scratch, settle, stored
from ..sources.commits import Conflict, Log
from .ranking import top
from .retrieval import Best, matrix_of, rows_of

SETTINGS = Settings()
#: Most cells, rows that a cell's centroid is fitted on (about), rounds of k-means, questions that a task scores together.
MOST_CELLS, FIT_ROWS, ROUNDS, BLOCK = 4096, 256, 8, 2048
#: Questions on which the number of cells to read is found, and the share of their true neighbours that those must hold.
PROBED, RECALL = 200, 0.95


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def fitted(sample: DataFrame, cells: int, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds over sample(v), a stored table. Each task adds up its rows by nearest centroid; only sums (a row for each cell
    and task at most) are shuffled, and the centroids, of a stated greatest number, go to the driver and back. Cells that lose all rows stay."""
    start = sample.where(F.size("v") == width).orderBy(F.xxhash64("v")).limit(cells).collect()
    centroids = directions(np.array([r.v for r in start], float).reshape(len(start), width))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for b in batches:
            x = directions(matrix_of(b.column("v"), width))
            at = (x @ centroids.T).argmax(1)
            np.add.at(total, at, x)
            n += np.bincount(at, minlength=len(n))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own]), pa.array(total[own].tolist(), pa.list_(pa.float64()))], names=["cell", "n", "s"])

    for _ in range(rounds if len(centroids) else 0):
        each = sample.select("v").mapInArrow(sums, "cell long, n long, s array<double>").select("cell", F.posexplode("s").alias("i", "x"))
        found = each.groupBy("cell", "i").agg(F.sum("x").alias("x")).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).collect()
        moved = centroids.copy()
        for r in found:
            moved[r.cell] = [p.x for p in r.s]
        centroids = directions(moved)
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """An index at path. Each segment holds cells (key, v, scalar columns; a folder for each cell) and gone (keys whose older rows it takes away).

    centroids: (cells, width), one array for all segments. probes: cells that a search reads if it names no number.
    """

    spark: SparkSession
    path: str
    centroids: np.ndarray
    segments: tuple[str, ...]
    schema: str
    key: str
    version: int = -1
    probes: int = 1

    @property
    def cells(self) -> int:
        return len(self.centroids)

    @staticmethod
    def build(rows: DataFrame, key: str = "chunk_id", path: str | None = None, cells: int | None = None, rounds: int = ROUNDS) -> VectorIndex:
        """An index of rows(key, v, ...): every row is in it, centroids are fitted on about FIT_ROWS rows a cell. The most common length of vectors counts;
        null, zero and other vectors are in the cell of the zero vector and score 0, as in the scan. The other columns can be filtered on."""
        spark = settle(rows.sparkSession)
        lengths = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
        width, n = (lengths[0].w, lengths[0].n) if lengths else (1, 0)
        cells = cells or int(min(MOST_CELLS, max(1, np.sqrt(n))))
        share = min(1.0, cells * FIT_ROWS / max(1, n))
        bound = int(share * 2**63) - 1
        some = stored(rows.where((F.size("v") == width) & (F.xxhash64(key).bitwiseAND(F.lit(2**63 - 1)) <= bound)).select(F.col("v").cast("array<double>").alias("v")), "fit")
        centroids = fitted(some, cells, width, rounds) if n else np.zeros((1, width))
        schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'v' else f.dataType.simpleString()}" for f in rows.schema)
        empty = VectorIndex(spark, (path or scratch(spark, "vectors")).rstrip("/"), centroids, (), schema, key)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, c array<double>").write.parquet(f"{empty.path}/centroids")
        built = empty._with(rows, None)
        return replace(built, probes=built.calibrated())._published()

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> VectorIndex:
        path = path.rstrip("/")
        log = Log(spark, f"{path}/_log")
        numbers = log.numbers()
        if not numbers or (version is not None and version not in numbers):
            raise ValueError(f"there is no such index at {path}")
        e = log.read(numbers[-1] if version is None else version)
        centroids = np.array([r.c for r in settle(spark).read.parquet(f"{path}/centroids").orderBy("cell").collect()])  # MOST_CELLS at most
        return VectorIndex(spark, path, centroids, tuple(e["segments"]), e["schema"], e["key"], e["version"], e["probes"])

    def _published(self) -> VectorIndex:
        out = replace(self, version=self.version + 1)
        if not Log(self.spark, f"{self.path}/_log").publish(out.version, {"version": out.version, "segments": list(out.segments), "schema": out.schema, "key": out.key, "probes": out.probes}):
            raise Conflict(f"version {out.version} of the index is another writer's")
        return out

    def _with(self, fresh: DataFrame | None, removed: DataFrame | None) -> VectorIndex:
        name, centroids, width = f"s-{uuid.uuid4().hex}", self.centroids, self.centroids.shape[1]
        where = f"{self.path}/{name}"

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = (directions(matrix_of(b.column("v"), width)) @ centroids.T).argmax(1) if b.num_rows else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=[*b.schema.names, "cell"])

        if fresh is not None:
            rows = fresh.withColumn("v", F.col("v").cast("array<double>")).select(*(f.name for f in self._fields()))
            rows.mapInArrow(placed, f"{self.schema}, cell int").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{where}/cells")
        else:
            self.spark.createDataFrame([], f"{self.schema}, cell int").write.parquet(f"{where}/cells")
        keys = [df.select(self.key) for df in (fresh, removed) if df is not None] if self.segments else []
        gone = reduce(DataFrame.unionByName, keys).distinct() if keys else self.spark.createDataFrame([], self.schema).select(self.key)
        gone.write.parquet(f"{where}/gone")
        return replace(self, segments=(*self.segments, name))

    def _fields(self):
        return self.spark.createDataFrame([], self.schema).schema.fields

    def changed(self, fresh: DataFrame | None = None, removed: DataFrame | None = None) -> VectorIndex:
        """The index with fresh rows in the place of those of their keys, and without the keys of ``removed``, as the next version. Only these rows are
        placed and written; centroids stay."""
        return self._with(fresh, removed)._published()

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The rows that are there, of those cells only if named: a filter of partitions."""
        out = None
        for i, name in enumerate(self.segments):
            part = self.spark.read.schema(f"{self.schema}, cell int").parquet(f"{self.path}/{name}/cells")
            part = part if cells is None else part.where(F.col("cell").isin(cells))
            later = [f"{self.path}/{x}/gone" for x in self.segments[i + 1 :]]
            if later:
                part = part.join(self.spark.read.schema(self.spark.createDataFrame([], self.schema).select(self.key).schema).parquet(*later), self.key, "left_anti")
            out = part if out is None else out.unionByName(part)
        return out

    def nearest_cells(self, v: np.ndarray, probes: int) -> np.ndarray:
        """(questions, probes): each question's cells, nearest first, ties to the lower."""
        score = directions(v) @ self.centroids.T
        return np.argsort(-score, axis=1, kind="stable")[:, :probes]

    def search(self, questions: DataFrame, limit: int = SETTINGS.dense_limit, probes: int | None = None, floor: float = -2.0, where: Column | None = None, own: bool = False) -> DataFrame:
        """qid, key, vector_score, dense_rank of questions(qid, v): cosine search in each question's ``probes`` nearest cells; with as many as there are
        cells it is ``retrieval.dense``, row for row. where: a filter of the rows' other columns, which reaches the scan.

        Questions go to the tasks BLOCK at a time with their cells; only folders of cells that one of them asks for are listed
        and read. Each task keeps its ``limit`` best for a question and gives them once. With own=False a row isn't its question's neighbour by its own key.
        """
        probes, width, key = min(self.cells, probes or self.probes), self.centroids.shape[1], self.key
        kinds = {f.name: f.dataType.simpleString() for f in self._fields()}
        schema = f"qid {dict(questions.dtypes)['qid']}, {key} {kinds[key]}, vector_score double"
        parts, out = max(1, -(-questions.count() // BLOCK)), None
        for p in range(parts):
            some = questions.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p).select("qid", "v").collect()
            if not some:
                continue
            matrix = rows_of([r.v for r in some], width)
            near = self.nearest_cells(matrix, probes)
            asks = np.zeros((self.cells, len(some)), bool)
            asks[near.ravel(), np.repeat(np.arange(len(some)), near.shape[1])] = True
            ids = [r.qid for r in some]

            def scored(batches: Iterator[pa.RecordBatch], matrix: np.ndarray = matrix, asks: np.ndarray = asks, ids: list = ids) -> Iterator[pa.RecordBatch]:
                best, unit, asked = Best(ids, limit, own), directions(matrix), {q: i for i, q in enumerate(ids)}
                for b in batches:
                    if b.num_rows:
                        cell = b.column("cell").to_numpy()
                        x = directions(matrix_of(b.column("v"), width))
                        for c in np.unique(cell):
                            q, at = np.flatnonzero(asks[c]), np.flatnonzero(cell == c)
                            best.add(q, np.round(unit[q] @ x[at].T, 6), b.column(key).take(pa.array(at)), asked)
                yield from best.rows(key)

            cells = np.flatnonzero(asks.any(1)).tolist()
            rows = self.rows(cells if len(cells) < self.cells else None)
            rows = rows if where is None else rows.where(where)
            part = rows.select(key, "v", "cell").mapInArrow(scored, schema)
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], schema + ", dense_rank long")
        return top(out, ["qid"], [F.desc("vector_score"), F.col(key)], limit, "dense_rank").where(F.col("vector_score") >= floor)

    def calibrated(self, limit: int = 10, recall: float = RECALL) -> int:
        """The least number of cells that hold ``recall`` of the true neighbours of PROBED rows: these are found by reading all cells, once."""
        some = self.rows().where(F.col(self.key).isNotNull()).orderBy(F.xxhash64(self.key, F.lit(3))).limit(PROBED).select(F.col(self.key).alias("qid"), "v")
        some = stored(some, "probed")
        vectors = {r.qid: r.v for r in some.collect()}
        if not vectors or self.cells == 1:
            return 1
        true = self.search(some, limit, self.cells).select("qid", self.key).join(self.rows().select(self.key, "cell"), self.key).select("qid", "cell").collect()  # PROBED * limit rows
        width = self.centroids.shape[1]
        order = {q: row.tolist() for q, row in zip(vectors, self.nearest_cells(rows_of(list(vectors.values()), width), self.cells), strict=True)}
        places = np.sort([order[r.qid].index(r.cell) for r in true])
        return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1 if len(places) else 1

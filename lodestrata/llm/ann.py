"""Approximate nearest neighbours: balanced posting lists under centroids that a graph searches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, stored, trimmed

#: Rows that the index is fitted on at least (if there are), sampled rows a list, vectors a list should have, most lists of one vector.
SAMPLE, PER_CENTROID, PER_LIST, COPIES = 20_000, 4, 100, 2
#: Lists there may be for any number of rows; beyond that twice the square root of the rows, up to the last number, so that centroids fit in memory.
LISTS, MOST_LISTS = 1024, 16_384
#: A vector is copied to every list (of COPIES at most) whose centroid is at most so much farther than the nearest one.
CLOSURE = 0.15
#: In the sample, this part of true neighbours must be in the lists that the query ratio selects. At least LEAST lists are read.
RECALL, LEAST = 0.97, 8
#: Centroids that the walk of a row to be placed expands at most; rows that walk together.
BEAM, SLICE = 24, 256
#: Vectors and queries that one task compares at most, on average.
TASK_VECTORS, TASK_QUERIES = 16384, 2048


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, rounded as the expanded form is; for choosing, not for scores."""
    return np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T)


def balanced_centroids(x: np.ndarray, size: int, most: int, seed: int = 1) -> np.ndarray:
    """Means of clusters of about ``size`` rows: the largest is split in up to eight by k-means until all are below twice that size."""
    rng, done, todo = np.random.default_rng(seed), [], [x]
    while todo:
        part = todo.pop()
        k = min(8, -(-len(part) // size))
        if k < 2 or len(done) + len(todo) + k > most:
            done.append(part)
            continue
        means = part[rng.choice(len(part), k, replace=False)]
        for _ in range(8):
            own = dots(part, means).argmin(1)
            means = np.stack([part[own == j].mean(0) if (own == j).any() else means[j] for j in range(k)])
        pieces = [part[own == j] for j in range(k) if (own == j).any()]
        if len(pieces) < 2:
            done.append(part)  # one vector many times
            continue
        for p in pieces:
            (todo if len(p) > 2 * size else done).append(p)
    return np.stack([p.mean(0) for p in done])


@dataclass
class Index:
    """Centroids, their neighbour graph (near ones and a few far links), the query ratio."""

    centroids: np.ndarray
    graph: np.ndarray
    ratio: float = 0.0

    @staticmethod
    def over(centroids: np.ndarray, near: int = 16, far: int = 4, seed: int = 2) -> Index:
        """The graph, a slice of centroids at a time: distances of SLICE centroids to all are the most that is held."""
        n, k, order = len(centroids), min(near, len(centroids) - 1), []
        for lo in range(0, n, SLICE):
            d = dots(centroids[lo : lo + SLICE], centroids)
            d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf  # not its own neighbour
            at = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(d), 1), np.int64)
            order.append(np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), axis=1, kind="stable"), 1) if k else at)
        order = np.concatenate(order)
        links = np.random.default_rng(seed).integers(0, n, (n, far))
        return Index(centroids, np.concatenate([order, links], 1))

    def search(self, x: np.ndarray, ratio: float, least: int, beam: int | None = None) -> np.ndarray:
        """Distances (inf: not reached) of the centroids that a best-first walk over the graph finds for each row of x.

        A row's walk ends once it has expanded ``least`` centroids and the nearest open one is farther than 1 + ratio times
        the nearest found, or once it has expanded ``beam``. All rows walk together, so give it few (see ``slices``).
        """
        n, c = len(x), len(self.centroids)
        dist, open_ = np.full((n, c), np.inf), np.ones((n, c), bool)
        dist[:, 0] = np.linalg.norm(x - self.centroids[0], axis=1)
        active = np.arange(n)
        for step in range(min(c, beam or c)):
            seen = np.where(open_[active], dist[active], np.inf)
            best = seen.argmin(1)
            d = seen[np.arange(len(active)), best]
            go = np.isfinite(d) & ((step < least) | (d <= (1 + ratio) * dist[active].min(1)))
            active, best = active[go], best[go]
            if not len(active):
                break
            open_[active, best] = False
            to = self.graph[best]
            dist[active[:, None], to] = np.linalg.norm(self.centroids[to] - x[active][:, None], axis=2)
        return dist

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that hold each row: the nearest and, at a boundary, up to COPIES."""
        return self.lists(x, CLOSURE, 1, COPIES, BEAM)

    def lists(self, x: np.ndarray, ratio: float, least: int, most: int | None = None, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): each row's lists within 1 + ratio times its nearest, nearest first, least at least and most at most."""
        dist = self.search(x, ratio, max(least, 12), beam)
        order = np.argsort(dist, axis=1)[:, : most or dist.shape[1]]
        d = np.take_along_axis(dist, order, 1)
        take = np.isfinite(d) & ((d <= (1 + ratio) * d[:, :1]) | (np.arange(d.shape[1]) < least))
        row, k = np.nonzero(take)
        return row, order[row, k]


def valid(embedding: str) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(embedding, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(fine & F.exists(embedding, lambda v: v != 0), F.lit(False))


def list_count(n: int) -> int:
    """Lists for n rows: one for PER_LIST rows up to LISTS, then growing with the root of n up to MOST_LISTS."""
    return int(np.clip(n // PER_LIST, 1, min(MOST_LISTS, max(LISTS, 2 * n**0.5))))


def fit(vectors: DataFrame, k: int = 10) -> Index | None:
    """The index over a sample of rows (id, v), chosen by hash, that the driver holds: SAMPLE rows or PER_CENTROID for each list, so at most about 65,000.

    The query ratio is the least of a grid with which RECALL of the sample's own true neighbours are found. The sample is
    walked in slices, as rows are in the tasks, so the driver never holds more than a slice of distances.
    """
    n = vectors.count()
    if not n:
        return None
    lists = list_count(n)
    sample = max(SAMPLE, PER_CENTROID * lists)
    bound = int(min(1.0, sample / n) * 2**63) - 1
    rows = vectors.where(F.xxhash64("id", F.lit(3)).bitwiseAND(F.lit(2**63 - 1)) <= bound).limit(2 * sample).toArrow()
    if not rows.num_rows:
        rows = vectors.limit(1).toArrow()
    rows = rows.sort_by("id").combine_chunks()
    x = rows.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1).astype(np.float64)
    index = Index.over(balanced_centroids(x, max(1, len(x) // lists), lists))
    at = np.arange(0, len(x), max(1, len(x) // 200))
    probe, true = x[at], []
    for lo in range(0, len(probe), 32):
        d = dots(probe[lo : lo + 32], x)
        d[np.arange(len(d)), at[lo : lo + 32]] = np.inf
        true.append(np.argpartition(d, min(k, len(x)) - 1, axis=1)[:, : min(k, len(x) - 1)])
    true = np.concatenate(true)
    member = np.zeros((len(x), len(index.centroids)), bool)
    for lo in range(0, len(x), SLICE):
        row, own = index.homes(x[lo : lo + SLICE])
        member[lo + row, own] = True

    def found(ratio: float) -> float:
        r, c = index.lists(probe, ratio, LEAST)
        read = np.zeros((len(probe), len(index.centroids)), bool)
        read[r, c] = True
        return float(np.mean([(member[t] & read[i]).any(1).mean() if len(t) else 1.0 for i, t in enumerate(true)]))

    grid = np.arange(0, 2.01, 0.025)
    low, high = 0, len(grid) - 1
    while low < high:  # recall only grows with the ratio
        middle = (low + high) // 2
        low, high = (low, middle) if found(grid[middle]) >= RECALL else (middle + 1, high)
    index.ratio = float(grid[low])
    return index


def dim_of(vectors: DataFrame) -> int | None:
    found = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found.d if found else None


def slices(batches: Iterator[pa.RecordBatch], n: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for lo in range(0, whole.num_rows, n):
            b = whole.slice(lo, n)
            yield b, b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)


def cells_of(lengths: dict[int, int]) -> dict[int, list[int]]:
    """The cells of each list: short lists share a cell of about TASK_VECTORS, a longer list is dealt to several."""
    out, cell, room = {}, 0, TASK_VECTORS
    for own, n in sorted(lengths.items()):
        parts = -(-n // TASK_VECTORS)
        if n > room:
            cell, room = cell + 1, TASK_VECTORS
        out[own] = list(range(cell, cell + parts))
        room -= n
        if parts > 1:
            cell, room = cell + parts, TASK_VECTORS
    return out


def compare_cell(q: pd.DataFrame, c: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score), by row of q and c: the k nearest in the cell of each query, among the lists that it reads; a query's own row is left out."""
    xq, xc = (np.stack(t["v"].to_numpy()).astype(np.float64) for t in (q, c))
    rq, rc, ic, lc = q["rid"].to_numpy(), c["rid"].to_numpy(), c["id"].to_numpy(), c["list"].to_numpy()
    asked, readers = np.concatenate(q["lists"].to_numpy()), np.repeat(np.arange(len(q)), q["lists"].map(len))
    rows, cols, scores = [], [], []
    for own in np.unique(lc):
        at, reads = np.flatnonzero(lc == own), readers[asked == own]
        for lo in range(0, len(reads), 512):
            r = reads[lo : lo + 512]
            d = dots(xq[r], xc[at])
            d[rq[r][:, None] == rc[at][None]] = np.inf
            last = np.partition(d, min(k, len(at)) - 1, axis=1)[:, min(k, len(at)) - 1]
            i, j = np.nonzero(np.isfinite(d) & (d <= last[:, None] + 1e-9 * (1 + (xq[r] ** 2).sum(1))[:, None]))
            for a in range(0, len(i), 1 << 16):
                b = slice(a, a + (1 << 16))
                rows.append(r[i[b]])
                cols.append(at[j[b]])
                scores.append(np.sqrt(((xc[cols[-1]] - xq[rows[-1]]) ** 2).sum(1)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, col, score = np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)
    order = np.lexsort((rc[col], ic[col], score, rq[row]))
    row, col, score = row[order], col[order], score[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (rc[col[1:]] != rc[col[:-1]])]  # a copy from another list
    row, col, score = row[new], col[new], score[new]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    top = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
    return row[top], col[top], score[top]


def nearest(table: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that satisfies ``query`` its k nearest others by Euclidean distance.

    Every row is indexed: it goes to the list of its nearest centroid and, at a boundary, to a second one. A query
    reads the lists that the distance ratio selects. Lists are dealt to cells by their measured length: short ones share a
    cell, and a list that one vector fills, however often it occurs, spreads over many. A cell returns its k best for a
    query, and these meet in a window. Scores are computed from the original vectors in double precision; ties go to the smaller id.

    Rows whose vector is null, zero, of another length than most, or has a null or non-finite component take no part; neither do null ids.
    Each row is told from the others by a number, so a row that shares its id with others is searched, and found, as a row of its own;
    with fewer than k others all are returned; an empty table gives no rows.
    """
    spark = settled(table).sparkSession
    kind = table.select(vector_col).dtypes[0][1]
    kind = kind if kind == "array<float>" else "array<double>"  # floats take half of the room and are doubles exactly
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.coalesce(query, F.lit(False)).alias("q"))
    rows = rows.where(valid("v") & F.col("id").isNotNull())
    dim = dim_of(rows)
    rows = stored(rows.where(F.size("v") == F.lit(dim or 0)).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    index = fit(rows.select(F.col("rid").alias("id"), "v"), k=k)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in slices(batches):
            row, own = index.homes(x)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(b.column(c).take(at) for c in ("rid", "id", "v"))], names=["list", "rid", "id", "v"])

    lists = stored(rows.select("rid", "id", "v").mapInArrow(trimmed(place), f"list int, rid long, id long, v {kind}"), "lists")
    cells = cells_of({r.list: r.n for r in lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()})  # at most MOST_LISTS rows

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in slices(batches):
            row, own = index.lists(x, index.ratio, LEAST)
            pairs: dict[tuple[int, int], list[int]] = {}
            for r, c in zip(row.tolist(), own.tolist(), strict=True):
                for cell in cells.get(c, []):
                    pairs.setdefault((cell, r), []).append(c)
            at = pa.array([r for _, r in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in pairs], pa.int32()), *(b.column(c).take(at) for c in ("rid", "id", "v")), pa.array(list(pairs.values()), pa.list_(pa.int32()))], names=["cell", "rid", "id", "v", "lists"])

    asks = stored(rows.where("q").select("rid", "id", "v").mapInArrow(trimmed(ask), f"cell int, rid long, id long, v {kind}, lists array<int>"), "asks")
    askers = asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).alias("askers"))
    of = spark.createDataFrame(sorted(cells.items()), "list int, cells array<int>")
    dealt = lists.join(F.broadcast(of), "list").withColumn("cell", F.element_at("cells", (F.pmod(F.xxhash64("rid"), F.size("cells")) + 1).cast("int")))
    left = asks.join(askers, "cell").select("cell", F.pmod(F.xxhash64("rid"), "askers").alias("part"), "rid", "id", "v", "lists")
    right = dealt.join(askers, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("askers") - 1)).alias("part"), "list", "rid", "id", "v")

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        row, col, score = compare_cell(q, c, k) if len(q) and len(c) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        out = {"asker": q["rid"].to_numpy()[row], "query_id": q["id"].to_numpy()[row], "rid": c["rid"].to_numpy()[col], "vec_id": c["id"].to_numpy()[col], "score": score}
        return pd.DataFrame(out)

    found = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInPandas(compare, "asker long, query_id long, rid long, vec_id long, score double")
    found = found.groupBy("asker", "rid").agg(F.first("query_id").alias("query_id"), F.first("vec_id").alias("vec_id"), F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("asker").orderBy("score", "vec_id", "rid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Vector compression by product codes: Lloyd's rounds over kd-trees whose cells filter the codebook's entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, removed, settled, stored, trimmed

#: Parts of a vector, entries of a part's codebook, rounds of Lloyd, units of a component.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose trees are made, kept and read together (4 MB of points at 64 components), points of a kd-tree's leaf.
BLOCK, LEAF = 8192, 8
#: Components count as this at most (2**18 before scaling), so that sums of squared distances are exact in 64 bits.
BOUND = 1 << 26


@dataclass
class Forest:
    """kd-trees of one block, one for each part, in one set of arrays; nodes of a level follow each other, children of i are kids[i] and kids[i] + 1.

    points: (n, d) distinct points of all parts, those of a node next to each other (lo..hi); times: how often each occurs.
    low, high: a node's bounding box; sums, count: of its points, repeats counted. kids: -1 at a leaf. root: the tree's part.
    """

    points: np.ndarray
    times: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    kids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    count: np.ndarray

    @staticmethod
    def over(parts: list[np.ndarray], leaf: int = LEAF) -> tuple[Forest, list[np.ndarray]]:
        """The trees of parts (one (n, d) array of integers each), and where each row's point is in ``points``.

        All nodes of a level are cut together: at the middle of their points along their boxes' widest side.
        """
        distinct = [np.unique(p, axis=0, return_inverse=True, return_counts=True) for p in parts]
        sizes = np.array([len(d[0]) for d in distinct])
        points, times = np.concatenate([d[0] for d in distinct]), np.concatenate([d[2] for d in distinct])
        order, first = np.arange(len(points)), np.r_[0, np.cumsum(sizes)]
        lo, hi = first[:-1], first[1:]
        levels = []
        while len(lo):
            here = points[order]
            low, high = (np.array([f(here[a:b], axis=0) for a, b in zip(lo, hi, strict=True)]) for f in (np.min, np.max)) if len(lo) < 64 else _boxes(here, lo, hi)
            split = np.flatnonzero(hi - lo > leaf)
            levels.append([lo, hi, low, high, split])
            if not len(split):
                break
            wide = (high - low)[split].argmax(1)
            node = np.repeat(np.arange(len(split)), (hi - lo)[split])
            at = np.concatenate([np.arange(a, b) for a, b in zip(lo[split], hi[split], strict=True)])
            order[at] = order[at[np.lexsort((here[at, wide[node]], node))]]
            mid = (lo[split] + hi[split] + 1) // 2
            lo, hi = np.c_[lo[split], mid].ravel(), np.c_[mid, hi[split]].ravel()
        begun, kids = 0, []
        for own, _, _, _, split in levels:
            begun += len(own)
            k = np.full(len(own), -1)
            k[split] = begun + 2 * np.arange(len(split))
            kids.append(k)
        lo, hi, low, high = (np.concatenate([x[i] for x in levels]) for i in range(4))
        points, times = points[order], times[order]
        run = np.r_[np.zeros((1, points.shape[1]), np.int64), np.cumsum(points * times[:, None], axis=0)]
        total = np.r_[0, np.cumsum(times)]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows = [place[a + d[1].ravel()] for a, d in zip(first, distinct, strict=False)]
        return Forest(points, times, lo, hi, np.concatenate(kids), low, high, run[hi] - run[lo], total[hi] - total[lo]), rows

    def assign(self, books: np.ndarray, give: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(sums, counts) by part and entry of the points whose nearest entry of books (parts, entries, d) it is; with ``give`` also each point's entry.

        A node carries the entries that may be the nearest of a point in its box. Of these the one nearest to the box's middle
        rules out every other that is not nearer to the box's corner in its own direction (at equal distance the lower index stays). A node
        with one entry left gives its cached sums as a whole; a leaf with several compares its points.
        """
        parts, entries, d = books.shape
        sums, counts = np.zeros((parts * entries, d), np.int64), np.zeros(parts * entries, np.int64)
        label = np.zeros(len(self.points), np.int64) if give else None
        node, z = np.repeat(np.arange(parts), entries), np.tile(np.arange(entries), parts)
        book = node * entries + z  # in the flat codebook
        flat = books.reshape(-1, d)
        while len(node):
            cut = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            many = np.diff(np.r_[cut, len(node)])
            run = np.repeat(np.arange(len(cut)), many)
            low, high = self.low[node], self.high[node]
            far = ((2 * flat[book] - low - high) ** 2).sum(1)
            at = np.flatnonzero(far == np.minimum.reduceat(far, cut)[run])
            best = at[np.flatnonzero(np.r_[True, run[at][1:] != run[at][:-1]])][run]  # entries of a node ascend: the first is the lowest
            toward = flat[book] - flat[book[best]]
            gap = (toward * (flat[book] + flat[book[best]])).sum(1) - 2 * np.maximum(toward * low, toward * high).sum(1)
            keep = (gap < 0) | ((gap == 0) & (book <= book[best]))
            node, book, run = node[keep], book[keep], run[keep]
            left = np.bincount(run, minlength=len(cut))[run]
            one, leaf = left == 1, self.kids[node] < 0
            np.add.at(sums, book[one], self.sums[node[one]])
            np.add.at(counts, book[one], self.count[node[one]])
            if give:
                size = self.hi[node[one]] - self.lo[node[one]]
                label[_spans(self.lo[node[one]], size)] = np.repeat(book[one], size)
            own = ~one & leaf
            if own.any():
                self._compare(node[own], book[own], flat, sums, counts, label)
            node, book = node[~one & ~leaf], book[~one & ~leaf]
            kids = np.c_[self.kids[node], self.kids[node] + 1].ravel()
            order = np.argsort(kids, kind="stable")
            node, book = kids[order], np.repeat(book, 2)[order]
        return sums.reshape(parts, entries, d), counts.reshape(parts, entries), None if label is None else label % entries

    def _compare(self, node: np.ndarray, book: np.ndarray, flat: np.ndarray, sums: np.ndarray, counts: np.ndarray, label: np.ndarray | None) -> None:
        """Points of leaves against the entries (node, book) that are left for them."""
        size = self.hi[node] - self.lo[node]
        point, z = _spans(self.lo[node], size), np.repeat(book, size)
        order = np.lexsort((z, point))
        point, z = point[order], z[order]
        far = ((self.points[point] - flat[z]) ** 2).sum(1)
        cut = np.flatnonzero(np.r_[True, point[1:] != point[:-1]])
        run = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(point)]))
        at = np.flatnonzero(far == np.minimum.reduceat(far, cut)[run])
        at = at[np.flatnonzero(np.r_[True, run[at][1:] != run[at][:-1]])]
        point, z = point[at], z[at]
        np.add.at(sums, z, self.points[point] * self.times[point, None])
        np.add.at(counts, z, self.times[point])
        if label is not None:
            label[point] = z

    def pack(self) -> dict[str, bytes]:
        return {k: v.astype(np.int32 if k in _NARROW else np.int64).tobytes() for k, v in vars(self).items()}

    @staticmethod
    def unpack(row: dict[str, bytes], d: int) -> Forest:
        read = {k: np.frombuffer(row[k], np.int32 if k in _NARROW else np.int64).astype(np.int64) for k in Forest.__dataclass_fields__}
        return Forest(**{k: v.reshape(-1, d) if k in ("points", "low", "high", "sums") else v for k, v in read.items()})


_NARROW = ("points", "low", "high", "lo", "hi", "kids", "times")


def _spans(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[0]..lo[0]+size[0]-1, then those of the next, and so on."""
    return np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)


def _boxes(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = hi - lo
    some, first = points[_spans(lo, size)], np.cumsum(size) - size
    return np.minimum.reduceat(some, first, axis=0), np.maximum.reduceat(some, first, axis=0)


@dataclass
class Codes:
    """rows: _rid, code, error of each vector kept. books: (parts, entries, components) integers. digest: SHA-256 of them."""

    rows: DataFrame
    books: np.ndarray
    digest: str


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of the rows of vectors: id, label, code (an entry's number for each part, as bytes), error (squared distance, in units).

    Components become floor(scale * x). A part's codebook starts as that part of the rows of the smallest ids (ties by vector,
    null ids last; fewer rows give fewer entries). Each round assigns every part to the nearest entry, ties to the lower one,
    and moves each entry to floor(sum / count) of its parts; entries without parts stay.

    Every task makes kd-trees over blocks of its rows once, with sums and counts in their nodes, as a stored table; a round is one
    pass over that table, in which a block gives one row for each entry that it uses. Those meet by (part, entry), and only the
    codebooks (parts * entries rows) go to the driver and to the tasks, whatever the input's size. Equal points of a block are one point.

    A vector that is null, holds null, NaN or infinite components, or has another dimension than that of the smallest id does not
    take part; nor does any if parts do not divide the dimension. Repeated rows are rows; an empty table gives no rows and no entries.
    Components beyond BOUND units count as BOUND.
    """
    rows = settled(vectors).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    id_type, label_type = (dict(rows.dtypes)[c] for c in ("id", "label"))
    sized = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0)).withColumn("n", F.size("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    head = sized.where(finite).orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    d = head[0].n // parts if head else 1
    kept = sized.where(finite & (F.col("n") == d * parts))
    floors = F.transform("v", lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-BOUND)), F.lit(BOUND)).cast("int"))
    kept = kept.select("id", "label", floors.alias("v"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect() if head else []
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, d).transpose(1, 0, 2)
    fields = ", ".join(f"{k} binary" for k in Forest.__dataclass_fields__)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered_rows(batches, BLOCK):
            v = np.asarray(t.column("v").combine_chunks().flatten()).astype(np.int64).reshape(t.num_rows, parts, d)
            forest, at = Forest.over([np.ascontiguousarray(v[:, p]) for p in range(parts)])
            packed = {k: pa.array([x], pa.binary()) for k, x in forest.pack().items()}
            own = {c: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks()) for c in ("id", "label")}
            yield pa.RecordBatch.from_pydict(own | {"at": pa.array([np.stack(at).astype(np.int32).tobytes()], pa.binary())} | packed)

    trees = stored(kept.mapInArrow(trimmed(blocks), f"id array<{id_type}>, label array<{label_type}>, at binary, {fields}"), "trees")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.select([*Forest.__dataclass_fields__]).to_pylist():
                sums, counts, _ = Forest.unpack(row, d).assign(books)
                p, z = np.nonzero(counts)
                yield pa.RecordBatch.from_pydict({"part": pa.array(p.astype(np.int32)), "entry": pa.array(z.astype(np.int32)), "n": pa.array(counts[p, z]), "sums": pa.array(sums[p, z].tolist(), pa.list_(pa.int64()))})

    for _ in range(rounds if len(first) else 0):
        found = trees.mapInArrow(trimmed(totals), "part int, entry int, n long, sums array<long>")
        moved = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d))).collect()
        books = books.copy()
        for r in moved:
            books[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(d)]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(b.select(["at", *Forest.__dataclass_fields__]).to_pylist()):
                forest = Forest.unpack(row, d)
                _, _, label = forest.assign(books, give=True)
                at = np.frombuffer(row["at"], np.int32).reshape(parts, -1)
                entry, n = label[at], at.shape[1]
                error = sum(((forest.points[at[p]] - books[p, entry[p]]) ** 2).sum(1) for p in range(parts))
                code = np.ascontiguousarray(entry.T.astype(np.uint8))
                out = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), n, [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id")[i].values, b.column("label")[i].values, out, pa.array(error)], names=["id", "label", "code", "error"])

    out = stored(trees.mapInArrow(trimmed(codes), f"id {id_type}, label {label_type}, code binary, error long"), "codes")
    removed(trees)
    return Codes(out, books, hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest())


def gathered_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """The task's rows, n at a time."""
    held, rows = [], 0
    for b in batches:
        while b.num_rows:
            take = min(n - rows, b.num_rows)
            held.append(b.slice(0, take))
            rows, b = rows + take, b.slice(take)
            if rows == n:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)
    release()


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE, code_col: str = "code") -> DataFrame:
    """codes with ``vector``, the vector that each code stands for."""
    parts, entries, d = books.shape
    flat = F.lit((books / scale).ravel().tolist())
    byte = lambda p: F.conv(F.hex(F.substring(F.col(code_col), p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*(F.slice(flat, byte(p) * d + p * entries * d + 1, d) for p in range(parts))))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes with ``label_error``, the sum of error over the rows of equal labels; rows without a label count together.

    Sums are stored, so that the join's sides have exchanges of their own and a label with a third of all rows can be split.
    """
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")

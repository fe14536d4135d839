"""Exact Jaccard self-join of texts by their word shingles: R-trees over counts of shingle groups, clusters of what they cannot rule out, exact sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, among, release, removed, settled, stored, trimmed
from .simhash import components, numbered, shingle_hashes

#: Rows on which common shingles are found (about), least rows there of a common one, most of them.
SAMPLE, COMMON, MOST = 10_000, 3, 1 << 16
#: Rows of a leaf of an R-tree, rows of a bucket whose counts are compared, and rows and shingles of a cluster that one task compares.
LEAF, TOGETHER, ROWS, SHINGLES = 16, 4096, 2048, 4_000_000
#: Rows of a larger cluster with which all its rows are compared first.
PIVOTS = 4


def groups_for(n: int) -> int:
    """Groups of a set of n shingles: a power of two from n / 2 to n, 8 at least, so that counts of one size fold into those of the next."""
    return 1 << max(3, int(np.ceil(np.log2(max(1, n) / 2))))


def group_counts(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """How many shingles are in each group, at 15 at most, and how many are beyond that: a bound adds the lesser excess, so it stays one."""
    counts = np.bincount((shingles % np.uint64(groups_for(len(shingles)))).astype(np.int64), minlength=groups_for(len(shingles)))
    most = np.minimum(counts, 15)
    return most.astype(np.uint8), int(counts.sum() - most.sum())


def packed(counts: np.ndarray) -> bytes:
    """Two groups a byte."""
    return (counts[0::2] | counts[1::2] << 4).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    two = np.frombuffer(data, np.uint8)
    out = np.empty(2 * len(two), np.uint8)
    out[0::2], out[1::2] = two & 15, two >> 4
    return out


def enough(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap (or a bound of it) of two sets with that sum of sizes makes a similarity of percent / 100: 100 I >= percent (sizes - I)."""
    return (100 + percent) * overlap >= percent * sizes


class CountTree:
    """A packed R-tree over rows of counts. Node k holds rows order[lo[k]:hi[k]] and their greatest counts, least size and greatest excess; kids of a leaf are -1."""

    def __init__(self, counts: np.ndarray, n: np.ndarray, excess: np.ndarray):
        self.order = np.arange(len(n))
        self.lo, self.hi, self.kids, self.top, self.least, self.excess = [], [], [], [], [], []
        todo = [(0, len(n), -1)]
        while todo:
            lo, hi, above = todo.pop()
            k, own = len(self.lo), self.order[lo:hi]
            top = counts[own].max(0)
            self.lo.append(lo), self.hi.append(hi), self.kids.append([-1, -1]), self.top.append(top), self.least.append(n[own].min()), self.excess.append(excess[own].max())
            if above >= 0:
                self.kids[above][self.kids[above][0] >= 0] = k
            if hi - lo > LEAF:
                axis = int((top - counts[own].min(0)).argmax())
                self.order[lo:hi] = own[np.argsort(counts[own, axis], kind="stable")]
                mid = (lo + hi) // 2
                todo += [(mid, hi, k), (lo, mid, k)]

    def rows(self, k: int) -> np.ndarray:
        return self.order[self.lo[k] : self.hi[k]]


def linked(counts: list[np.ndarray], n: np.ndarray, excess: np.ndarray, percent: int, same: Callable[[int, int], bool] | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the rows whose overlap the counts cannot rule out, or, with ``same``, for which it is true.

    An R-tree is joined with itself: two nodes meet only if the sum of the smaller of their greatest counts can be enough for the
    least sizes below them, and not all rows of both are linked already. Leaves compare the sums of minima of their rows. Rows with 2G
    groups meet rows with G groups by adding their halves. label: rows that are linked from the start.
    """
    if len(n) == 2 and label is None:
        return [(0, 1)] if _may_be_two(counts, n, excess, percent) and (same is None or same(0, 1)) else []
    label = np.arange(len(n)) if label is None else label.copy()
    wide, out = np.array([len(c) for c in counts]), []
    for g in sorted(set(wide.tolist()), reverse=True):
        at = np.flatnonzero((wide == g) | (wide == 2 * g))
        if len(at) < 2:
            continue
        table = np.stack([counts[i] if wide[i] == g else counts[i][:g] + counts[i][g:] for i in at])  # at most 30 a group
        size, more, folded = n[at], excess[at], wide[at] > g
        tree, todo = CountTree(table, size, more), [(0, 0)]
        while todo:
            a, b = todo.pop()
            i, j = tree.rows(a), tree.rows(b)
            x, y = label[at[i]], label[at[j]]
            if x[0] == y[0] and (x == x[0]).all() and (y == x[0]).all():
                continue
            if a != b and not enough(np.minimum(tree.top[a], tree.top[b]).sum(dtype=np.int64) + min(tree.excess[a], tree.excess[b]), tree.least[a] + tree.least[b], percent):
                continue
            leaf_a, leaf_b = tree.kids[a][0] < 0, tree.kids[b][0] < 0
            if not (leaf_a and leaf_b):
                if a == b:
                    left, right = tree.kids[a]
                    todo += [(left, right), (right, right), (left, left)]
                elif leaf_b or (not leaf_a and len(i) >= len(j)):
                    todo += [(k, b) for k in tree.kids[a]]
                else:
                    todo += [(a, k) for k in tree.kids[b]]
                continue
            overlap = np.minimum(table[i][:, None], table[j][None]).sum(2, dtype=np.int64) + np.minimum(more[i][:, None], more[j][None])
            ok = enough(overlap, size[i][:, None] + size[j][None], percent) & (x[:, None] != y[None]) & ~(folded[i][:, None] & folded[j][None])
            if a == b:
                ok = np.triu(ok, 1)
            u, v = np.nonzero(ok)
            for k in np.argsort(-overlap[u, v], kind="stable"):
                p, q = int(at[i[u[k]]]), int(at[j[v[k]]])
                if label[p] != label[q] and (same is None or same(p, q)):
                    out.append((p, q))
                    label[label == label[q]] = label[p]
    return out


def _may_be_two(counts: list[np.ndarray], n: np.ndarray, excess: np.ndarray, percent: int) -> bool:
    """The test of two rows alone, which most buckets hold."""
    a, b = sorted(counts, key=len)
    if len(b) > 2 * len(a):
        return False  # of such sizes they can't be similar
    if len(b) > len(a):
        b = b[: len(a)] + b[len(a) :]
    return bool(enough(np.minimum(a, b).sum(dtype=np.int64) + excess.min(), n.sum(), percent))


def overlap_of(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles of both of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def sets_linked(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets of shingles that are similar, exactly."""
    n, pairs = np.array([len(s) for s in sets], np.int64), [group_counts(s) for s in sets]
    same = lambda p, q: bool(enough(overlap_of(sets[p], sets[q]), n[p] + n[q], percent))
    return linked([c for c, _ in pairs], n, np.array([e for _, e in pairs], np.int64), percent, same, label)


def prefix_length(n: int, percent: int) -> int:
    """So many first shingles in an order that all texts share that two similar sets share one of them; 0 where no other set can be similar."""
    return n - -(-percent * n // 100) + 1 if 100 * n >= percent * (n + 1) else 0


@dataclass
class Order:
    """An order of shingles: the common ones of a sample last, by how many rows have them; hot: those of so many rows that they are not shuffled."""

    common: np.ndarray
    rank: np.ndarray
    hot: np.ndarray

    @staticmethod
    def over(rows: DataFrame, words: int, text_col: str) -> Order:
        n = rows.count()
        share = min(1.0, SAMPLE / max(1, n))
        bound = int(share * 2**63) - 1

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for t in b.column(0):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py(), words)).view(np.int64))], names=["h"])

        some = rows.where(F.xxhash64("_rid", F.lit(5)).bitwiseAND(F.lit(2**63 - 1)) <= bound).select(text_col).mapInArrow(trimmed(each), "h long")
        found = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST).collect()
        h, rank = np.array([r.h for r in found], np.int64).view(np.uint64), np.arange(len(found), 0, -1)
        order = np.argsort(h)
        hot = np.sort(np.array([r.h for r in found if r.n / share > 4 * TOGETHER], np.int64).view(np.uint64))
        return Order(h[order], rank[order], hot)

    def prefix(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        n = prefix_length(len(shingles), percent)
        if n and len(self.common):
            at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
            shingles = shingles[np.argsort(np.where(self.common[at] == shingles, self.rank[at], 0), kind="stable")]
        return shingles[:n]


def similar_groups(rows: DataFrame, percent: int, words: int, text_col: str = "text") -> DataFrame:
    """_rid, n, group of each row of rows(_rid, text): the number of its distinct shingles, and a number that rows have in common exactly
    if similar sets, of at least percent / 100 by Jaccard, link them. A stored table.

    1. Equal sets are one class, of which one row goes on, so copies cost a key each.
    2. Two similar sets share one of the first few shingles in an order that all texts share (rare ones first). Rows that share one are a
       bucket, which gets the rows' group counts; its R-tree links rows whose summed minima cannot rule out that they are similar. Buckets of
       the same rows count once. A shingle with more than TOGETHER rows links them all without a comparison, which loses nothing; one that
       a sample shows to be far above that does so where it is found, without meeting in a task.
    3. What these links connect is a cluster: all similar pairs are inside one, most texts are in none. A cluster's texts are sent
       once and compared exactly, by the same R-tree. A cluster that is too large for a task is first compared with a few of its
       rows, which links most of a group of near copies; what that does not link is dealt with all others by blocks, so work grows
       with the rows that stand apart, not with the square of the group.

    Every link is between texts that were compared as whole sets of 64-bit hashes. Sets without shingles link nothing.
    """
    order = Order.over(rows, words, text_col)
    number = lambda h: -(h >> np.uint64(1)).astype(np.int64) - 1  # noqa: E731  a node for a hot shingle, apart from rows

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column(1)]
            counted, first = [group_counts(s) for s in own], [order.prefix(s, percent) for s in own]
            hot = [np.isin(f, order.hot) for f in first]
            lists = lambda x: pa.array(x, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({
                "_rid": b.column(0), "n": pa.array([len(s) for s in own], pa.int64()), "key": pa.array([xxhash.xxh128_digest(s.tobytes()) for s in own], pa.binary()), "excess": pa.array([e for _, e in counted], pa.int64()),
                "counts": pa.array([packed(c) for c, _ in counted], pa.binary()), "h": lists([f[~x].view(np.int64) for f, x in zip(first, hot, strict=True)]), "hot": lists([number(f[x]) for f, x in zip(first, hot, strict=True)]),
            })

    sets = stored(rows.select("_rid", text_col).mapInArrow(trimmed(shingled), "_rid long, n long, key binary, excess long, counts binary, h array<long>, hot array<long>"), "sets")
    classes = stored(sets.where("n > 0").groupBy("key", "n").agg(F.min("_rid").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("_rid"))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a shingle's rows as (bucket, row), or, beyond TOGETHER, as links to the run's first row. Held is the last run, while it is short."""
        last, held, first = None, [], None

        def buckets(rid: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
            """Complete runs of two rows or more, one after another, of these lengths."""
            code = np.bitwise_xor.reduceat(_mixed(rid), np.cumsum(many) - many) ^ many.astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(code, many).view(np.int64)), pa.array(rid), pa.nulls(len(rid), pa.int64())], names=["bucket", "_rid", "to"])

        def all_linked(rid: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(rid), pa.int64()), pa.array(rid), pa.array(np.full(len(rid), first))], names=["bucket", "_rid", "to"])

        def hold(rid: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal held, first
            if first is not None:
                yield all_linked(rid)
                return
            held.append(rid)
            if sum(map(len, held)) > TOGETHER:
                first = int(held[0][0])
                yield from map(all_linked, held)
                held = []

        def ended() -> Iterator[pa.RecordBatch]:
            rid = np.concatenate(held) if held else np.zeros(0, np.int64)
            if len(rid) > 1:
                yield buckets(rid, np.array([len(rid)]))

        for b in batches:
            if not b.num_rows:
                continue
            h, rid = b.column("h").to_numpy(), b.column("_rid").to_numpy()
            lo = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1]
            hi = np.r_[lo[1:], len(h)]
            if h[0] == last:
                yield from hold(rid[: hi[0]])
                lo, hi = lo[1:], hi[1:]
                if not len(lo):
                    continue
            yield from ended()
            inner = np.flatnonzero((hi - lo > 1)[:-1])  # most shingles are one row's
            short = inner[(hi - lo)[inner] <= TOGETHER]
            if len(short):
                many = (hi - lo)[short]
                at = np.arange(many.sum()) + np.repeat(lo[short] - (np.cumsum(many) - many), many)
                yield buckets(rid[at], many)
            for i in inner[(hi - lo)[inner] > TOGETHER]:
                first = int(rid[lo[i]])
                yield all_linked(rid[lo[i] : hi[i]])
            last, held, first = h[-1], [], None
            yield from hold(rid[lo[-1] :])
        yield from ended()

    own = sets.join(reps.hint("merge"), "_rid", "left_semi")  # both grow with the input
    tokens = own.select("_rid", F.explode("h").alias("h")).repartition("h").sortWithinPartitions("h")
    met = stored(tokens.mapInArrow(trimmed(shared), "bucket long, _rid long, to long").distinct(), "buckets")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in runs_of(batches, "bucket"):
            rid, n, excess = (t.column(c).to_numpy() for c in ("_rid", "n", "excess"))
            counts = [unpacked(x.as_py()) for x in t.column("counts")]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield _edges(rid[lo:hi], linked(counts[lo:hi], n[lo:hi], excess[lo:hi], percent))

    bucketed = met.where("bucket is not null").select("bucket", "_rid").join(sets.select("_rid", "n", "excess", "counts").hint("merge"), "_rid")
    found = bucketed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(candidates), "u long, v long")
    found = found.unionByName(met.where("bucket is null and _rid <> to").select(F.col("_rid").alias("u"), F.col("to").alias("v")))
    if len(order.hot):
        found = found.unionByName(own.select(F.col("_rid").alias("u"), F.explode("hot").alias("v")))
    cluster = components(found)
    links = stored(verified(cluster.where("node >= 0").select(F.col("node").alias("_rid"), F.col("root").alias("cluster")), sets.select("_rid", "n"), rows, percent, words, text_col), "links")
    for used in (met, cluster):
        removed(used)
    roots = components(links)
    of = sets.select("_rid", "n", "key").join(classes, ["key", "n"], "left").join(roots, F.col("rep") == F.col("node"), "left")
    out = stored(of.select("_rid", "n", F.coalesce("root", "rep", "_rid").alias("group")), "groups")
    for used in (sets, classes, links, roots):
        removed(used)
    return out


def _mixed(rid: np.ndarray) -> np.ndarray:
    code = (rid.view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(32))


def _edges(rid: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(rid[at[:, 0]]), pa.array(rid[at[:, 1]])], names=["u", "v"])


def runs_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows, whole runs of equal names at a time, and where the runs begin (and the end). Held is the last, unfinished run."""
    held: list[pa.RecordBatch] = []
    key = lambda b, i: tuple(b.column(c)[i].as_py() for c in names)
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(c).to_numpy() for c in names]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and key(held[-1], held[-1].num_rows - 1) != key(b, 0):
            cuts = np.r_[0, cuts]
        if len(cuts):
            t = pa.Table.from_batches([*held, b.slice(0, cuts[-1])])
            own = [t.column(c).to_numpy() for c in names]
            yield t, np.r_[0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in own], axis=0)) + 1, t.num_rows]
            held, b = [], b.slice(cuts[-1])
        held.append(b)
    if held:
        t = pa.Table.from_batches(held)
        own = [t.column(c).to_numpy() for c in names]
        yield t, np.r_[0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in own], axis=0)) + 1, t.num_rows]


def verified(clusters: DataFrame, sizes: DataFrame, rows: DataFrame, percent: int, words: int, text_col: str) -> DataFrame:
    """Links u, v of clusters(_rid, cluster) with the same components inside each cluster as all similar pairs have. sizes: _rid, n."""
    own = stored(clusters.join(sizes, "_rid"), "clusters")
    texts = among(rows.select("_rid", F.col(text_col).alias("text")), own)  # others are not sent
    totals = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles")).where("rows > 1")
    parts = F.greatest(F.ceil(F.col("rows") / ROWS), F.ceil(F.col("shingles") / SHINGLES))
    totals = stored(totals.select("cluster", parts.alias("parts")), "totals")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in runs_of(batches, "cluster", "task"):
            rid, root = t.column("_rid").to_numpy(), t.column("root").to_numpy()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                sets = [np.unique(shingle_hashes(x.as_py(), words)) for x in t.column("text").slice(lo, hi - lo)]
                _, label = np.unique(root[lo:hi], return_inverse=True)
                yield _edges(rid[lo:hi], sets_linked(sets, percent, label))
        release()

    def dealt(some: DataFrame) -> DataFrame:
        """Links of some(cluster, task, root, _rid), in which rows of one root are linked already."""
        return some.join(texts, "_rid").repartition("cluster", "task").sortWithinPartitions("cluster", "task").mapInArrow(trimmed(compare), "u long, v long")

    small = own.join(totals.where("parts = 1"), "cluster", "left_semi")
    links = dealt(small.select("cluster", F.lit(0).cast("long").alias("task"), F.col("_rid").alias("root"), "_rid"))
    large = totals.where("parts > 1")
    if large.isEmpty():
        return links
    many = stored(own.join(large, "cluster"), "large")
    pivots = many.groupBy("cluster").agg(F.min("_rid").alias("p0"), *(F.min_by("_rid", F.xxhash64("_rid", F.lit(k))).alias(f"p{k}") for k in range(1, PIVOTS)))
    pivots = stored(pivots.select("cluster", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("pivot")), "pivots")
    known = stored(pivots.join(texts, F.col("pivot") == F.col("_rid")).groupBy("cluster").agg(F.collect_list(F.struct("pivot", "text")).alias("pivots")), "pivot-texts")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for b in batches:
            out = []
            for cluster, rid, text, some in zip(*(b.column(c) for c in ("cluster", "_rid", "text", "pivots")), strict=True):
                cluster, rid = cluster.as_py(), rid.as_py()
                if cluster not in kept:
                    kept = {cluster: [(p["pivot"], np.unique(shingle_hashes(p["text"], words))) for p in some.as_py()]}
                x = np.unique(shingle_hashes(text.as_py(), words))
                out += [(rid, p) for p, s in kept[cluster] if p != rid and enough(overlap_of(x, s), len(x) + len(s), percent)]
            at = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["u", "v"])

    first = stored(many.select("cluster", "_rid").join(texts, "_rid").join(known, "cluster").mapInArrow(trimmed(near), "u long, v long"), "pivot-links")
    roots = components(first)
    rooted = stored(many.join(roots, F.col("_rid") == F.col("node"), "left").select("cluster", "_rid", "n", F.coalesce("root", "_rid").alias("root")), "rooted")
    sized = rooted.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    sized = sized.select("cluster", "root", F.greatest(F.ceil(F.col("rows") * 2 / ROWS), F.ceil(F.col("shingles") * 2 / SHINGLES)).alias("parts"), "rows", "shingles")
    # A root that fills blocks has its own, by row; the others share blocks by root. Two blocks fit into one task.
    rest = sized.where("parts = 1").groupBy("cluster").agg(F.greatest(F.ceil(F.sum("rows") * 2 / ROWS), F.ceil(F.sum("shingles") * 2 / SHINGLES)).alias("shared"))
    blocks = stored(sized.join(rest, "cluster", "left").select("cluster", "root", "parts", F.coalesce("shared", F.lit(1).cast("long")).alias("shared")), "blocks")
    block = F.when(F.col("parts") > 1, F.xxhash64("root", F.pmod(F.xxhash64("_rid"), "parts"))).otherwise(F.pmod(F.xxhash64("root"), "shared"))
    placed = stored(rooted.join(blocks, ["cluster", "root"]).select("cluster", "_rid", "root", block.alias("block")), "placed")
    there = placed.groupBy("cluster", "block").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    other = there.select("cluster", F.col("block").alias("with"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    pairs = there.join(other, "cluster").where("block <= with and not (least = most and least2 = most2 and least = least2)")
    pairs = pairs.select("cluster", F.xxhash64("block", "with").alias("task"), F.explode(F.array_distinct(F.array("block", "with"))).alias("block"))
    tasks = placed.join(stored(pairs, "block-pairs"), ["cluster", "block"]).select("cluster", "task", "root", "_rid")
    return links.unionByName(first).unionByName(dealt(tasks))


def jaccard_components(docs: DataFrame, percent: int = 85, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach, itself included) of each row of docs.

    Two rows link if 100 * |A and B| >= percent * |A or B| for their sets of distinct runs of ``words`` words, A-Z lower-cased; fewer words are one run.
    A text that is null or has no words has an empty set, and links with nothing. A null id counts after all others, and is its
    own component's id only if there is no other; rows that share an id are rows; an empty table gives no rows; other columns are not looked at.
    """
    rows = numbered(settled(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    text, key = "c_text", F.coalesce("c_id", F.lit(NULL_ID))
    groups = similar_groups(rows, percent, words, text).join(rows.select("_rid", "c_id"), "_rid")
    groups = stored(groups.select(F.col("c_id").alias("doc_id"), "n", "group", key.alias("k")), "grouped")
    least = stored(groups.groupBy("group").agg(F.min("k").alias("least")), "least")
    removed(rows)
    return groups.join(least, "group").select("doc_id", F.col("n").alias("n_shingles"), F.nullif("least", F.lit(NULL_ID)).alias("component_id"))

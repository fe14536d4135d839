"""SimHash near duplicates: fingerprints, vantage-point shards over bit blocks, exact pairs, components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, among, release, removed, settled, stored, trimmed, words_of

SHINGLE = 3
RADIUS = 3
#: Fingerprints compared with each other at best, and those of a shard that one task holds (8 MB).
LEAF, TASK_LEAF = 1024, 1 << 20
#: Most fingerprints in the sample that a tree is grown on, vantage points tried at a node, most levels of the trees that make shards.
SAMPLE, TRIES, LEVELS = 1 << 15, 24, 12


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words; of the whole sequence if there are fewer; none without words."""
    w = words_of(text)
    if len(w) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)] if w else [], np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in runs), np.uint64, len(w) - k + 1)


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes; zero without words. Long texts are summed in pieces."""
    h = shingle_hashes(text, k)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), k) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), fp], names=["doc_id", "fp"])

    return settled(docs).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(trimmed(each), "doc_id long, fp long")


@dataclass
class Tree:
    """Vantage points over the bits of mask, for pairs that differ in at most radius of those bits.

    Node i sends a fingerprint to 2i+1 if its distance d to vantage[i] is at most cut[i], and to 2i+2 if d > cut[i] - radius.
    By the triangle inequality two fingerprints within radius have distances within radius, so if they part, the nearer
    one goes both ways: each such pair meets in a leaf. cut -1 marks a leaf.
    """

    mask: int
    radius: int
    vantage: dict[int, int] = field(default_factory=dict)
    cut: dict[int, int] = field(default_factory=dict)

    def grow(self, sample: np.ndarray, levels: int, seed: int) -> Tree:
        rng, todo = np.random.default_rng(seed), [(0, sample & np.uint64(self.mask), levels)]
        while todo:
            node, points, left = todo.pop()
            if left == 0 or len(points) < 16:
                continue
            best = None
            for v in rng.choice(points, min(TRIES, len(points)), replace=False):
                d = np.bitwise_count(points ^ v)
                n = np.cumsum(np.bincount(d, minlength=65))
                for cut in range(int(np.percentile(d, 25)), int(np.percentile(d, 75)) + 1):
                    inside, both = n[cut], n[cut] - (n[cut - self.radius] if cut >= self.radius else 0)
                    cost = max(inside, len(points) - inside + both)  # the larger child
                    if best is None or cost < best[0]:
                        best = (cost, int(v), cut, d)
            cost, v, cut, d = best
            if cost >= 0.95 * len(points):
                continue  # copies so near to each other that no cut parts them
            self.vantage[node], self.cut[node] = v, cut
            todo += [(2 * node + 1, points[d <= cut], left - 1), (2 * node + 2, points[d > cut - self.radius], left - 1)]
        return self

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, index into fps) of every leaf that each fingerprint visits."""
        points, leaves, todo = fps & np.uint64(self.mask), [], [(0, np.arange(len(fps)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node not in self.cut:
                leaves.append((np.full(len(at), node, np.int64), at))
                continue
            d = np.bitwise_count(points[at] ^ np.uint64(self.vantage[node])).astype(np.int64)
            todo += [(2 * node + 1, at[d <= self.cut[node]]), (2 * node + 2, at[d > self.cut[node] - self.radius])]
        if not leaves:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*leaves, strict=True))


def forest(unique: DataFrame, n: int, radius: int = RADIUS) -> list[Tree]:
    """One tree for each 32-bit half: fingerprints within radius differ in at most radius // 2 bits of one of them."""
    share = min(1.0, SAMPLE / max(1, n))
    bound = int(share * 2**63) - 1
    rows = unique.where(F.xxhash64("fp", F.lit(7)).bitwiseAND(F.lit(2**63 - 1)) <= bound).select("fp").limit(2 * SAMPLE).collect()  # the limit only bounds the sample
    sample = np.sort(np.array([r.fp for r in rows], np.int64)).view(np.uint64)
    levels = int(np.clip(np.ceil(np.log2(max(1, n / LEAF))), 0, LEVELS)) if len(sample) else 0
    halves = [0xFFFFFFFF, 0xFFFFFFFF << 32]
    return [Tree(m, radius // 2).grow(sample, levels, seed) for seed, m in enumerate(halves)]


def forest_edges(fps: np.ndarray, radius: int, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smallest of its group) of a spanning forest of the fingerprints within radius; no pair list is kept."""
    fps = np.unique(fps)
    u, label = fps.view(np.uint64), np.arange(len(fps))
    step = max(1, block // max(1, len(fps)))
    for lo in range(0, len(u), step):
        near = np.bitwise_count(u[lo : lo + step, None] ^ u[None, lo:]) <= radius
        for i in np.flatnonzero(near.sum(1) > 1):
            own = np.unique(label[lo + np.flatnonzero(near[i])])
            if len(own) > 1:
                label[np.isin(label, own)] = own[0]
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def shard_edges(fps: np.ndarray, mask: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """forest_edges of a shard of any size: above a few leaves it grows its own tree over the shard's bits and compares leaf by leaf."""
    fps = np.unique(fps)
    if len(fps) <= 4 * LEAF:
        return forest_edges(fps, radius)
    u = fps.view(np.uint64)
    sample = np.random.default_rng(len(fps)).choice(u, min(SAMPLE, len(u)), replace=False)
    tree = Tree(mask, radius // 2).grow(sample, int(np.ceil(np.log2(len(fps) / LEAF))), 5)
    leaf, at = tree.route(u)
    order = np.argsort(leaf, kind="stable")
    parts = np.split(at[order], np.flatnonzero(np.diff(leaf[order])) + 1)
    found = [forest_edges(fps[p], radius) for p in parts]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def links(unique: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links u, v, as a stored table, between distinct fingerprints that have the same components as all pairs within radius.

    Each fingerprint goes to the leaves that it visits in either tree (a few rows each); a leaf compares its fingerprints
    exactly over all 64 bits and returns a spanning forest, so a group of copies makes as many links as it has members.
    The trees make at most 2**LEVELS leaves; a leaf that outgrows LEAF goes on by a tree of its own, grown in its task, so
    work follows the number of fingerprints and not its square. A leaf above TASK_LEAF is dealt to a triangle of tasks, each with two of its parts. Leaves' counts (at most 2**13) go
    to the driver.
    """
    trees = forest(unique, unique.count(), radius)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy().astype(np.int64)
            for t, tree in enumerate(trees):
                leaf, at = tree.route(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(leaf * 2 + t), pa.array(fps[at])], names=["leaf", "fp"])

    visits = stored(unique.select("fp").mapInArrow(trimmed(visit), "leaf long, fp long"), "visits")
    large = [(r.leaf, -(-r.n // (TASK_LEAF // 2))) for r in visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_LEAF).collect()]
    parts = visits.sparkSession.createDataFrame(large or [(-1, 1)], "leaf long, parts long")
    mine = F.pmod(F.xxhash64("fp"), "parts")
    tasks_of = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.least(p, F.col("mine")) * F.col("parts") + F.greatest(p, F.col("mine")))
    dealt = visits.join(F.broadcast(parts), "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("mine", mine)
    dealt = dealt.select("leaf", F.explode(tasks_of).alias("task"), "fp")

    def leaf_links(group: pd.DataFrame) -> pd.DataFrame:
        u, v = shard_edges(group["fp"].to_numpy(np.int64), trees[group["leaf"].iloc[0] % 2].mask, radius)
        release()
        return pd.DataFrame({"u": u, "v": v})

    out = stored(dealt.groupBy("leaf", "task").applyInPandas(leaf_links, "u long, v long").distinct(), "fingerprint-links")
    removed(visits)
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root of each node of edges(u, v), as a stored table: the smallest node that it reaches, by alternating large-star and small-star.

    Each round is a stored table, which goes when the next is there. It ends when a round changes nothing; if most_rounds did not reach that, it raises.
    """
    mark = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before = mark(e)
    for _ in range(most_rounds if before.n else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        used, e = e, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        removed(used)
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        if before.n:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    out = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    removed(e)
    return out


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links of fingerprints within radius) of each row.

    Equal fingerprints, such as those of exact copies, are one node, so a huge group of copies costs one fingerprint; nodes
    without a link keep the smallest id of their rows. Ids meet fingerprints by equi-joins.

    Texts without words (null, empty, white space) have fingerprint zero and link as any other. A null id counts after all
    others, and its component_id is null if there is no other; repeated rows are kept as rows; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, k, id_col, text_col), "fingerprints")
    unique = stored(rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("least")), "unique")
    found = links(unique, radius)
    roots = components(found)
    removed(found)
    linked = unique.join(roots, F.col("fp") == F.col("node"))
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest"))
    of = unique.join(roots, F.col("fp") == F.col("node"), "left").join(lowest, "root", "left")
    of = of.select(F.col("fp"), F.nullif(F.coalesce("lowest", "least"), F.lit(NULL_ID)).alias("component_id"))
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def numbered(docs: DataFrame) -> DataFrame:
    """docs, stored, with a number of its own for each row in ``_rid``; each column's name gets ``c_`` before it, so none can clash."""
    names = [F.col(f"`{c}`").alias(f"c_{c}") for c in docs.columns]
    return stored(settled(docs).select(*names, F.monotonically_increasing_id().alias("_rid")), "numbered")


def unnumbered(rows: DataFrame) -> DataFrame:
    """Rows of a ``numbered`` table as they were."""
    return rows.select(*(F.col(f"`{c}`").alias(c.removeprefix("c_")) for c in rows.columns if c != "_rid"))


def firsts(groups: DataFrame, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """_rid of one row of a ``numbered`` table for each group of groups(_rid, group): that of the smallest id, null ids last, then of the smallest number."""
    ids = rows.select("_rid", F.col(f"c_{id_col}").alias("_id"))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_rid").alias("rid"))
    return groups.join(ids, "_rid").groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.rid").alias("_rid"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs, all columns, for each group: that of the smallest id. Rows stand for themselves, whatever their ids: null ids come
    after all others, and neither rows without an id nor rows that share one are copies of each other unless their texts link them."""
    rows = numbered(docs)
    found = near_duplicates(rows, id_col="_rid", text_col=f"c_{text_col}", **options).select(F.col("doc_id").alias("_rid"), F.col("component_id").alias("group"))
    return unnumbered(among(rows, stored(firsts(found, rows, id_col), "firsts")))

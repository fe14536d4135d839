"""Benchmark passages in documents within an edit distance: CGK embedding, bit-sampling LSH, exact verification."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, trimmed

#: A passage holds an item if they differ in at most 1 - SIMILARITY of the item's words (inserted, deleted or replaced).
SIMILARITY = 0.8
#: By the least words of an item: steps of a walk, steps sampled for a key, words between window starts. Shorter items are met word by word.
WALKS = {8: (8, 4, 1), 12: (10, 5, 2), 20: (12, 6, 4)}
#: The part of passages with as many evenly spread edits as SIMILARITY allows that walks must find; repetitions follow from it, up to MOST_TABLES.
RECALL, MOST_TABLES, TRIALS = 0.99, 32, 1000
#: Unknown words that part documents in a batch: no walk goes over them.
GAP = 12
#: Items, and characters of items, that a task holds at once; a larger benchmark is searched in blocks. Words of documents embedded together.
BLOCK, CHARS, TOGETHER = 20_000, 2_000_000, 2_000_000
WORDS = re.compile(r"[^\W_]+")


def words_in(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORDS.findall(text.lower()) if text else []


def shared(bag: dict[int, int], words: list[int]) -> int:
    """Words that the bag and the list have in common, repeats counted."""
    left = dict(bag)
    n = 0
    for w in words:
        if left.get(w, 0) > 0:
            left[w] -= 1
            n += 1
    return n


def distance_rows(item: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Edit distance of the item to the best substring of the region that ends before each position 0..len(region)."""
    ramp = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != w))
        row = np.minimum.accumulate(new - ramp) + ramp
    return row


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the region's part nearest to the item; of equal ones the first end, then the shortest."""
    forward = distance_rows(item, region)
    end = int(forward.argmin())
    back = distance_rows(item[::-1], region[:end][::-1])
    return int(forward[end]), end - int(np.flatnonzero(back == forward[end])[0]), end


@dataclass
class Walks:
    """CGK walks over the windows of a length class: for each table the bits that move the pointer and the sampled steps; with
    items, also the sorted keys of all their offsets, where each key's run begins (and the end), and its items and offsets."""

    stride: int
    bits: np.ndarray
    samples: np.ndarray
    keys: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def random(steps: int, sampled: int, stride: int, tables: int, symbols: int, seed: int = 4) -> Walks:
        rng = np.random.default_rng(seed)
        samples = np.sort(np.stack([rng.choice(steps, sampled, replace=False) for _ in range(tables)]), axis=1)
        return Walks(stride, rng.integers(0, 2, (tables, steps, symbols), dtype=np.int8), samples)

    @staticmethod
    def word_by_word(words: int, symbols: int) -> Walks:
        """One table whose walk moves on at every step and samples them all: its key is the window itself."""
        return Walks(1, np.ones((1, words, symbols), np.int8), np.arange(words)[None])

    def holding(self, items: dict[int, np.ndarray], offsets: int | None = None) -> Walks:
        """These walks with the keys of the items, at all their offsets or the first few."""
        pad = np.zeros(GAP, np.int32)
        flat = np.concatenate([np.r_[x, pad] for x in items.values()])
        lengths = np.array([len(x) for x in items.values()])
        many = np.minimum(lengths, offsets or lengths)
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own, start = np.repeat(np.array(list(items)), many), offset + np.repeat(np.cumsum(lengths + GAP) - lengths - GAP, many)
        for t in range(len(self.bits)):
            at, key = self.walk(flat, start, t)
            order = np.argsort(key, kind="stable")
            sorted_, first = np.unique(key[order], return_index=True)
            self.keys.append((sorted_, np.r_[first, len(key)], own[at][order], offset[at][order]))
        return self

    def walk(self, words: np.ndarray, starts: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into starts, key) of the windows whose sampled symbols are all words of items.

        The CGK walk: at each step the symbol under the pointer goes out, and a random bit of (step, symbol) tells whether
        the pointer moves on; two windows within a few edits come back into step and put out equal symbols at most steps.
        """
        at, pointer, key = np.arange(len(starts)), starts.copy(), np.zeros(len(starts), np.uint64)
        sampled = set(self.samples[t].tolist())
        for j in range(max(sampled) + 1):
            w = words[pointer]
            if j in sampled:
                known = w > 0
                at, pointer, key, w = at[known], pointer[known], key[known], w[known]
                key = (key ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            pointer = pointer + self.bits[t, j][w]
        return at, key

    def met(self, words: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """For each table (place, item): where an item would begin, from the windows whose key it shares."""
        out = []
        for t, (keys, first, own, offset) in enumerate(self.keys):
            at, key = self.walk(words, starts, t)
            if not len(keys):
                out.append(np.zeros((2, 0), np.int64))
                continue
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[k] == key)
            n = first[k[hit] + 1] - first[k[hit]]
            rows = np.repeat(first[k[hit]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(hit) else np.zeros(0, np.int64)
            out.append(np.stack([np.repeat(starts[at[hit]], n) - offset[rows], own[rows]]))
        return out


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """words after so many insertions, deletions and replacements, spread evenly, which leaves the shortest runs; new words are unknown (0)."""
    out = words.tolist()
    for k, (kind, where) in enumerate(zip(rng.integers(0, 3, edits), rng.random(edits), strict=True)):
        i = min(len(out) - 1, int((k + 0.25 + where / 2) / edits * len(out)))
        out[i : i + int(kind > 0)] = [0] * int(kind < 2)
    return np.array(out, np.int32)


@cache
def tables_for(least: int, recall: float = RECALL) -> int:
    """The fewest tables with which ``recall`` of simulated passages of ``least`` words with as many edits as allowed are found.

    The shortest items of a class have the fewest windows, so longer ones are found at least as often.
    """
    steps, sampled, stride = WALKS[least]
    rng = np.random.default_rng(least)
    items = {i: np.arange(1 + i * least, 1 + (i + 1) * least, dtype=np.int32) for i in range(TRIALS)}
    walks = Walks.random(steps, sampled, stride, MOST_TABLES, TRIALS * least + 1).holding(items)
    words = [np.r_[np.zeros(rng.integers(GAP, GAP + stride), np.int32), edited(x, int(least * (1 - SIMILARITY) + 1e-9), rng)] for x in items.values()]
    words = np.concatenate([*words, np.zeros(GAP, np.int32)])
    found = np.zeros((MOST_TABLES, TRIALS), bool)
    for t, (_, item) in enumerate(walks.met(words, np.arange(0, len(words) - GAP, stride))):
        found[t, item] = True
    enough = np.flatnonzero(np.logical_or.accumulate(found).mean(1) >= recall)
    return int(enough[0]) + 1 if len(enough) else MOST_TABLES


@dataclass
class Index:
    """The items of a block, their words as numbers (0: a word of no item), and walks for each class of length that occurs."""

    ids: list[int]
    vocabulary: dict[str, int]
    items: list[np.ndarray]
    walks: list[Walks]

    @staticmethod
    def over(rows: list[tuple[int, str | None]]) -> Index:
        vocabulary: dict[str, int] = {}
        ids, items, classes = [], [], {}
        for item_id, text in rows:
            if w := words_in(text):
                classes.setdefault(max((c for c in WALKS if c <= len(w)), default=-len(w)), []).append(len(ids))
                ids.append(item_id)
                items.append(np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.int32))
        walks, symbols = [], len(vocabulary) + 1
        for c, some in sorted(classes.items()):
            own = {k: items[k] for k in some}
            walks.append(Walks.word_by_word(-c, symbols).holding(own, 1) if c < 0 else Walks.random(*WALKS[c], tables_for(c), symbols).holding(own))
        return Index(ids, vocabulary, items, walks)

    def candidates(self, words: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item): where an item would begin, from the windows of each document whose key it shares in some table."""
        found = []
        for w in self.walks:
            many = -(-lengths // w.stride)
            starts = np.repeat(first, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * w.stride
            found += w.met(words, starts)
        both = np.unique(np.concatenate(found, 1), axis=1) if found else np.zeros((2, 0), np.int64)
        return both[0], both[1]

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of each item that a text holds, once with its nearest passage."""
        get = self.vocabulary.get
        batch, size = [], 0
        for i, t in enumerate(texts):
            w = np.fromiter((get(x, 0) for x in words_in(t)), np.int32)
            if len(w):
                batch.append((i, w))
                size += len(w) + GAP
            if size > TOGETHER:
                yield from self.search_words(batch)
                batch, size = [], 0
        yield from self.search_words(batch)

    def search_words(self, batch: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, int, int, int]]:
        if not batch or not self.items:
            return
        gap = np.zeros(GAP, np.int32)
        words = np.concatenate([x for _, w in batch for x in (w, gap)])
        lengths = np.array([len(w) for _, w in batch])
        first = np.r_[0, np.cumsum(lengths + GAP)[:-1]]
        place, item = self.candidates(words, first, lengths)
        doc = np.clip(np.searchsorted(first, place, side="right") - 1, 0, None)
        tried: dict[tuple[int, int], int] = {}
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        bags: dict[int, dict[int, int]] = {}
        for a, d, k in zip(place.tolist(), doc.tolist(), item.tolist(), strict=True):
            x = self.items[k]
            most = int(len(x) * (1 - SIMILARITY) + 1e-9)
            if tried.get((d, k), -(10**9)) >= a:
                continue  # the last region began at most two words before and holds this one's
            lo, hi = max(int(first[d]), a - most), min(int(first[d] + lengths[d]), a + len(x) + most + 2)
            tried[d, k] = a + 2
            region = words[lo:hi]
            own = bags.get(k) or bags.setdefault(k, Counter(x.tolist()))
            if len(region) < len(x) - most or shared(own, region.tolist()) < len(x) - most:
                continue  # each word that isn't shared costs an edit
            distance, start, end = best_match(x, region)
            if distance <= most and ((d, k) not in best or distance < best[d, k][0]):
                best[d, k] = (distance, lo - int(first[d]) + start, lo - int(first[d]) + end)
        for (d, k), found in sorted(best.items()):
            yield (batch[d][0], k, *found)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK items and CHARS characters at most, by id: each offset of an item is in every table, so the characters
    bound what a task and the driver hold (some 60 MB of tables a block)."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).dropna().dropDuplicates()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("t")).alias("c")).first()
    parts = max(1, -(-size.n // BLOCK), -(-(size.c or 0) // CHARS))
    for p in range(parts):
        yield sorted((r.i, r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, distance, start_word, end_word: an item that a document's whole text holds, with its nearest passage.

    Documents don't move: each task walks its own windows and looks their keys up among those of a block of items, so
    neither a frequent passage nor a long document makes a hot key. Every offset of an item is indexed, so each window of a
    passage that begins between edits is in step with the item; tables are as many as the target recall asks for. Items below
    the least class of WALKS are met where all their words follow each other.

    A null or empty text holds nothing; null items and items without words are not looked for; a row of docs whose id is null or repeated is searched as its own row; empty tables give no rows; other columns are not looked at.
    """
    spark, out = settled(docs).sparkSession, None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    schema = "doc_id long, item_id long, similarity double, distance int, start_word int, end_word int"
    for items in blocks(benchmark):
        index = Index.over(items)

        def each(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = list(index.search(b.column(1).to_pylist()))
                doc = b.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                item = [index.ids[f[1]] for f in found]
                like = [1 - f[2] / len(index.items[f[1]]) for f in found]
                ints = [pa.array([f[i] for f in found], pa.int32()) for i in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([doc, pa.array(item, pa.int64()), pa.array(like, pa.float64()), *ints], names=[x.split()[0] for x in schema.split(", ")])

        part = rows.mapInArrow(trimmed(each), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text holds no item."""
    at, out = docs.columns.index(text_col), settled(docs)
    for items in blocks(benchmark):
        index = Index.over(items)

        def each(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[f[0] for f in index.search(b.column(at).to_pylist())]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(trimmed(each), docs.schema)
    return out

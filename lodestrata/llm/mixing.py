"""Mixing sources to target weights: blocks of words, drawn by permuted index, joined by index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, prefix_sums, settled, stored, trimmed

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 128
OUT_SHARDS = 64
SEED = 20
#: Slots that one row of the drawing plan stands for before it is expanded.
RUN = 1 << 15


@dataclass(frozen=True)
class Source:
    """Code (order by code point, null last), name, words, target in words, blocks, slots."""

    code: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Each source's words: the sum of sizes by weight, at most ``most`` times its size, what is above shared again by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, open_ = sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(w[i] for i in open_)
        full = [i for i in open_ if w[i] * left > most * sizes[i] * total]
        if not full:
            for i in open_:
                out[i] = w[i] * left / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= most * sizes[i]
        open_ -= set(full)
    return out


def source_plan(sizes: dict[str | None, int], block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[Source]:
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    out = []
    for code, (name, target) in enumerate(zip(names, targets([sizes[k] for k in names], weights, most), strict=True)):
        n = -(-sizes[name] // block)
        passes = int(target // sizes[name]) if sizes[name] else 0
        rest = min(n, int((target - passes * sizes[name]) / block + 0.5))
        out.append(Source(code, name, sizes[name], target, n, passes * n + rest))
    return out


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each element a pseudorandom permutation of 0..n-1, set by key, at i: four Feistel rounds, walked until inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(2, n)) / 2).astype(np.int64))
    mask = (np.int64(1) << half) - 1
    out, todo = i.astype(np.int64).copy(), np.arange(len(i))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            f = ((right + k + r * 15485863) % (1 << 31) * 1103515245 % (1 << 31)) >> 11
            left, right = right, left ^ (f & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out


def permutation_key(code: np.ndarray | int, epoch: np.ndarray | int, seed: int) -> np.ndarray | int:
    return (seed * 7919 + code * 104729 + epoch * 1299709) % (1 << 31)


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source (column) in each output shard (row): multinomial draws from what is left, so columns add up exactly."""
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for s in range(shards):
        n = -(-int(left.sum()) // (shards - s))
        if n:
            take = np.minimum(rng.multinomial(n, left / left.sum()), left) if s < shards - 1 else left.copy()
            for i in np.argsort(take - left, kind="stable"):  # what a nearly empty source could not give
                take[i] += min(int(n - take.sum()), int(left[i] - take[i]))
            out[s], left = take, left - take
    return out


def draws(spark: SparkSession, plan: list[Source], shards: int = OUT_SHARDS, seed: int = SEED) -> DataFrame:
    """One row for each slot of the mix: shard, code, slot (of the source), block, epoch."""
    own, at, runs = [], [0] * len(plan), 0
    for shard, row in enumerate(shard_counts([s.slots for s in plan], shards, seed)):
        for s, n in zip(plan, row.tolist(), strict=True):
            if n:
                own.append((shard, s.code, s.blocks, at[s.code], at[s.code] + n))  # a row for each shard and source, whatever the corpus's size
            at[s.code] += n
            runs += -(-n // RUN)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, n, slot = (b.column(k).to_numpy().astype(np.int64) for k in ("code", "blocks", "slot"))
            epoch = slot // n
            block = permuted(slot % n, n, permutation_key(code, epoch, seed))
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("code"), b.column("slot"), pa.array(block), pa.array(epoch.astype(np.int32))], names=["shard", "code", "slot", "block", "epoch"])

    each = spark.createDataFrame(own or [(0, 0, 1, 0, 0)], "shard int, code int, blocks long, lo long, hi long").where("lo < hi")
    each = each.select("shard", "code", "blocks", "hi", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(RUN))).alias("lo"))  # runs, made by the tasks
    each = each.repartition(min(1000, max(1, runs // 4))).select("shard", "code", "blocks", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + RUN, F.col("hi")) - 1)).alias("slot"))
    return each.mapInArrow(trimmed(walk), "shard int, code int, slot long, block long, epoch int")


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    """rows: the input's chosen columns with code, size, row (its number in the source); segments: row's part lo..hi (in its words) in a block; draws; plan."""

    rows: DataFrame
    segments: DataFrame
    draws: DataFrame
    plan: list[Source]


def mix(docs: DataFrame, columns: list[str], block: int = BLOCK, shards: int = OUT_SHARDS, seed: int = SEED, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> Mix:
    """The plan of a mix in which each source has close to its target of words.

    A source's documents, by id (rows that share one by a hash of the text), are one stream of words cut into blocks of ``block`` words. A source gives as many blocks
    as its target asks for: whole passes, then a part of one. Output shards draw counts of sources by multinomial sampling
    without replacement; a source's slots go through a pseudorandom permutation of its block numbers (another in each pass)
    and meet the blocks by an equi-join on (source, block). No block is drawn more than ``MOST`` times, so no document is.
    A hot source spreads over range partitions by id, and its blocks are separate keys. Per source only a name and totals
    go to the driver, so their number must be one that it can list.

    A null text has no words; a null source is a source, the last; null ids and repeated rows are rows of their own;
    without words nothing is drawn; an empty table gives an empty plan. Clashing column names cannot occur: inner names start with an underscore.
    """
    spark = settled(docs).sparkSession
    sized = docs.select(*[F.col(c).alias(f"_c_{c}") for c in columns], F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text_col).alias("_size"), F.xxhash64(text_col).alias("_tie"))
    sized = stored(sized, "sizes")  # words are counted once
    sizes = {r._source: r.n for r in sized.groupBy("_source").agg(F.sum("_size").alias("n")).collect()}
    plan = source_plan(sizes, block)
    codes = spark.createDataFrame([(s.code, s.name) for s in plan] or [(0, None)], "_code int, _name string")
    coded = sized.join(F.broadcast(codes), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    rows, _ = prefix_sums(coded, ["_id", "_tie"], "_size", "_code")
    rows = rows.withColumnRenamed("_index", "_row")
    blocks = F.sequence(F.expr(f"_before div {block}"), F.expr(f"(_before + _size - 1) div {block}"))
    segments = rows.where("_size > 0").select("_code", "_row", "_before", "_size", F.explode(blocks).alias("_block"))
    lo = F.greatest(F.col("_block") * block - F.col("_before"), F.lit(0))
    hi = F.least(F.col("_block") * block + block - F.col("_before"), F.col("_size"))
    segments = segments.select("_code", "_row", "_block", lo.alias("_lo"), hi.alias("_hi"))
    drawn = draws(spark, plan, shards, seed).toDF("_shard", "_code", "_slot", "_block", "_epoch")
    return Mix(rows, segments, drawn, plan)


def taken(m: Mix) -> DataFrame:
    """The rows with ``_taken``, the words of each that the mix holds. Block numbers shuffle so small that adaptive execution would
    broadcast them all, hence the hints."""
    times = m.draws.groupBy("_code", "_block").agg(F.count(F.lit(1)).alias("_times"))
    got = m.segments.join(times.hint("merge"), ["_code", "_block"]).groupBy("_code", "_row").agg(F.sum((F.col("_hi") - F.col("_lo")) * F.col("_times")).alias("_taken"))
    return m.rows.join(got, ["_code", "_row"], "left").withColumn("_taken", F.coalesce("_taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with doc_id, text, lang, source, n_chars as the mix has them.

    A document stands there once for each pass in which it was drawn: whole passes give it as it is; in the last, partial
    pass it keeps the words of its drawn blocks, joined by spaces (or all of its text if all were drawn). Documents without
    words, which no block can hold, stay once. The plan is made over numbered rows without their texts, which meet it once at the end.
    """
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    base = stored(docs.select(*cols, F.monotonically_increasing_id().alias("_rid")), "mixed")
    m = mix(base, ["_rid"], **options)
    times = m.draws.groupBy("_code", "_block").agg(F.count(F.lit(1)).alias("_times"))
    passes = F.create_map(*[F.lit(v) for s in m.plan for v in (s.code, s.slots // max(1, s.blocks))]) if m.plan else F.create_map(F.lit(0), F.lit(0))
    rest = F.col("_times") - F.element_at(passes, F.col("_code"))
    parts = m.segments.join(times.hint("merge"), ["_code", "_block"]).where(rest > 0).groupBy("_code", "_row")
    parts = parts.agg(F.sort_array(F.collect_list(F.struct("_lo", "_hi"))).alias("_parts"), F.sum(F.col("_hi") - F.col("_lo")).alias("_n"))
    rows = m.rows.join(parts, ["_code", "_row"], "left").withColumn("_whole", F.when(F.col("_size") == 0, 1).otherwise(F.element_at(passes, F.col("_code")) + F.coalesce(F.col("_n") == F.col("_size"), F.lit(False)).cast("int")))
    rows = rows.where((F.col("_whole") > 0) | F.col("_n").isNotNull()).select(F.col("_c__rid").alias("_rid"), "_whole", "_n", "_size", "_parts")
    rows = base.join(rows, "_rid")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice(words, (p["_lo"] + 1).cast("int"), (p["_hi"] - p["_lo"]).cast("int")))), " ")
    texts = F.array_repeat(F.struct(F.col("text").alias("t"), F.lit(False).alias("cut")), F.col("_whole").cast("int"))
    texts = F.when(F.col("_n") < F.col("_size"), F.concat(texts, F.array(F.struct(cut.alias("t"), F.lit(True).alias("cut"))))).otherwise(texts)
    rows = rows.select(*cols, F.explode(texts).alias("_x"))
    n_chars = F.when(F.col("_x.cut"), F.char_length("_x.t")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select("doc_id", F.col("_x.t").alias("text"), "lang", "source", n_chars.alias("n_chars"))

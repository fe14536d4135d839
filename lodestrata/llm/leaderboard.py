"""A change feed of per-group leaderboards: tournament trees kept as the state of a streaming query."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import _place, scratch_root, settled, stored, trimmed

#: Places of a board, items of a leaf (about), children of a node at most.
KEEP, LEAF_ITEMS, FAN = 10, 8192, 64
#: Rows that a task combines by (group, item, day) before they are shuffled.
COMBINED = 200_000
#: Fixed values of the contract: day 0 of the cut, its days, days that a line may be late.
FIRST_DAY, DAYS, LATENESS = 19723, 180, 15
LISTS = "grp int, child int, arrival long, batch int, best binary, fallen binary"
CHANGES = "grp int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"
STATE = "entries binary, best binary"
NOTHING = np.zeros((0, 2), np.int64)


def cut_lines(lines: DataFrame, vendors: DataFrame, items: DataFrame, batches: int = 8) -> DataFrame:
    """grp, item, day, arrival, batch, cents, counts of each line, as the contract has them. counts: whether its nation and item are known.

    Lookups are sort-merge joins at every size, as both tables grow with the input; what is left of a line before them is four
    numbers: its signed cents (or, without an amount, its signed quantity), its keys, and its days in one. Tables with several
    rows for a key give the smallest value, so no line is doubled.
    """
    known = stored(items.where("item_id is not null").groupBy("item_id").agg(F.min("price").alias("_price")), "items")
    seller = stored(vendors.where("vendor_id is not null").groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("grp")), "vendors")
    whole = lambda x: F.floor(F.lit(100.0) * x + F.lit(0.5)).cast("double")
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")))
    day = F.coalesce(F.unix_date(F.col("shipped_at").cast("date")).cast("long"), F.lit(FIRST_DAY) + F.col("_h") % 150)
    late = F.col("_h") % 7 + F.when(F.col("_h") % 5 == 0, 20).otherwise(0)
    paid, sign = whole(F.col("amount").cast("double")), F.when(F.col("flag") == "swapped", -1.0).otherwise(1.0)
    out = lines.withColumn("_h", F.crc32(text))
    # The lowest bit tells a quantity from cents, the next five have the arrival's distance from the day (26 at most).
    out = out.select("item_id", "vendor_id", (sign * F.coalesce(paid, F.col("quantity").cast("double"), F.lit(0.0))).alias("_v"), (day * 64 + late * 2 + F.when(paid.isNull(), 1).otherwise(0)).alias("_d"))
    out = out.join(seller.hint("merge"), "vendor_id", "left").drop("vendor_id").join(known.select("item_id", "_price", F.lit(True).alias("_known")).hint("merge"), "item_id", "left")
    out = out.withColumn("day", F.shiftright("_d", 6)).withColumn("arrival", F.col("day") + F.shiftright("_d", 1).bitwiseAND(F.lit(31)))
    cents = F.floor(F.when(F.col("_d").bitwiseAND(F.lit(1)) == 1, F.coalesce(F.col("_v") * whole(F.col("_price")), F.lit(0.0))).otherwise(F.col("_v")))
    batch = F.least(F.lit(batches).cast("long"), 1 + F.floor((F.col("arrival") - FIRST_DAY) * batches / F.lit(float(DAYS)))).cast("int")
    return out.select("grp", F.col("item_id").alias("item"), "day", "arrival", batch.alias("batch"), cents.alias("cents"), (F.col("grp").isNotNull() & F.coalesce("_known", F.lit(False))).alias("counts"))


def best_of(items: np.ndarray, values: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """(item, value) of the ten highest positive values, ties to the smaller item."""
    if len(values) > 4 * keep:
        least = max(1, np.partition(values, -keep)[-keep])
        at = np.flatnonzero(values >= least)
    else:
        at = np.flatnonzero(values > 0)
    at = at[np.lexsort((items[at], -values[at]))][:keep]
    return np.c_[items[at], values[at]]


def lost(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Items of one list that the next doesn't have."""
    return before[~np.isin(before[:, 0], after[:, 0]), 0]


def table_of(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, width)


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's rows by all columns but cents, a bounded number of rows at a time: a hot item is a row a day for each task."""
    held, rows = [], 0

    def summed() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        keys = [c for c in t.column_names if c != "cents"]
        yield from t.group_by(keys).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"]).select(t.column_names).combine_chunks().to_batches()

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= COMBINED:
            yield from summed()
            held, rows = [], 0
    if rows:
        yield from summed()


def days_of(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """A group's rows by arrival day, in order."""
    rows = pd.concat(list(frames), ignore_index=True)
    yield from rows.groupby("arrival", sort=True)


def leaf(keep: int) -> Callable:
    """State of a leaf: (item, revenue) of all its items, and its ten best. It tells its node of each day on which these changed."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        grp, own = key
        entries, best = (table_of(x, 2) for x in state.get) if state.exists else (NOTHING, NOTHING)
        rows = pd.concat(list(frames), ignore_index=True)
        arrival, item, cents = (rows[c].to_numpy(np.int64) for c in ("arrival", "item", "cents"))
        items = np.union1d(entries[:, 0], item)
        values = np.zeros(len(items), np.int64)
        values[np.searchsorted(items, entries[:, 0])] = entries[:, 1]
        order = np.argsort(arrival, kind="stable")
        cuts = np.r_[np.flatnonzero(np.r_[True, arrival[order][1:] != arrival[order][:-1]]), len(order)]
        batch, out = int(rows["batch"].iloc[0]), []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[lo:hi]
            np.add.at(values, np.searchsorted(items, item[at]), cents[at])
            now = best_of(items, values, keep)
            if now.tobytes() != best.tobytes():
                gone = lost(best, now)
                out.append((grp, own, int(arrival[at[0]]), batch, now.tobytes(), np.c_[gone, values[np.searchsorted(items, gone)]].astype(np.int64).tobytes()))
                best = now
        state.update((np.c_[items, values].tobytes(), best.tobytes()))
        if out:
            yield pd.DataFrame(out, columns=_names(LISTS))

    return run


def merged(entries: np.ndarray, day: pd.DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """A node's (child, item, revenue) after a day's lists, and what its children's fallen items have now."""
    fresh = [np.c_[np.full(len(t), c), t] for c, b in zip(day["child"], day["best"], strict=True) for t in [table_of(b, 2)]]
    rest = entries[~np.isin(entries[:, 0], day["child"].to_numpy(np.int64))]
    fallen = {int(i): int(v) for b in day["fallen"] for i, v in table_of(b, 2)}
    return np.concatenate([rest, *fresh]), fallen


def values_of(items: np.ndarray, entries: np.ndarray, fallen: dict[int, int]) -> list[int]:
    now = dict(zip(entries[:, 1].tolist(), entries[:, 2].tolist(), strict=True))
    return [now[i] if i in now else fallen[i] for i in items.tolist()]


def node(keep: int) -> Callable:
    """State of a node: its children's lists and its own ten best; it hands on what changed, as a leaf does."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        grp, own = key
        entries, best = (table_of(x, w) for x, w in zip(state.get, (3, 2), strict=True)) if state.exists else (np.zeros((0, 3), np.int64), NOTHING)
        out = []
        for arrival, day in days_of(frames):
            entries, fallen = merged(entries, day)
            now = best_of(entries[:, 1], entries[:, 2], keep)
            if now.tobytes() != best.tobytes():
                gone = lost(best, now)
                told = np.array([gone, values_of(gone, entries, fallen)], np.int64).T
                out.append((grp, own, arrival, int(day["batch"].iloc[0]), now.tobytes(), np.ascontiguousarray(told).tobytes()))
                best = now
        state.update((np.ascontiguousarray(entries).tobytes(), best.tobytes()))
        if out:
            yield pd.DataFrame(out, columns=_names(LISTS))

    return run


def root(keep: int) -> Callable:
    """State of a group's root: its children's lists and the board. Gives each item whose rank a day has changed."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries, board = (table_of(x, w) for x, w in zip(state.get, (3, 2), strict=True)) if state.exists else (np.zeros((0, 3), np.int64), NOTHING)
        out = []
        for arrival, day in days_of(frames):
            entries, fallen = merged(entries, day)
            now, batch = best_of(entries[:, 1], entries[:, 2], keep), int(day["batch"].iloc[0])
            old, new = ({int(i): r for r, i in enumerate(b[:, 0], 1)} for b in (board, now))
            gone = lost(board, now)
            for i, v in [*now.tolist(), *zip(gone.tolist(), values_of(gone, entries, fallen), strict=True)]:
                if old.get(i) != new.get(i):
                    out.append((key[0], arrival, i, batch, "enter" if i not in old else "exit" if i not in new else "move", old.get(i), new.get(i), v))
            board = now
        state.update((np.ascontiguousarray(entries).tobytes(), board.tobytes()))
        if out:
            yield pd.DataFrame(out, columns=_names(CHANGES)).astype({"old_rank": "Int32", "new_rank": "Int32"})

    return run


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


@dataclass(frozen=True)
class Board:
    """The streaming query over lines(grp, item, day, arrival, batch, cents, counts). leaves: of each group's tree; it may not change on one checkpoint."""

    leaves: int
    keep: int = KEEP
    fan: int = FAN

    def changes(self, lines: DataFrame, horizon: int | None) -> DataFrame:
        """CHANGES of a stream of lines. horizon: lines of days before it are dropped.

        Lines are combined in their task, then each level of the trees is one stateful operator keyed by (group, node): the leaves
        share a group's items out by hash, a node has up to ``fan`` children, the last is the group's root. Only nodes above a
        leaf whose ten best have changed get rows.
        """
        ok = F.col("counts") if horizon is None else F.col("counts") & (F.col("day") >= horizon)
        own = F.pmod(F.xxhash64("item"), F.lit(self.leaves)).cast("int")
        out = lines.where(ok).select("grp", own.alias("node"), "item", "arrival", "batch", "cents")
        out = out.mapInArrow(trimmed(combined), "grp int, node int, item long, arrival long, batch int, cents long")
        step = lambda df, f, schema: df.groupBy("grp", "node").applyInPandasWithState(f, schema, STATE, "append", GroupStateTimeout.NoTimeout)
        above = lambda df: df.withColumn("node", F.floor(F.col("child") / self.fan).cast("int"))
        out, width = above(step(out, leaf(self.keep), LISTS)), self.leaves
        while width > self.fan:
            out, width = above(step(out, node(self.keep), LISTS)), -(-width // self.fan)
        return step(out, root(self.keep), CHANGES)


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings that hold while a query is started."""
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def leaderboard_changes(lines: DataFrame, vendors: DataFrame, items: DataFrame, batches: int = 8, lateness: int = LATENESS, keep: int = KEEP, leaf_items: int = LEAF_ITEMS, fan: int = FAN) -> DataFrame:
    """grp, arrival_day, item_id, batch, change, old_rank, new_rank, revenue: what changed on each nation's board, after each arrival day.

    The lines, with what they add, are written by batch to a new folder under spark.checkpoint.dir. The batches are then moved one
    by one to the folder that a streaming query reads; it is started anew for each, on one checkpoint, and appends to one table, so
    a run that breaks off goes on where it stood. The largest days of the batches (one row each) and the number of items go to the
    driver; boards and trees are state, spread over tasks by (nation, node), and trees get leaves with the items.

    Spark's check of plans refuses several applyInPandasWithState in one query, though it takes several flatMapGroupsWithState, which run alike, in
    append mode without timeouts; so that check is off while the query is started. Nothing here depends on watermarks.

    Lines without a nation or a known item change no board but count for lateness; repeated lines count each time; null days, amounts and
    quantities are as in ``cut_lines``; empty tables give no rows; other columns are not looked at.
    """
    spark = settled(lines).sparkSession
    folder = f"{scratch_root(spark)}/lodestrata/leaderboard-{uuid.uuid4().hex}"
    where, store = _place(spark, folder)
    store.deleteOnExit(where)
    path = lambda name: _place(spark, f"{folder}/{name}")[0]
    cut = cut_lines(lines, vendors, items, batches)
    cut.withColumn("k", F.col("batch")).write.partitionBy("k").option("compression", "zstd").parquet(f"{folder}/cut")
    schema = cut.schema
    written = spark.read.schema(cut.schema).parquet(f"{folder}/cut")
    days = {r.batch: r.day for r in written.groupBy("batch").agg(F.max("day").alias("day")).collect()}
    board = Board(max(1, -(-items.count() // leaf_items)), keep, fan)
    store.mkdirs(path("feed"))
    horizon = None
    for k in sorted(days):
        store.rename(path(f"cut/k={k}"), path(f"feed/batch-{k}"))
        with setting(spark, spark__sql__execution__arrow__maxRecordsPerBatch="20000", spark__sql__streaming__unsupportedOperationCheck="false"):
            stream = spark.readStream.schema(schema).parquet(f"{folder}/feed/*")
            query = board.changes(stream, horizon).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        horizon = max(days[k] - lateness, horizon if horizon is not None else days[k] - lateness)
    if not days:
        return spark.createDataFrame([], CHANGES)
    return spark.read.schema(CHANGES).parquet(f"{folder}/changes")

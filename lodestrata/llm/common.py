"""Pieces that several operators share: scratch tables, word rules, global prefix sums."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import settle

#: White space of the contracts: space and the ASCII controls from tab to carriage return.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Python's str.split() also splits at other characters, so bytes are split: bytes.split() knows exactly SPACE.
NULL_ID = 2**63 - 1
#: Words of 64 row numbers that may be sent to all tasks.
MOST_WORDS = 1 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (tests, one machine)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/lodestrata-scratch"
    return root.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs no recomputation.

    The table is removed when the driver's JVM ends, or by ``removed``.
    """
    spark = settled(df).sparkSession
    path = f"{scratch_root(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    where, store = _place(spark, path)
    store.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def removed(table: DataFrame) -> None:
    """Removes the folder of a ``stored`` table that nothing reads any more; no other folder."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/lodestrata/" in path and "/".join(path.split("/")[:-1]).endswith("/lodestrata"):
            where, store = _place(spark, path)
            store.delete(where, True)


def settled(df: DataFrame) -> DataFrame:
    """df, after settings of its session: unions don't claim their inputs' partitioning (see functions.session), and Arrow batches
    hold few rows and bytes, so that long texts don't meet in one batch; a query's shuffle files go when it has ended, as what
    later steps need is in stored tables."""
    spark = settle(df.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return df


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, and what they keep adds to the executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """each, which gives its memory back when a task's batches have ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        release()

    return run


def among(rows: DataFrame, some: DataFrame, id_col: str = "_rid") -> DataFrame:
    """The rows whose number is in ``some``, in their place: their texts are not shuffled. Numbers from ``monotonically_increasing_id`` stand
    together, so 64 of them travel as a word of bits to all tasks; above MOST_WORDS words (about 50 MB) both sides are dealt by number instead."""
    of = F.shiftright(id_col, 6)
    words = stored(some.groupBy(of.alias("_w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{id_col}` & 63L as int))")).alias("_bits")), "words")
    if words.count() > MOST_WORDS:
        return rows.join(some.select(id_col), id_col, "left_semi").select(rows.columns)
    at = F.col(id_col).bitwiseAND(F.lit(63)).cast("int")
    return rows.join(F.broadcast(words), of == F.col("_w")).where(F.getbit("_bits", at) == 1).drop("_w", "_bits")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; strings without other letters take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(text: str | None) -> list[bytes]:
    """The words of the contracts, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def running(batches: Iterator[pa.RecordBatch], value: str, group: str | None) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and, in the partition so far, the group's sum of value before the row and the row's index.

    Rows of a group stand together. State is one group's two totals.
    """
    pid, last, total, count = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        v = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
        g = batch.column(group).to_numpy(zero_copy_only=False) if group else np.zeros(n, np.int64)
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        run = np.repeat(first, np.diff(np.r_[first, n]))
        sums = np.cumsum(v)
        before, index = sums - v - (sums - v)[run], np.arange(n) - run
        if last is not None and g[0] == last:
            head = run == 0
            before[head] += total
            index[head] += count
        last, total, count = g[-1], int(before[-1] + v[-1]), int(index[-1] + 1)
        add = {"_pid": pa.array(np.full(n, pid, np.int32)), "_before": pa.array(before), "_index": pa.array(index)}
        yield pa.RecordBatch.from_arrays([*batch.columns, *add.values()], names=[*batch.schema.names, *add])


def prefix_sums(df: DataFrame, order: list[str], value: str, group: str | None = None) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """A stored table of df's rows with the global ``_before`` and ``_index`` of each, by group if one is given, in the stated order.

    Rows are range-partitioned by (group, order), so a hot group spreads over many tasks; each partition makes its own
    running sums; rows with equal keys (copies without ids, say) are parted by their place in the input. Only one total for each partition and group it holds goes to the driver (partitions + groups rows).
    group must be an integer without nulls and not have more values than the driver can list. Returns the totals
    (sum, rows) of each group, too; without a group that of 0.
    """
    spark = df.sparkSession
    keys = [group, *order] if group else order
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "_pid int, _before long, _index long"])
    local = df.withColumn("_spread", F.monotonically_increasing_id())  # rows that are equal in the order can still be parted
    local = local.repartitionByRange(tasks(spark), *keys, "_spread").sortWithinPartitions(*keys, "_spread").drop("_spread").mapInArrow(trimmed(lambda it: running(it, value, group)), schema)
    local = stored(local, "prefix")
    g = F.col(group) if group else F.lit(0)
    parts = local.groupBy("_pid", g.alias("_g")).agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("n")).collect()
    totals: dict[int, tuple[int, int]] = {}
    offsets = []
    for r in sorted(parts, key=lambda r: (r._g, r._pid)):
        v, n = totals.get(r._g, (0, 0))
        offsets.append((r._pid, r._g, v, n))
        totals[r._g] = (v + r.v, n + r.n)
    off = spark.createDataFrame(offsets or [(0, 0, 0, 0)], f"_pid int, _g {dict(local.dtypes)[group] if group else 'int'}, _ov long, _on long")
    out = local.withColumn("_g", g).join(F.broadcast(off), ["_pid", "_g"])
    out = out.withColumns({"_before": F.col("_before") + F.col("_ov"), "_index": F.col("_index") + F.col("_on")})
    return out.drop("_pid", "_g", "_ov", "_on"), totals

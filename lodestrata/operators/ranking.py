"""Ranks within groups, the shapes that most operators end in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import stored


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) in its group; ``order`` should be total, or ties are arbitrary."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int | Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group; with a number k partial limits run before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))


def within_cap(df: DataFrame, by: list[str], key: str, cap: int, limit: int, rank: str = "rank") -> DataFrame:
    """Up to limit rows of each group: first those among the first cap of their key, then the rest, each in rank order."""
    df = ranked(df, [*by, key], [F.col(rank)], "_nth")
    return top(df, by, [F.col("_nth") > cap, F.col(rank)], limit, rank).drop("_nth")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) in the whole table, without a window over all of it: rows are ranged and sorted, places in a
    partition come from the sorted order, and only the partitions' counts go to the driver."""
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ranged")
    counts, before, offsets = sorted((r.p, r.n) for r in placed.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()), 0, []
    for p, n in counts:
        offsets.append((p, before - (p << 33) + 1))
        before += n
    off = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p long, _o long")
    return placed.join(F.broadcast(off), F.shiftright("_m", 33) == F.col("_p")).withColumn(name, F.col("_m") + F.col("_o")).drop("_m", "_p", "_o")

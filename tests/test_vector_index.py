"""The vector index against the scan: equal when all cells are read, recall with few, pruned partitions, changes."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import retrieval as R
from lodestrata.operators import vector_index as V
from lodestrata.sources.commits import Conflict

SCHEMA = "vec_id long, v array<double>, label int"


def rows(n=2000, width=24, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (groups, width))
    return [(i, (centres[i % groups] + rng.normal(0, 0.25, width)).tolist(), i % 5) for i in range(n)]


@pytest.fixture(scope="module")
def vectors(spark):
    odd = [(5000, None, 1), (5001, [0.0] * 24, 1), (5002, [1.0] * 3, 2), (5003, [1.0, None] * 12, 3), (5004, rows()[7][1], 1), (5005, rows()[7][1], None)]
    return spark.createDataFrame(spark.createDataFrame(rows() + odd, SCHEMA).collect(), SCHEMA)


def questions(vectors):
    return vectors.where("vec_id % 50 = 7 or vec_id >= 5000").select(F.col("vec_id").alias("qid"), "v")


def plain(df):
    return sorted(map(tuple, df.select("qid", "vec_id", "vector_score", "dense_rank").collect()))


def test_all_cells_are_the_scan_and_few_find_most(spark, vectors):
    index = V.VectorIndex.build(vectors, "vec_id", cells=32)
    assert index.cells == 32 and index.rows().count() == vectors.count()
    q = questions(vectors)
    whole = plain(R.dense(q, vectors, 10, -2.0, "vec_id"))
    assert plain(index.search(q, 10, index.cells)) == whole
    assert 1 <= index.probes < 16  # clustered vectors need few cells
    real = {r[:2] for r in whole if r[0] < 5000}
    found = {r[:2] for r in plain(index.search(q, 10)) if r[0] < 5000}
    assert len(real & found) >= 0.9 * len(real)
    few = lambda i: i.search(q, 10, i.cells, floor=0.05, where=F.col("label").isin(1, 2))
    assert plain(few(index)) == plain(R.dense(q, vectors.where(F.col("label").isin(1, 2)), 10, 0.05, "vec_id"))
    again = V.VectorIndex.load(spark, index.path)
    assert plain(again.search(q, 5, 3)) == plain(index.search(q, 5, 3)) and again.probes == index.probes


def test_only_asked_cells_are_read(spark, vectors):
    index = V.VectorIndex.build(vectors, "vec_id", cells=32)
    one = index.search(vectors.where("vec_id = 7").select(F.col("vec_id").alias("qid"), "v"), 10, 2, where=F.col("label") == 1)
    plan = one._jdf.queryExecution().toString()
    asked = re.search(r"PartitionFilters: \[cell#\d+ IN \(([\d,]+)\)\]", plan)
    assert len(asked[1].split(",")) == 2 and "EqualTo(label,1)" in plan


def test_changes_touch_only_their_rows(spark, vectors):
    index = V.VectorIndex.build(vectors, "vec_id", cells=16)
    files = set(index.rows().inputFiles())
    now = {r.vec_id: tuple(r) for r in vectors.collect()}
    fresh = [(3, rows()[900][1], 2), (9000, rows()[8][1], 3)]
    changed = index.changed(spark.createDataFrame(fresh, SCHEMA), spark.createDataFrame([(7,), (12345,)], "vec_id long"))
    changed = changed.changed(spark.createDataFrame([(9000, rows()[9][1], 4)], SCHEMA))
    changed = changed.changed(removed=spark.createDataFrame([(11,)], "vec_id long"))
    now |= {3: fresh[0], 9000: (9000, rows()[9][1], 4)}
    for k in (7, 11):
        del now[k]
    table = spark.createDataFrame(list(now.values()), SCHEMA)
    q = questions(vectors)
    assert plain(changed.search(q, 10, 16)) == plain(R.dense(q, table, 10, -2.0, "vec_id"))
    assert files <= set(changed.rows().inputFiles())
    assert plain(V.VectorIndex.load(spark, index.path, 0).search(q, 10, 16)) == plain(R.dense(q, vectors, 10, -2.0, "vec_id"))
    with pytest.raises(Conflict):
        index.changed(removed=spark.createDataFrame([(1,)], "vec_id long"))


def test_no_rows(spark):
    index = V.VectorIndex.build(spark.createDataFrame([], SCHEMA), "vec_id")
    assert index.search(spark.createDataFrame([(1, [1.0])], "qid long, v array<double>")).count() == 0
    assert index.search(spark.createDataFrame([], "qid long, v array<double>")).count() == 0

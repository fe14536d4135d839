"""A chain of providers: failures and delays change the provider, not the rows; reruns call nothing twice."""

import time

import pandas as pd
from pyspark.sql import functions as F

from lodestrata.operators.providers import Provider, chained_scores
from lodestrata.sources.commits import Table


def lengths(q, t):
    return t.fillna("").str.len() + q.fillna("").str.len()


def test_chain(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def first(q, t):
        calls.add(len(q))
        if t.fillna("").str.contains("bad").any():
            raise ValueError("no")
        if t.fillna("").str.contains("slow").any():
            time.sleep(30)
        return lengths(q, t)

    def second(q, t):
        calls.add(len(q))
        return pd.Series([], dtype=float) if t.fillna("").str.contains("both").any() else lengths(q, t) + 1000

    texts = ["a", "bb", "bad one", "slow one", "bad both", None, "a", ""]
    pairs = spark.createDataFrame([(i, "q", t) for i, t in enumerate(texts)], "id long, question string, text string")
    chain = [Provider("first", first, 2.0), Provider("second", second)]
    cache = Table(spark, str(tmp_path / "scores"), "key")
    out = chained_scores(pairs, chain, cache, rows=1)
    got = {r.id: (r.score, r.provider) for r in out.collect()}
    assert got == {0: (2.0, "first"), 1: (3.0, "first"), 2: (1008.0, "second"), 3: (1009.0, "second"), 4: (None, None), 5: (1.0, "first"), 6: (2.0, "first"), 7: (1.0, "first")}
    assert calls.value == 10  # seven different pairs, three of them twice
    again = chained_scores(pairs.unionByName(spark.createDataFrame([(9, "q", "new")], pairs.schema)), chain, cache, rows=1)
    assert {r.id: (r.score, r.provider) for r in again.collect()} == got | {9: (4.0, "first")}
    assert calls.value == 13  # the pair that no one could score, by both, and the new one
    assert cache.read().count() == 7 and cache.snapshot().version == 1
    assert chained_scores(pairs.where("false"), chain).count() == 0
    assert chained_scores(pairs, chain[1:], rows=100).where(F.col("provider").isNull()).count() == 8

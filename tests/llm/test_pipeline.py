"""The pipeline against plain versions of its stages, and the contracts' queries on the smallest tables."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestrata.llm import decontam, langid, oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")

from .test_operators import plain_components, plain_print  # noqa: E402


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    known = P.language(spark, docs, SF)
    assert known.columns == P.COLUMNS
    model = queries.language_model(docs)
    judged = dict(zip(rows, zip(*langid.judge([r.text for r in rows.values()], model, {}), strict=True), strict=True))
    assert {r.doc_id for r in known.collect()} == {d for d, (lang, s) in judged.items() if lang != "und" and s >= 0.5}
    kept = P.near_dedup(spark, docs, SF)
    ids = sorted(rows)
    assert {r.doc_id for r in kept.collect()} == {ids[i] for i in set(plain_components([plain_print(rows[d].text) for d in ids]))}
    clean = P.decontaminate(spark, docs, SF)
    items = [" ".join(decontam.words_in(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d in rows if any(f" {i} " in f" {' '.join(decontam.words_in(rows[d].text))} " for i in items)}
    assert {r.doc_id for r in clean.collect()} == set(rows) - hit
    mixed = P.mix(spark, docs, SF)
    assert mixed.columns == P.COLUMNS and {r.doc_id for r in mixed.collect()} <= set(rows)
    last = P.run(spark, SF).collect()
    assert {r.shard for r in last} <= set(range(40)) and not {r.doc_id for r in last} & hit


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_types(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0
    want = {"op1_sharding": {"slot": "bigint", "shard": "int", "law": "string", "grown_shard": "int"}, "op2_mixing": {"target": "double", "taken": "bigint"}, "op3_lm_scoring": {"base_score": "double", "n_known": "bigint"}, "op10_ann": {"rank": "int", "score": "double"}}
    assert want.get(name, {}).items() <= dict(df.dtypes).items()
    assert set(oracles.ORACLES) <= set(queries.QUERIES)


def test_folds(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", queries.fold(7).alias("f"))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 7 for r in df.collect())
    assert spark.range(1).select(F.lit(None).cast("long").alias("doc_id")).select(queries.fold(3).alias("f")).first().f is None

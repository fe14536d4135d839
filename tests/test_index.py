"""The stored index against the scan of the texts: exact equality, pruning, additions, changes, deletions, compaction."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.lexicon import Settings
from lodestrata.operators import index as I
from lodestrata.operators import retrieval as R
from lodestrata.plans import engine
from lodestrata.sources.commits import Conflict


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    return [(f"k{i:05d}", " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string")


def asked(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(["w3 w150", "w0 w1 w2 w0", "w199", "none such", "", None, "w120 w121 w122 w5"])], "qid long, question string")


def plain(df):
    return sorted(map(tuple, df.select("qid", "chunk_id", "bm25_score", "bm25_rank").collect()))


@pytest.fixture(scope="module")
def rows(spark):
    out = frame(spark, [*corpus(3000), ("tie1", "w199 w7"), ("tie0", "w199 w7"), ("empty", ""), ("none", None)])
    return spark.createDataFrame(out.collect(), out.schema)


@pytest.mark.parametrize("few", [64, 0])
def test_search_is_that_of_the_scan(spark, rows, monkeypatch, few):
    monkeypatch.setattr(I, "FEW", few)
    monkeypatch.setattr(I, "RANGE", 6)
    index = I.Index.build(rows, F.col("text"))
    for limit in (1, 10, 5000):
        assert plain(index.search(asked(spark), limit)) == plain(R.bm25(asked(spark), rows, limit, F.col("text")))
    only = rows.where("chunk_id > 'k02'").select("chunk_id")
    assert plain(index.search(asked(spark), 10, only=only)) == plain(R.bm25(asked(spark), rows, 10, F.col("text"), only=only))


def test_ranges_are_ruled_out(spark, monkeypatch):
    """A rare term and a frequent one: ranges without the rare term can't reach the first ranges' scores and are never opened."""
    monkeypatch.setattr(I, "FEW", 0)
    monkeypatch.setattr(I, "RANGE", 6)
    seen = []
    plain_stored = I.stored
    monkeypatch.setattr(I, "stored", lambda df, name: seen.append((name, out := plain_stored(df, name))) or out)
    texts = frame(spark, [(f"k{i:05d}", "rare common" if i < 12 else "common word") for i in range(4000)])
    index = I.Index.build(texts.repartition(1), F.col("text"))
    seen.clear()
    found = index.search(spark.createDataFrame([(1, "rare common")], "qid long, question string"), 10)
    assert found.count() == 10
    by = {}
    for name, df in seen:
        by.setdefault(name, []).append(df)
    assert by["bounds"][0].count() == 63 and [x.select("range").distinct().count() for x in by["asked"]] == [4, 0]


def test_changes_equal_a_full_build(spark, monkeypatch):
    monkeypatch.setattr(I, "FEW", 0)
    monkeypatch.setattr(I, "RANGE", 6)
    monkeypatch.setattr(I, "BUCKET_TOKENS", 5000)
    now = dict(corpus(1200))
    index = I.Index.build(frame(spark, list(now.items())), F.col("text"))
    assert index.buckets > 1
    first = index
    changed = {k: t for k, t in corpus(1500, 2) if int(k[1:]) % 3 == 0}
    index = index.changed(frame(spark, list(changed.items())), F.col("text"))
    now |= changed
    gone = [k for k in now if int(k[1:]) % 7 == 1]
    index = index.changed(None, removed=spark.createDataFrame([(k,) for k in [*gone, "never there"]], "chunk_id string"))
    now = {k: t for k, t in now.items() if k not in gone}
    back = {gone[0]: "w1 w2 w199 w199", "other": "w199"}
    index = index.changed(frame(spark, list(back.items())), F.col("text"))
    now |= back
    full = I.Index.build(frame(spark, list(now.items())), F.col("text"))
    small = index.compacted()
    for x in (index, small, I.Index.load(spark, small.path)):
        assert x.statistics() == full.statistics() and x.n_rows == len(now)
        for f in (lambda i: i.document_frequency(), lambda i: i.postings()):
            assert sorted(map(tuple, f(x).collect())) == sorted(map(tuple, f(full).collect()))
        assert plain(x.search(asked(spark), 20)) == plain(full.search(asked(spark), 20))
    assert len(small.segments) == 1 and len(index.segments) == 4
    assert I.Index.load(spark, index.path, 0).statistics() == first.statistics()  # old versions stay
    with pytest.raises(Conflict):
        index.changed(frame(spark, [("x", "w1")]), F.col("text"))  # compaction came first


def test_no_text_is_read_before_fusion(spark, tmp_path):
    docs = spark.createDataFrame([(i, "s.pdf", "\n".join(f"line {j} about enzyme w{(i * j) % 50} and yield of strain {i} in medium with lactose" for j in range(9))) for i in range(40)], "doc_id long, source string, text string")
    engine.Library.build(docs, 2).save(str(tmp_path), "1")
    library = engine.Library.load(spark, str(tmp_path), "1")
    unread = F.udf(lambda t: 1 / 0, "string")  # fails where a text is looked at
    blind = engine.Library(library.chunks.withColumn("text", unread("text")), library.index, library.vectors)
    q = spark.createDataFrame([(1, "What yield has enzyme w7?"), (2, "Compare enzyme w7 and strain 12")], "qid long, question string")
    s = Settings()
    ids = R.hybrid_ids(R.routed(q, s.lexicon, s), blind.chunks, s, blind.index, blind.vectors)
    assert ids.count() > 50 and not any("/chunks" in f for f in ids.inputFiles())
    assert engine.search(q, library, s).where("qid = 1").count() == s.search_limit


def test_answered_questions_reach_no_later_filter(spark):
    q = spark.createDataFrame([(i,) for i in range(5)], "qid long")
    asked_for = []

    def attempt(least):
        def run(some):
            asked_for.append(sorted(r.qid for r in some.collect()))
            return some.where(F.col("qid") >= least)

        return run

    out = R.first_answering(q, [attempt(3), attempt(9), attempt(1), attempt(0), attempt(0)])
    assert sorted((r.qid, r.attempt) for r in out.collect()) == [(0, 3), (1, 2), (2, 2), (3, 0), (4, 0)]
    assert asked_for == [[0, 1, 2, 3, 4], [0, 1, 2], [0, 1, 2], [0]]


def test_a_search_asks_once_for_each_range(spark, monkeypatch):
    """what is dealt for a search has one row for each range, whatever questions ask of it, and a range in many batches is found whole."""
    monkeypatch.setattr(I, "FEW", 0)
    monkeypatch.setattr(I, "RANGE", 8)
    seen, plain_stored = [], I.stored
    monkeypatch.setattr(I, "stored", lambda df, name: seen.append((name, out := plain_stored(df, name))) or out)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        texts = frame(spark, corpus(1500)).repartition(1)
        index = I.Index.build(texts, F.col("text"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = plain(index.search(asked(spark), 10))
    assert found == plain(R.bm25(asked(spark), texts, 10, F.col("text")))
    sizes = [(df.count(), df.select("range").distinct().count()) for name, df in seen if name == "asked"]
    assert sizes and all(n == ranges for n, ranges in sizes)


def test_blocks_of_a_range_are_packed(spark, monkeypatch):
    """F20 and the shared step: a range has one row for each bucket, however many terms there are, and buckets are those of the search."""
    monkeypatch.setattr(I, "RANGE", 6)
    monkeypatch.setattr(I, "BUCKET_TOKENS", 100)
    texts = frame(spark, [(f"k{i:03d}", f"only{i} é中 common") for i in range(128)]).repartition(1)
    index = I.Index.build(texts, F.col("text"))
    packed = spark.read.parquet(f"{index.path}/{index.segments[0].name}/blocks")
    assert index.buckets == 4 and packed.groupBy("bucket", "range").count().where("count > 1").isEmpty() and packed.count() <= 8
    terms = packed.select("bucket", F.explode("terms").alias("term"))
    assert terms.where(F.col("bucket") != index.bucket("term")).isEmpty() and terms.distinct().count() == 130


def test_a_branch_copies_nothing(spark):
    """a branch reads its origin's files, and neither sees what the other changes."""
    index = I.Index.build(frame(spark, [("a", "w1 w2"), ("b", "w2 w3")]), F.col("text"))
    q = spark.createDataFrame([(1, "w2 w9")], "qid long, question string")
    branch = index.branched()
    assert all(s.name.startswith(index.path) for s in branch.segments)
    changed = branch.changed(frame(spark, [("b", "w9"), ("c", "w9 w2")]), F.col("text"))
    own = index.changed(None, removed=spark.createDataFrame([("a",)], "chunk_id string"))  # no conflict: each has its log
    assert {r[1] for r in plain(changed.search(q))} == {"a", "b", "c"} and {r[1] for r in plain(own.search(q))} == {"b"}
    assert plain(I.Index.load(spark, changed.path).search(q)) == plain(changed.search(q))


def test_postings_travel_as_bytes(spark, monkeypatch):
    """F16, F17, F18: tokens and postings pass between the JVM and Python as whole strings and bytes; rows without tokens make no block, and a token that would part others is refused."""
    monkeypatch.setattr(I, "FEW", 0)
    monkeypatch.setattr(I, "RANGE", 6)
    seen, plain_stored = {}, I.stored
    monkeypatch.setattr(I, "stored", lambda df, name: seen.update({name: (out := plain_stored(df, name))}) or out)
    texts = frame(spark, [("a", "é中 w1 w1"), ("b", ""), ("c", None), *((f"k{i:04d}", "w1 " * (i % 5)) for i in range(300))])
    index = I.Index.build(texts, F.col("text"))
    assert dict(seen["tokens"].dtypes)["t"] == "string"
    assert [t for c, t in I.Index.load(spark, index.path)._table("blocks").dtypes if c in I.FLAT] == ["binary"] * 3
    assert plain(index.search(asked(spark), 10)) == plain(R.bm25(asked(spark), texts, 10, F.col("text")))
    assert [t for c, t in seen["held"].dtypes if c in I.FLAT] == ["binary"] * 3
    got = {(r.key, r.term): (r.tf, r.dl) for r in index.postings().where("key != 'a'").collect()}
    assert got == {(f"k{i:04d}", "w1"): (i % 5, i % 5) for i in range(300) if i % 5} and index.postings().where("key = 'a' and term = 'w1'").first().tf == 2
    with pytest.raises(Exception, match="U\\+0000"):
        I.Index.build(frame(spark, [("a", "x")]), F.col("text"), tokenize=lambda c: F.array(F.lit("one\0two")))

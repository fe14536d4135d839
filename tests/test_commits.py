"""Tables that change by commits: untouched files, two writers, old versions, crashes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import sinks
from lodestrata.sources.commits import Conflict, Log, Table, audit_sink

SCHEMA = "chunk_id string, doc_id long, page_start long, text string"


def rows(spark, some):
    return spark.createDataFrame([(f"c{i:04d}", i // 10, i, t) for i, t in some], SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.create(rows(spark, [(i, f"text {i}") for i in range(400)]), 8)
    return t


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_rewrites_only_touched_files(spark, table):
    before = table.snapshot()
    fresh = rows(spark, [(3, "new"), (3, "newer"), (401, "added"), (5, None)])
    want = plain(sinks.upserted(table.read(), fresh))
    assert table.upsert(fresh) == 1
    after = table.snapshot()
    kept = set(before.files) & set(after.files)
    assert len(before.files) == 8 and len(kept) == 7  # one file holds c0003 and c0005; c0401 is new
    stat = {f: os.stat(f"{table.path}/data/{f}") for f in kept}
    assert plain(table.read()) == want and len(want) == 401
    table.delete(rows(spark, [(3, ""), (9999, "")]).select("chunk_id"))
    assert all(os.stat(f"{table.path}/data/{f}").st_mtime == s.st_mtime for f, s in stat.items())
    assert len(plain(table.read())) == 400 and plain(table.read(1)) == want and len(plain(table.read(0))) == 400
    assert [tuple(r)[:3] for r in table.history().orderBy("version").collect()] == [(0, 8, 0), (1, 1, 1), (2, 1, 1)]
    assert table.vacuum() == 2 and len(plain(table.read())) == 400
    with pytest.raises(ValueError, match="no version"):
        table.read(7)


def test_rebuild_replaces_documents_in_one_version(spark, table):
    fresh = rows(spark, [(10, "again"), (11, "again"), (600, "other document")])
    ids = spark.createDataFrame([(1,), (7,), (88,)], "doc_id long")
    want = plain(sinks.rebuilt(table.read(), fresh, ids)[0].select(fresh.columns))
    assert table.rebuild(fresh, ids) == 1
    assert plain(table.read()) == want and len(want) == 382


def test_two_writers(spark, table):
    base = table.snapshot()
    assert table.upsert(rows(spark, [(3, "first")]), base) == 1
    assert table.upsert(rows(spark, [(390, "second")]), base) == 2  # other files: goes after the first
    with pytest.raises(Conflict):
        table.upsert(rows(spark, [(4, "same file as the first")]), base)
    assert table.upsert(rows(spark, [(7001, "new here")]), base) == 3
    with pytest.raises(Conflict):
        table.upsert(rows(spark, [(7001, "the same new key")]), base)
    got = {r.chunk_id: r.text for r in table.read().collect()}
    assert (got["c0003"], got["c0390"], got["c7001"], len(got)) == ("first", "second", "new here", 401)


def test_a_writer_that_dies_changes_nothing(spark, table, monkeypatch):
    monkeypatch.setattr(Log, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        table.upsert(rows(spark, [(3, "lost")]))
    monkeypatch.undo()
    assert table.snapshot().version == 0 and "lost" not in {r.text for r in table.read().collect()}


def test_many_versions_replay_from_a_full_list(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    for i in range(23):
        t.append(rows(spark, [(i, "x")]), "w", i)
    assert t.snapshot().version == 22 and t.read().count() == 23 and "all" in t.log.read(20) and t.snapshot().batches == {"w": 22}
    assert t.read(5).count() == 6
    empty = Table(spark, str(tmp_path / "none"))
    assert empty.snapshot().version == -1
    with pytest.raises(ValueError, match="no table"):
        empty.read()


def test_replayed_batches_add_nothing(spark, tmp_path):
    """A stream whose checkpoint is lost after a commit replays the batch; the table has its number already."""
    source, t = tmp_path / "in", Table(spark, str(tmp_path / "t"), key="event_type")
    source.mkdir()

    def run(checkpoint):
        events = spark.readStream.schema("event_type string, payload string").json(str(source))
        q = events.writeStream.foreachBatch(audit_sink(t, "audit")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()

    for i in range(2):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"event_type": f"e{i}", "payload": str(k)}) for k in range(50)))
        run("one")
    assert t.read().count() == 100 and t.snapshot().version == 1
    sorted((tmp_path / "one" / "commits").glob("1*"))[0].unlink()  # as if the driver had died between the table's commit and its own
    for x in (tmp_path / "one" / "commits").glob(".1*"):
        x.unlink()
    run("one")
    assert t.read().count() == 100 and t.snapshot().version == 1
    assert t.read().where(F.col("payload") == "7").count() == 2

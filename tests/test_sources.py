import json

from pyspark.sql import functions as F

from lodestrata.sources import readers, sinks
from lodestrata.streaming import audit


def test_readers(spark, tmp_path):
    (tmp_path / "j").mkdir()
    doc = {"doc_id": "d1", "source_file": "d1.pdf", "total_pages": 1, "pages": [{"page": 1, "text": "one", "blocks": [{"block_id": "b", "type": "paragraph", "text": "x", "section_path": ["A"], "page": 1}]}, {"page": 2, "text": "two"}]}
    (tmp_path / "j/d1.json").write_text(json.dumps(doc))
    (tmp_path / "t").mkdir()
    (tmp_path / "t/d1.txt").write_text("old")
    (tmp_path / "t/d2.txt").write_text("new")
    parsed = readers.parsed_json(spark, str(tmp_path / "j"))
    assert parsed.first().raw_text == "one\ntwo" and parsed.first().has_blocks and readers.block_rows(parsed).first().kind == "paragraph"
    texts = readers.text_files(spark, str(tmp_path / "t"))
    assert {r.doc_id: r.raw_text for r in readers.preferred(parsed, texts).collect()} == {"d1": "one\ntwo", "d2": "new"}

    def pages(content):
        if content == b"old":
            raise ValueError("unreadable")
        return [(1, content.decode())]

    got = {r.doc_id: (r.page, r.text, r.error) for r in readers.binary_pages(spark, str(tmp_path / "t"), pages).collect()}
    assert got == {"d1": (None, None, "ValueError: unreadable"), "d2": (1, "new", None)}


def test_json_lines(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"chunk_id": "a", "doc_id": "d", "chunk_index": "3", "text": "t"}\n\n# note\nnot json\n{"chunk_id": "b", "doc_id": "d", "chunk_index": "x"}\n{"doc_id": "d"}\n')
    rows, bad = readers.lines_of(spark, str(p), readers.CHUNK)
    assert rows.count() == 3 and [r.line for r in bad.collect()] == ["not json"]
    chunks = {r.chunk_id: r for r in readers.chunk_lines(spark, str(p)).collect()}
    assert set(chunks) == {"a", "b"} and chunks["a"].chunk_index == 3 and chunks["b"].text == ""
    assert readers.chunks_or_else(spark, str(tmp_path / "none"), rows).count() == 3
    for name, body in (("a.json", [{"id": "1"}]), ("b.json", {"items": [{"id": "1"}]}), ("c.json", {"data": [{"id": "1"}]})):
        (tmp_path / name).write_text(json.dumps(body))
        assert [r.id for r in readers.samples(spark, str(tmp_path / name)).collect()] == ["1"]
    (tmp_path / "m.csv").write_text("﻿doc_id,old_name,new_name\nd,o,n\n")
    assert readers.name_map(spark, str(tmp_path / "m.csv")).first().doc_id == "d"
    (tmp_path / "s.json").write_text(json.dumps({"s": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]}))
    assert [(r.turn_no, r.content) for r in readers.turns(spark, str(tmp_path / "s.json")).orderBy("turn_no").collect()] == [(0, "hi"), (1, "ho")]


def test_table_changes(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 2), ("b", 2, 3)], "chunk_id string, doc_id long, page_start long")
    new = spark.createDataFrame([("b", 2, None), ("c", 3, 4)], "chunk_id string, doc_id long, page_start long")
    assert {(r.chunk_id, r.page_start) for r in sinks.upserted(old, new).collect()} == {("a", 2), ("b", -1), ("c", 4)}
    ids = spark.createDataFrame([(2,), (9,)], "doc_id long")
    assert [r.chunk_id for r in sinks.without(old, ids).collect()] == ["a"]
    table, change = sinks.rebuilt(old, new, ids)
    assert {r.chunk_id for r in table.collect()} == {"a", "b"} and {(r.doc_id, r.old, r.new) for r in change.collect()} == {(2, 1, 1), (9, 0, 0)}
    blocks = spark.createDataFrame([("d", 1, 0, "heading", "H"), ("d", 1, 1, "paragraph", "p"), ("d", 2, 2, "noise", "1")], "doc_id string, page long, ord long, kind string, text string")
    assert sinks.preview(blocks).first().markdown == "## H\n\np"
    sinks.write_parsed(blocks, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().total_pages == 2
    plan = {r.old_name: r for r in sinks.rename_plan(spark.createDataFrame([("b.pdf",), ("a.pdf",), ("a2.pdf",)], "old_name string")).collect()}
    assert [plan[k].new_name for k in ("a.pdf", "a2.pdf", "b.pdf")] == ["doc_0001.pdf", "doc_0002.pdf", "doc_0003.pdf"]
    event = sinks.audit_events(old, "seen", ["chunk_id"]).first()
    assert event.event_type == "seen" and json.loads(event.payload)["chunk_id"] in "ab"


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 {h:02d}:00:00", u, "view", 1.0, "{}") for i, (h, u) in enumerate([(0, 1), (1, 1), (2, 1), (12, 1), (0, 2), (23, 3)])]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    q = audit.append(audit.hourly(audit.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.sum("n")).first()[0] == 5  # the last hour isn't final yet
    batch = audit.sessions(spark.read.parquet(str(tmp_path / "in")))
    assert sorted((r.user_id, r.n) for r in batch.collect()) == [(1, 1), (1, 3), (2, 1), (3, 1)]

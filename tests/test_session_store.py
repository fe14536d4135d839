"""Sessions kept as state: restarts, repeated and late turns, idle sessions."""

import random
import time

from lodestrata.sources.commits import Table
from lodestrata.streaming import session_store as S

SCHEMA = "session_id string, turn_no long, role string, content string"


def feed(spark, tmp_path, rows, name, times=1):
    for k in range(times):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def run(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    table = Table(spark, str(tmp_path / "sessions"), "session_id")
    S.keep_sessions(stream, table, str(tmp_path / "checkpoint")).awaitTermination(120)
    return table


def test_restarts_and_repeats_give_the_last_turns(spark, tmp_path):
    rng = random.Random(4)
    turns = [(f"s{i}", n, rng.choice(["user", "assistant"]), f"text {i} {n}") for i in range(12) for n in range(rng.randint(1, 30))]
    rng.shuffle(turns)
    thirds = [turns[k::3] for k in range(3)]
    for k, part in enumerate(thirds):
        feed(spark, tmp_path, [*part, *(thirds[0][:20] if k else [])], k)  # some come again after a restart
        table = run(spark, tmp_path)
    want = sorted(map(tuple, S.plain_last_turns(spark.createDataFrame(turns, SCHEMA)).collect()))
    assert sorted(map(tuple, S.turns_of(table.read()).collect())) == want
    feed(spark, tmp_path, turns[:50], 9)
    table = run(spark, tmp_path)
    assert sorted(map(tuple, S.turns_of(table.read()).collect())) == want
    one = S.session_turns(spark, table.path, "s3").collect()
    assert [r.turn_no for r in one] == [t[1] for t in want if t[0] == "s3"] and len(one) <= 12


def test_idle_sessions_are_forgotten(spark, tmp_path):
    feed(spark, tmp_path, [("a", 0, "user", "x"), ("b", 0, "user", "y")], 0)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    table = Table(spark, str(tmp_path / "sessions"), "session_id")
    query = S.keep_sessions(stream, table, str(tmp_path / "checkpoint"), idle_ms=4000)
    seen, until = set(), time.time() + 90
    try:
        while time.time() < until and not (seen and not {r.session_id for r in table.read().collect()}):
            assert query.exception() is None
            if table.snapshot().version >= 0:
                seen |= {r.session_id for r in table.read().collect()}
            time.sleep(1)
    finally:
        query.stop()
    assert seen == {"a", "b"} and table.read().count() == 0

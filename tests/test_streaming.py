"""Streaming jobs over several micro-batches give what a batch job gives."""

from __future__ import annotations

import datetime

from sourceloom.sources import corpus
from sourceloom.streaming import incremental, staleness


def test_newest_version_wins_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "file_id long, repo string, path string, content string"
    none = corpus.load_patterns(spark.createDataFrame([], "line_no int, line string"))

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.start(stream, none, str(tmp_path / "kb"), str(tmp_path / "state")).awaitTermination()

    step([(1, "r", "a.py", "import os\n"), (2, "r", "b.py", "import os\n")])
    step([(3, "r", "a.py", "import sys\nimport os\n"), (4, "r", "c.md", "x")])
    got = {r.path: (r.file_id, len(r.imports)) for r in incremental.newest(spark, str(tmp_path / "kb")).collect()}
    assert got == {"a.py": (3, 2), "b.py": (2, 1)}
    incremental.merge(spark, str(tmp_path / "kb"), str(tmp_path / "kb2"))
    assert incremental.newest(spark, str(tmp_path / "kb2")).count() == 2


def test_staleness_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    t0 = datetime.datetime(2024, 1, 1)
    kinds = ["signup"] + ["purchase"] * 4 + ["click"] + ["purchase"] * 3 + ["signup", "purchase"]
    rows = [(i, t0 + datetime.timedelta(minutes=i), 3, k) for i, k in enumerate(kinds)]
    rows += [(100 + i, t0 + datetime.timedelta(minutes=i), 4, "purchase") for i in range(2)]
    rows.sort(key=lambda r: r[1])
    table, state = str(tmp_path / "t"), str(tmp_path / "s")
    for part in (rows[:6], rows[6:10] + rows[6:7], rows[10:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = staleness.commit_events(spark.readStream.schema(schema).parquet(source))
        staleness.start(stream, table, state).awaitTermination()
    crossed = spark.read.parquet(table).where("crossed").select("repo").distinct().count()
    got = {r.repo: (r.behind, r.stale) for r in staleness.report(spark, table).collect()}
    assert got == {"repo_src3": (1, False), "repo_src4": (2, True)}
    assert crossed == 1


def test_a_replayed_batch_changes_nothing(spark):
    before = spark.createDataFrame([("r", None, 2, False)], staleness.STATE)
    batch = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), "r", "commit")], "event_id long, ts timestamp, repo string, kind string")
    one = staleness.next_state(before, batch).collect()
    assert one == staleness.next_state(before, batch).collect()
    assert one[0].behind == 3


def test_batches_in_any_order_give_one_result(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    t0 = datetime.datetime(2024, 1, 1)
    hours = [("purchase", 10), ("purchase", 11), ("signup", 5), ("purchase", 3), ("signup", 2), ("purchase", 12), ("purchase", 1)]
    rows = [(i, t0 + datetime.timedelta(hours=h), 3, k) for i, (k, h) in enumerate(hours)]
    for turn, order in enumerate(([0, 1, 2, 3, 4, 5, 6], [6, 5, 4, 3, 2, 1, 0], [2, 0, 6, 1, 4, 5, 3])):
        source, table, state = (str(tmp_path / f"{n}{turn}") for n in "its")
        for i in range(0, 7, 2):
            part = [rows[j] for j in order[i : i + 2]] + [rows[order[0]]]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            stream = staleness.commit_events(spark.readStream.schema(schema).parquet(source))
            staleness.start(stream, table, state).awaitTermination()
        assert [(r.repo, r.behind, r.stale) for r in staleness.report(spark, table).collect()] == [("repo_src3", 3, False)]


def test_late_events_are_kept_apart(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in "its")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    t0 = datetime.datetime(2024, 1, 10)
    steps = [[(1, 0, "purchase"), (2, 1, "purchase")], [(3, 100, "purchase")], [(4, 10, "purchase"), (5, 110, "purchase")], [(6, 105, "signup")]]
    for step in steps:
        part = [(i, t0 + datetime.timedelta(hours=h), 3, k) for i, h, k in step]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = staleness.commit_events(spark.readStream.schema(schema).parquet(source))
        staleness.start(stream, table, state).awaitTermination()
    assert [r.event_id for r in staleness.late_events(spark, table).collect()] == [4]
    assert [(r.behind, r.stale) for r in staleness.report(spark, table).collect()] == [(1, False)]
    counts = [r.behind for r in spark.read.parquet(table).orderBy("batch_id").collect()]
    assert counts == [2, 3, 4, 1]


def test_a_batch_of_one_file_is_spread(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "kb", "state"))
    schema = "file_id long, repo string, path string, content string"
    none = corpus.load_patterns(spark.createDataFrame([], "line_no int, line string"))
    rows = [(i, "r", f"f{i}.py", "import os\n") for i in range(200)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    incremental.start(spark.readStream.schema(schema).parquet(source), none, table, state).awaitTermination()
    assert incremental.newest(spark, table).count() == 200
    assert len(list((tmp_path / "kb/batch_id=0").glob("part-*.parquet"))) > 1

"""The index stream, the squash stream and labels."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import labels
from tracewell.sources.versioned import VersionedTable
from tracewell.streaming import capture, squash
from tracewell.streaming.index_stream import Stalled, await_progress, index_batch, index_stream

FILES = "path string, blob_sha string, content string, seq bigint"


def test_index_stream(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/index")
    for k, rows in enumerate(([("a.md", "b1", "one", 1), ("b.md", "b2", "two", 2)], [("a.md", "b3", "three", 3), ("b.md", "x", None, 4)])):
        df = spark.createDataFrame(rows, FILES)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = index_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), t, f"{tmp_path}/cp")
        await_progress(q, 120)
        assert sorted(r.key for r in t.read().collect()) == [["b1:file", "b2:file"], ["b3:file"]][k]
    index_batch(t, spark.createDataFrame([("a.md", "b3", "three", 3)], FILES))
    assert [r.key for r in t.read().collect()] == ["b3:file"]


def test_a_query_that_stands_still_is_stopped(spark, tmp_path):
    q = spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.format("noop").trigger(processingTime="1 hour").option("checkpointLocation", f"{tmp_path}/cp").start()
    with pytest.raises(Stalled):
        await_progress(q, 2, 0.5)
    assert not q.isActive


def test_squash_stream(spark, tmp_path):
    rows = [
        [("r", 1, "message", "A", ["B", "C"], None, None), ("r", 2, "commit", None, None, "A", "s1"), ("r", 3, "commit", None, None, "A", "s2"), ("q", 1, "message", "X", [], None, None)],
        [("q", 2, "commit", None, None, "Y", "s3"), ("q", 3, "commit", None, None, "X", "s4")],
    ]
    for part in rows:
        df = spark.createDataFrame(part, squash.EVENTS)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = squash.folds(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((r.repo, r.sha, r.status, r.absorbed) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("q", "s3", "stale", []), ("r", "s1", "folded", ["B", "C"])]


def test_records_come_once(spark, tmp_path):
    df = spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 00:00:01"), ("y", "2024-01-01 00:00:02")], "session_ref string, t string").select("session_ref", F.col("t").cast("timestamp").alias("captured_at"))
    df.write.parquet(f"{tmp_path}/in")
    q = capture.first_records(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.session_ref for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["x", "y"]


def test_labels(spark):
    b = spark.createDataFrame([("a", False, "2024-02-01", "o/a", 1, 2), ("m", True, "2024-01-01", "", 0, 0), ("z", False, "2024-01-05", "o/z", 0, 0)], "name string, current boolean, date string, upstream string, ahead int, behind int")
    got = [(r.name, r.t) for r in labels.ordered_branches(b).select("name", labels.track_label(F.col("upstream"), F.col("ahead"), F.col("behind")).alias("t")).collect()]
    assert got == [("m", "no upstream"), ("a", "ahead 1, behind 2"), ("z", "up to date")]
    row = spark.sql("""SELECT 'renamed' s, 'b' p, 'a' o, true bin, 3 x, 4 y, '{"file":"f"}' att, '{"text":"\\n one\\ntwo"}' body""")
    r = row.select(labels.file_title(F.col("s"), F.col("p"), F.col("o")).alias("t"), labels.counts_label(~F.col("bin"), F.col("x"), F.col("y")).alias("c"), labels.span_headline(F.col("att"), F.col("body")).alias("h"), labels.span_headline(F.lit("{}"), F.col("body")).alias("g"), labels.line_marker(F.lit("add")).alias("m"), labels.source_tag(F.lit("code"), F.lit(2)).alias("k")).first()
    assert (r.t, r.c, r.h, r.g, r.m, r.k) == ("a → b", "+3 −4", "f", "one", "+", "[2] code")


def test_captured_records_and_entries(spark, tmp_path):
    import json

    from tracewell.operators import ledger

    secret = "ghp_" + "a1" * 18
    lines = "\n".join(json.dumps(x) for x in [{"type": "assistant", "version": "1.2", "message": {"model": "m-1", "content": [{"type": "text", "text": f"use {secret}"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}]}}])
    events = [
        ("s", 1, "plan", None, None, False, f"Use cookies\nnot {secret}", None, None, None, None, None, None, None, None),
        ("s", 2, "maybe-commit", "Bash", "git commit -m x", False, None, "a" * 40, lines, "Add cookies", "b" * 40, "ann@x", "c" * 32, '[{"path":"a.py","blob":"d"}]', "2024-01-01T00:00:00Z"),
        ("t", 1, "maybe-commit", "Bash", "git commit -m y", False, None, "e" * 40, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(events, f"{capture.EVENTS}, {capture.COMMIT}")
    out = capture.capture(df)
    records = {r.session_id: r for r in capture.session_records(out).collect()}
    s = records["s"]
    assert (s.agent.model, s.agent.version, s.commit_range.since, s.commit_range.until, s.captured_at, s.redaction.redacted_count) == ("m-1", "1.2", "b" * 40, "a" * 40, "2024-01-01T00:00:00Z", 2)
    assert s.summary == 'agent session: plan, 1 tool execution(s), 1 model turn(s) for commit "Add cookies".' and [x.kind for x in s.spans] == ["agent.plan", "gen_ai.completion", "gen_ai.tool.execution"]
    assert secret not in str(out.collect()) and records["t"].source_fingerprint == capture.PLAN_ONLY
    notes = capture.ledger_lines(out).withColumnsRenamed({"sha": "commit_sha", "line": "body"})
    good, bad = ledger.parse_notes(notes)
    e = json.loads(good.first().entry)
    assert good.count() == 1 and bad.first().sha == "e" * 40  # no change is known for the other commit yet
    assert (e["change_id"], e["reasoning"]["intent"], e["author"]["human"], e["scope"], e["session_ref"], e["summary"]) == ("c" * 32, "Use cookies", "ann@x", [{"path": "a.py", "blob": "d"}], s.session_ref, "Add cookies")
    table = VersionedTable(spark, f"file://{tmp_path}/sessions")
    for _ in range(2):
        table.insert_new(capture.session_records(out), "session_ref")
    assert table.read().count() == 2


def test_a_failed_redaction_keeps_the_entry_alone():
    def bad(_):
        raise ValueError("no")

    event = {"session_id": "s", "seq": 1, "event": "maybe-commit", "tool_name": "Bash", "command": "git commit", "head": "a" * 40, "transcript": '{"type":"assistant","message":{"content":[{"type":"text","text":"x"}]}}'}
    from tracewell.functions.redaction import Rule

    _, out = capture.step({}, event, [Rule("bad", bad)])
    assert out["record"] is None and out["session_ref"] is None and "redaction failed" in out["entry"] and '"x"' not in out["entry"]

"""Later touches, streams of payloads, logs and evictions."""

import json
import os
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewell.operators import touches
from tracewell.sources import git_sink, outcomes, payloads
from tracewell.sources.git import GitSource, git
from tracewell.streaming import capture, newest


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("depth, folded", [(3, 0.2), (1, 0.9)])
def test_later_touches_equal_brute_force(spark, many_parts, depth, folded):
    rng = random.Random(3)
    rows = [(f"c{k:03}", rng.choice([f"2024-01-{rng.randint(1, 28):02}", f"2024-02-{k % 20:02}"]), f"s{k}", "x" if rng.random() < folded else None, rng.choice([["hot"], ["hot", "a", "a"], [f"p{k % 9}", None], [], ["hot", f"p{k % 3}"]])) for k in range(250)]
    rows += [("null", None, "s", None, ["hot"]), ("none", "2024", "s", None, None)]
    df = spark.createDataFrame(rows + rows[:5], "change_id string, created_at string, summary string, folded_into string, paths array<string>")
    got = {(r.change_id, r.path): (r.n_later, [tuple(t) for t in r.later], r.more) for r in touches.later_touches(df, depth).collect()}
    want = {}
    for c, t, _, _, paths in rows:
        for p in {p for p in paths or [] if p} if t else ():
            later = sorted((u, d, s) for d, u, s, f, q in rows if u and u > t and f is None and p in (q or ()))
            want[c, p] = (len(later), later[:depth], max(0, len(later) - depth))
    assert got == want and any(n > 100 for n, *_ in want.values()) == (folded < 0.5)
    assert touches.later_touches(df.limit(0), depth).collect() == []


# -- payload files


def waits(query, reached, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not reached():
        if query.exception():
            raise query.exception()
        time.sleep(0.2)
    assert reached()


def test_no_payload_is_lost_or_repeated_over_restarts(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def put(name, *objects):
        (folder / ("." + name)).write_text("".join(json.dumps(o) + "\n" for o in objects))
        (folder / ("." + name)).rename(folder / name)

    def start(**options):
        df = payloads.read(spark, str(folder), plan=str(tmp_path / "plan"), **options)
        return df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()

    def got():
        return spark.read.schema(payloads.SCHEMA).parquet(str(out)).collect() if out.exists() and list(out.glob("*.parquet")) else []

    for k in range(7):
        put(f"m{k}", {"n": k}, {"n": k, "again": True})
    q = start(maxFiles="2")
    waits(q, lambda: len(got()) == 14)
    sizes = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    q.stop()
    assert max(sizes) <= 4
    put("a-late-name", {"n": 100})  # sorts before all that was read
    (folder / "bad").write_text("nope\n\n[1]\n")
    (folder / "empty").write_text("")
    q = start(maxFiles="2", filesPerTask="1")
    put("z", {"n": 101})
    waits(q, lambda: len(got()) == 18)
    q.stop()
    rows = got()
    assert len({(r.file, r.line) for r in rows}) == len(rows) and {(r.file, r.line) for r in rows if r.problem} == {("bad", 1), ("bad", 3)} and json.loads(next(r.payload for r in rows if r.file == "z"))["n"] == 101


def test_a_plan_that_spark_did_not_hear_of_is_read_first(tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}").write_text('{"n":1}\n')
    options = {"path": str(tmp_path), "plan": str(tmp_path / "_plan"), "maxFiles": "2"}
    one = payloads.PayloadReader(options)
    assert one.latestOffset() == {"list": 1} == one.latestOffset()  # handed out, not yet taken
    assert len(one.partitions({"list": 0}, {"list": 1})[0].value) == 2
    two = payloads.PayloadReader(options)  # as after a crash between plan and offset log
    assert two.latestOffset() == {"list": 2}
    names = [n for p in two.partitions({"list": 0}, {"list": 2}) for n in p.value]
    assert len(names) == len(set(names)) == 4 and two.latestOffset() == {"list": 3} and two.partitions({"list": 2}, {"list": 2}) == []
    sized = payloads.PayloadReader({"path": str(tmp_path), "plan": str(tmp_path / "_p2"), "maxBytes": "17"})
    sized.latestOffset()
    assert len(sized.partitions({"list": 0}, {"list": 1})[0].value) == 2


def test_payloads_become_events(spark):
    lines = [{"session_id": "s", "seq": 4, "tool_name": "Bash", "tool_input": {"command": "git commit -m x"}, "tool_response": {"interrupted": True}}, {"session_id": "s", "tool_name": "ExitPlanMode", "tool_input": {"plan": "do"}}, {"tool_name": "Bash"}]
    df = spark.createDataFrame([("f", k, json.dumps(x), None) for k, x in enumerate(lines, 1)] + [("f", 9, None, "not a JSON object")], payloads.SCHEMA)
    got = payloads.events(df).orderBy("seq").collect()
    assert [(r.seq, r.event, r.command, r.response_failed, r.plan) for r in got] == [(2, "plan", None, False, "do"), (4, "maybe-commit", "git commit -m x", True, None)]


# -- the log of outcomes


def test_a_batch_that_comes_again_leaves_the_log_as_it_is(spark, tmp_path):
    w = outcomes.OutcomeWriter({"path": str(tmp_path)})
    rows = [Row(status="captured", n=1), Row(status="skipped", n=2)]
    first = w.write(iter(rows))
    w.commit([first, w.write(iter([]))], 0)
    w.commit([w.write(iter(rows))], 0)  # replayed
    w.commit([w.write(iter([Row(status="x", n=None)])), None], 1)
    w.write(iter(rows))  # of a task whose batch failed
    assert sorted((r.status, r.n) for r in outcomes.read(spark, str(tmp_path), "status string, n long").collect()) == [("captured", 1), ("skipped", 2), ("x", None)]
    assert outcomes.sweep(str(tmp_path)) == 2 and outcomes.read(spark, str(tmp_path), "status string, n long").count() == 3
    assert outcomes.read(spark, str(tmp_path / "none"), "status string").count() == 0


def test_capture_writes_the_log_as_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"p{k}").write_text(json.dumps({"session_id": f"s{k}", "seq": 1, "tool_name": "Bash", "tool_input": {"command": "git commit -m x" if k else "ls"}, "head": "h", "transcript": ""}) + "\n")
    results = capture.capture(payloads.events(payloads.read(spark, str(source), plan=str(tmp_path / "plan")))).select("session_id", "status")
    q = outcomes.append(results, str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.session_id, r.status) for r in outcomes.read(spark, str(tmp_path / "log"), "session_id string, status string").collect()} == {("s0", "skipped"), ("s1", "captured"), ("s2", "captured")}


# -- the git sink


@pytest.fixture
def repo(tmp_path):
    d = tmp_path / "repo"
    git_sink.init(str(d))
    return str(d)


def files(repo, ref):
    names = git(repo, "ls-tree", "-r", "-z", "--name-only", ref).decode().split("\0")[:-1]
    return {n: git(repo, "cat-file", "blob", f"{ref}:{n}") for n in names}


def test_a_tree_is_written_and_changed(spark, repo):
    rows = {f"{k % 7:02x}/{k % 3}/{k}.json": f"v{k}" for k in range(100)} | {"top.txt": "t", "é/ü": "ß"}
    df = spark.createDataFrame(list(rows.items()), "path string, content string")
    git_sink.write_tree(df, repo, "refs/x/map")
    assert files(repo, "refs/x/map") == {k: v.encode() for k, v in rows.items()}
    change = [("00/0/0.json", b"new\x00"), ("00/9/n.json", b""), ("01/1/1.json", None), ("top.txt", None), ("99/a", b"a")]
    git_sink.write_tree(spark.createDataFrame(change, "path string, content binary"), repo, "refs/x/map", "second")
    want = {k: v.encode() for k, v in rows.items()} | {k: v for k, v in change if v is not None}
    assert files(repo, "refs/x/map") == {k: v for k, v in want.items() if k not in ("01/1/1.json", "top.txt")}
    assert git(repo, "rev-list", "--count", "refs/x/map").strip() == b"2"
    git_sink.write_tree(df.limit(0), repo, "refs/x/map", overwrite=True)
    assert files(repo, "refs/x/map") == {}


def test_of_two_writers_one_is_refused(spark, repo):
    df = spark.createDataFrame([("a/b", "1")], "path string, content string")
    git_sink.write_tree(df, repo, "refs/x/m", expected="")
    at = git(repo, "rev-parse", "refs/x/m").decode().strip()
    git_sink.write_tree(df.withColumn("content", F.lit("2")), repo, "refs/x/m", expected=at)
    for expected in ("", at):
        with pytest.raises(Exception, match="has moved"):
            git_sink.write_tree(df.withColumn("content", F.lit("3")), repo, "refs/x/m", expected=expected)
    assert files(repo, "refs/x/m") == {"a/b": b"2"}
    for bad in ("a//b", "../x", "a/.git"):
        with pytest.raises(Exception, match="is no path"):
            git_sink.write_tree(spark.createDataFrame([(bad, "1")], "path string, content string"), repo, "refs/x/m")
    assert files(repo, "refs/x/m") == {"a/b": b"2"}


def test_notes_are_appended_in_one_commit(spark, repo):
    spark.dataSource.register(GitSource)
    shas = []
    for k in range(3):
        git(repo, *git_sink.IDENTITY, "commit", "-q", "--allow-empty", "-m", str(k))
        shas.append(git(repo, "rev-parse", "HEAD").decode().strip())
    git(repo, *git_sink.IDENTITY, "notes", "--ref=intent", "add", "-m", "old", shas[0])
    git(repo, *git_sink.IDENTITY, "notes", "--ref=intent", "add", "-m", "stays", shas[2])
    lines = spark.createDataFrame([(shas[0], "n1"), (shas[0], "n2"), (shas[0], "old"), (shas[1], "n3"), (shas[1], "n3"), (None, "x"), ("bad", "x")], "sha string, line string")
    for _ in range(2):  # the second time adds nothing
        git_sink.append_notes(spark, repo, lines)
        show = lambda s: git(repo, "notes", "--ref=intent", "show", s).decode().split()
        assert [show(s) for s in shas] == [["old", "n1", "n2"], ["n3"], ["stays"]]


# -- the newest sessions


def hook(repo, session, at, kind, seq=1):
    e = {"repo": repo, "session_id": session, "seq": seq, "event": kind, "at": f"2024-01-01T00:00:{at:03}Z", "tool_name": "Bash", "command": "git commit -m x" if kind == "maybe-commit" else None, "plan": f"plan of {session} at {at}" if kind == "plan" else None, "head": f"h{at}", "transcript": ""}
    return e


COLUMNS = "repo string, session_id string, seq long, event string, at string, tool_name string, command string, plan string, head string, transcript string"


def test_forgotten_sessions_start_anew():
    events = [hook("r", f"s{k}", k, "plan") for k in range(4)] + [hook("r", "s0", 5, "maybe-commit"), hook("r", "s3", 6, "maybe-commit"), hook("r", "s9", 7, "other")]
    left, out = newest.replay({}, events, 3)
    assert [r["forgotten"] for r in out] == [None, None, None, "s0", "s1", None, None] and set(left) == {"s0", "s2", "s3"}
    assert "agent.plan" not in out[4]["record"] and "plan of s3" in out[5]["record"] and out[6]["status"] == "skipped"


def test_the_stream_forgets_as_the_batch_does(spark, tmp_path):
    rng = random.Random(20)
    events = [hook(rng.choice(["r1", "r2"]), f"s{rng.randrange(12)}", k, rng.choice(["plan", "maybe-commit", "other"])) for k in range(120)]
    source = tmp_path / "in"
    source.mkdir()
    for k in range(0, 120, 40):
        (source / f"{k:03}.json").write_text("".join(json.dumps(e) + "\n" for e in events[k : k + 40]))
        os.utime(source / f"{k:03}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    for name, value in newest.STORE.items():
        spark.conf.set(name, value)
    try:
        stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).json(str(source))
        df = newest.capture_newest(stream, n=4, idle_ms=None)
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None and len([p for p in q.recentProgress if p["numInputRows"]]) == 3
        timed = newest.capture_newest(stream, n=4, idle_ms=5000).select("repo", "session_id", "status").writeStream.format("memory").queryName("timed").trigger(processingTime="500 milliseconds").start()
        waits(timed, lambda: spark.table("timed").count() == 120)
        batches = len(timed.recentProgress)
        (source / "later.json").write_text("".join(json.dumps(hook(r, f"s{k}", 200, "maybe-commit")) + "\n" for r in ("r1", "r2") for k in range(12)))
        waits(timed, lambda: spark.table("timed").count() == 144 and len(timed.recentProgress) > batches)
        timed.stop()
        streamed = {(r.repo, r.session_id, r.seq, r.head): (r.status, r.forgotten, r.record) for r in spark.read.schema(newest.RESULT).parquet(str(tmp_path / "out")).collect()}
    finally:
        for name in newest.STORE:
            spark.conf.unset(name)
    batch = {(r.repo, r.session_id, r.seq, r.head): (r.status, r.forgotten, r.record) for r in newest.capture_newest(spark.createDataFrame([tuple(e[c.split()[0]] for c in COLUMNS.split(", ")) for e in events], COLUMNS), n=4).collect()}
    assert streamed == batch and len(batch) == 120 and sum(f is not None for _, f, _ in batch.values()) > 5

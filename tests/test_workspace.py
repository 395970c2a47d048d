"""A workspace over a real repository, from commits to answers."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tracewell.__main__ import main
from tracewell.operators.index import FingerprintError
from tracewell.operators.retrieval import bm25
from tracewell.plans import sync as syncing
from tracewell.plans.ask import run_tool
from tracewell.plans.workspace import STATE, TargetError, Workspace
from tracewell.sources.git import push_status
from tracewell.streaming import capture

A, B = "a" * 32, "b" * 32


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    d = tmp_path_factory.mktemp("repo")

    def run(*args):
        return subprocess.run(["git", "-C", d, "-c", "user.name=Ann", "-c", "user.email=a@x", *args], check=True, capture_output=True, text=True).stdout.strip()

    run("init", "-q", "-b", "main")
    run("config", "user.name", "Ann")
    run("config", "user.email", "a@x")
    (d / "session.py").write_text("def cookie():\n    return 'signed token'\n")
    run("add", ".")
    run("commit", "-qm", f"Use cookies\n\nChange-Id: I{A}")
    (d / "config.md").write_text("read toml\n")
    run("add", ".")
    run("commit", "-qm", f"Add config\n\nChange-Id: I{B}")
    (d / "x.txt").write_text("x\n")
    run("add", ".")
    run("commit", "-qm", "Plain")
    shas = run("log", "--format=%H").split()
    run("notes", "--ref=intent", "add", "-m", "{broken", shas[0])
    return d, shas


@pytest.fixture(scope="module")
def work(spark, place):
    d, shas = place
    w = Workspace(spark, str(d), f"file://{d}/.tracewell")
    w.adopt()
    e = {"author": {"type": "agent", "tool": "t", "model": "claude-1"}, "summary": "Cookies instead of redis", "scope": [{"path": "session.py", "range": [1, 2], "blob": "b"}], "reasoning": {"intent": "no server state", "confidence": 0.4}, "provenance": "agent-captured"}
    w.annotate(shas[2], {**e, "created_at": "2024-01-01T00:00:00Z"})
    w.annotate(shas[2], {**e, "created_at": "2024-01-02T00:00:00Z", "summary": "Signed cookies, not redis"})
    w.annotate(shas[1], {"author": {"type": "human", "human": "ann"}, "summary": "Config by hand", "scope": [{"path": "session.py", "blob": "c"}], "created_at": "2024-01-03T00:00:00Z"})
    return w


def test_reports(work, place):
    r = work.report()
    rows = r["timeline"].orderBy("walk_pos").collect()
    assert [x.badge_label for x in rows] == ["note unreadable", "human · ann", "agent · t · claude-1"] and rows[2].summary == "Signed cookies, not redis" and [x.change_id for x in rows[1:]] == [B, A]
    t = r["totals"].first()
    assert (t.commits, t.changes, t.agent, t.human, t.none, t.models) == (3, 2, 1, 1, 1, "claude-1")
    assert [x.kind for x in r["groups"].orderBy("severity").collect()] == ["note-unreadable", "low-confidence"] and r["warnings"].count() == 1
    assert [x.annotation for x in work.log(limit="2").collect()] == ["no intent: ledger note unreadable", "human"]


def test_targets(work, place):
    shown = work.show("c/aaaa").orderBy("n").collect()
    assert [(s.n, s.is_effective, s.superseded) for s in shown] == [(1, False, 1), (2, True, 1)]
    assert work.show(place[1][1][:10]).first().summary == "Config by hand"
    for bad in ("c/ffff", "c/a", place[1][0]):
        with pytest.raises(TargetError):
            work.show(bad)
    with pytest.raises(TargetError):
        work.annotate(place[1][0], {"summary": "x"})
    with pytest.raises(TargetError):
        work.annotate(place[1][1], {"summary": "x", "change_id": A})


def test_blame(work):
    r = work.blame("session.py", 2).first()
    assert r.change_id == A and r.summary == "Signed cookies, not redis"
    assert [x.change_id for x in work.later_touches("session.py", "2024-01-02T00:00:00Z", A).collect()] == [B]


def test_index_and_questions(work):
    assert [r.problem for r in work.verify_index().collect()] == ["absent"]
    first = {r.kind: (r.indexed, r.embedded) for r in work.reindex().collect()}
    assert first == {"code": (3, 3), "ledger": (2, 2)} and work.index_state()["mode"] == "initial" and work.verify_index().count() == 0
    assert {r.kind: r.reused for r in work.reindex().collect()} == {"code": 3, "ledger": 2} and work.index_state()["mode"] == "incremental"
    top = work.ask("why not redis for cookies").first()
    assert top.kind == "ledger" and top.intent == "Signed cookies, not redis"
    assert work.ask("config", path="config.md", line=1).first().path == "config.md"
    assert {r.change_id for r in work.ask("nothing alike", since="2024-01-03T00:00:00Z").collect()} <= {B} and work.confidence(work.ask("why not redis for cookies")).first().level == "high"
    why = work.explain_line("session.py", 2)
    assert why["line"].first().change_id == A and [r.change_id for r in why["later"].collect()] == [B] and why["sources"].count() > 0


def test_incremental_index(spark, tmp_path):
    """Only changed blobs are read; chunks of blobs that are gone go, from the keyword index too; a lost base or another model is noticed."""
    d = tmp_path / "repo"
    d.mkdir()

    def run(*args):
        return subprocess.run(["git", "-C", d, "-c", "user.name=Ann", "-c", "user.email=a@x", *args], check=True, capture_output=True, text=True).stdout.strip()

    run("init", "-q", "-b", "main")
    for name, text in (("a.md", "apples and pears"), ("b.md", "bread"), ("c.md", "bread")):
        (d / name).write_text(text)
    run("add", ".")
    run("commit", "-qm", "one")
    w = Workspace(spark, str(d), f"file://{tmp_path}/store")
    assert {r.kind: (r.indexed, r.embedded) for r in w.reindex().collect()} == {"code": (2, 2)}  # b and c are one blob
    (d / "a.md").write_text("plums only")
    (d / "d.md").write_text("dates")
    run("rm", "-q", "b.md")
    run("add", ".")
    run("commit", "-qm", "two")
    assert [r.problem for r in w.verify_index().collect()] == ["stale"]
    assert {r.kind: (r.indexed, r.embedded) for r in w.reindex().collect()} == {"code": (3, 2)} and w.index_state()["mode"] == "incremental"
    assert sorted(r.text for r in w.index_table.read().collect()) == ["bread", "dates", "plums only"]
    assert w.keywords.search("apples pears", 5).count() == 0 and w.keywords.search("plums", 5).count() == 1
    want = {r.key: round(r.score, 9) for r in bm25(w.index_table.read(), "bread plums dates", None).collect()}
    assert {r.key: round(r.score, 9) for r in w.keywords.search("bread plums dates", None).collect()} == want
    w.state_table.write(spark.createDataFrame([("index-state@1", "x", "f" * 40, "bag-of-words/64", 3, "t")], STATE), w.state_table.version())
    w.reindex()
    assert w.index_state()["mode"] == "initial" and w.verify_index().count() == 0
    w.state_table.write(spark.createDataFrame([("index-state@1", "x", "f" * 40, "other/8", 3, "t")], STATE), w.state_table.version())
    for call in (w.reindex, lambda: w.ask("bread")):
        with pytest.raises(FingerprintError):
            call()
    assert w.reindex(full=True).first().embedded == 3


def test_detaching_and_inferring(spark, tmp_path):
    d = tmp_path / "repo"
    d.mkdir()

    def run(*args):
        return subprocess.run(["git", "-C", d, "-c", "user.name=Ann", "-c", "user.email=a@x", *args], check=True, capture_output=True, text=True).stdout.strip()

    run("init", "-q", "-b", "main")
    run("config", "user.name", "Ann")
    run("config", "user.email", "a@x")
    run("commit", "-q", "--allow-empty", "-m", "root")
    run("checkout", "-qb", "side")
    (d / "f.txt").write_text("one")
    run("add", ".")
    run("commit", "-qm", f"known\n\nChange-Id: I{A}")
    side = run("rev-parse", "HEAD")
    run("checkout", "-q", "main")
    (d / "f.txt").write_text("two")
    run("add", ".")
    run("commit", "-qm", "the same again")
    again = run("rev-parse", "HEAD")
    w = Workspace(spark, str(d), f"file://{tmp_path}/store")
    w.adopt()
    assert {r.sha: r.rule for r in w.adopt(infer=True).where("rule = 'R4'").collect()} == {again: "R4"}
    row = w.change_map().first()
    assert (row.head, set(row.history), row.origin) == (again, {side, again}, "inferred")
    w.annotate(again, {"author": {"type": "human"}, "summary": "its own"})
    own = w.detach(again)
    rows = {r.change_id: r for r in w.change_map().collect()}
    assert rows[A].head == side and rows[own].history == [again] and w.notes()[0].first().change_id == own


def test_export_doctor_and_sync(work, spark, place, tmp_path):
    records = [json.loads(r.record) for r in work.export().collect()]
    assert [r["metadata"]["ledger"]["change_id"] for r in records] == [A, B] and records[0]["files"][0]["conversations"][0]["ranges"][0]["end_line"] == 2
    assert {(r.name, r.message) for r in work.doctor().collect()} == {("unreadable notes", "1"), ("trailer-recovery", f"2 change(s): {A}, {B}")} | {(f"index {r.problem}", r.detail) for r in work.verify_index().collect()}
    other = Workspace(spark, str(place[0]), f"file://{tmp_path}/other")
    assert {(r.kind, r.action) for r in other.sync(work).collect()} == {("sessions", "up-to-date"), ("notes", "up-to-date"), ("change-map", "adopted")} and {r.change_id for r in other.change_map().collect()} == {A, B}


def test_commands(work, place, capsys):
    base = ["--repo", str(place[0]), "--store", f"file://{place[0]}/.tracewell"]
    assert main([*base, "log"]) == 0 and "Config by hand" in capsys.readouterr().out
    assert main([*base, "report"]) == 0 and "| " in capsys.readouterr().out
    assert main([*base, "show", "c/ffff"]) == 1 and main([*base, "blame", "session.py:1"]) == 0


@pytest.fixture
def pair(spark, tmp_path):
    """Two clones with a workspace each, and git in them."""
    def run(d, *args):
        return subprocess.run(["git", "-C", d, "-c", "user.name=Ann", "-c", "user.email=a@x", *args], check=True, capture_output=True, text=True).stdout.strip()

    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    run(one, "init", "-q", "-b", "main")
    for k, c in enumerate((A, B, "c" * 32)):
        (one / f"f{k}").write_text(str(k))
        run(one, "add", ".")
        run(one, "commit", "-qm", f"commit {k}\n\nChange-Id: I{c}")
    run(tmp_path, "clone", "-q", str(one), str(two))
    for d in (one, two):
        run(d, "config", "user.name", "Ann")
        run(d, "config", "user.email", "a@x")
    return *(Workspace(spark, str(d), f"file://{d}-store") for d in (one, two)), run


def test_sync_keeps_folds_amends_and_notes_of_either_side(pair):
    one, two, run = pair
    one.adopt()
    shas = run(one.repo, "log", "--format=%H").split()
    said = lambda df: {(r.phase, r.kind): r.action for r in df.collect()}
    assert said(two.sync(one)) == {("fetch", "sessions"): "up-to-date", ("fetch", "notes"): "up-to-date", ("fetch", "change-map"): "adopted"}
    # an amend and a note there, a fold and another note here
    run(two.repo, "commit", "-q", "--amend", "-m", f"better\n\nChange-Id: I{'c' * 32}")
    new = run(two.repo, "rev-parse", "HEAD")
    two.relink("c" * 32, new)
    two.annotate(shas[2], {"author": {"type": "human"}, "summary": "there"})
    one.annotate(shas[2], {"author": {"type": "human"}, "summary": "here"})
    m = one.change_map().withColumn("folded_into", F.when(F.col("change_id") == B, A))
    one.map_table.write(m, one.map_table.version())
    before = one.map_table.version()
    assert said(one.sync(two, dry=True)) == {("fetch", "sessions"): "up-to-date", ("fetch", "notes"): "would-fetch", ("fetch", "change-map"): "would-fetch"} and one.map_table.version() == before
    result = one.sync(two)
    assert said(result) == {("fetch", "sessions"): "up-to-date", ("fetch", "notes"): "merged", ("fetch", "change-map"): "merged"} and syncing.clean(result)
    rows = {r.change_id: r for r in one.change_map().collect()}
    assert rows[B].folded_into == A and rows["c" * 32].head == new and rows["c" * 32].history == [shas[0], new] and not rows["c" * 32].divergent_heads
    assert {r.summary for r in one.notes()[0].collect()} == {"here", "there"}
    # nothing is pushed without a word, and what would be is told
    with pytest.raises(syncing.Unconfirmed, match="2 entries on 1 commit"):
        one.sync(two, fetch=False, push=True)
    asked = []
    assert set(said(one.sync(two, fetch=False, push=True, confirm=lambda text: asked.append(text))).values()) == {"skipped"} and "3 changes" in asked[0]
    assert two.notes()[0].count() == 1
    assert said(one.sync(two, fetch=False, push=True, yes=True)) == {("push", "sessions"): "up-to-date", ("push", "notes"): "pushed", ("push", "change-map"): "pushed"}
    assert {r.summary for r in two.notes()[0].collect()} == {"here", "there"} and {r.change_id: r.folded_into for r in two.change_map().collect()}[B] == A
    assert set(said(one.sync(two, push=True, yes=True)).values()) == {"up-to-date"}


def test_heads_that_diverge_are_told_and_not_pushed(pair):
    one, two, run = pair
    one.adopt()
    two.sync(one)
    for w, text in ((one, "mine"), (two, "theirs")):
        run(w.repo, "commit", "-q", "--amend", "-m", f"{text}\n\nChange-Id: I{'c' * 32}")
        w.relink("c" * 32, run(w.repo, "rev-parse", "HEAD"))
    heads = [run(w.repo, "rev-parse", "HEAD") for w in (one, two)]
    result = one.sync(two)
    row = {r.change_id: r for r in one.change_map().collect()}["c" * 32]
    assert not syncing.clean(result) and row.head == heads[0] and row.divergent_heads == sorted(heads) and {r.name for r in one.doctor().collect()} >= {"divergent"}
    assert syncing.descends(one, two, one.spark.createDataFrame([(heads[0], run(one.repo, "rev-parse", "HEAD~1")), (heads[1], run(two.repo, "rev-parse", "HEAD~2")), tuple(heads)], "descendant string, ancestor string")).count() == 2


def test_a_lost_map_is_rebuilt(pair):
    one, _, run = pair
    shas = run(one.repo, "log", "--format=%H").split()
    one.adopt()
    had = {(r.change_id, r.head) for r in one.change_map().collect()}
    one.map_table.write(one.change_map().limit(0), one.map_table.version())
    assert {(r.change_id, r.head) for r in one.rebuild_map().collect()} == had and {r.sha: r.rule for r in one.adopt().collect()} == dict.fromkeys(shas, "R1")


def test_tags_keep_heads_alive_and_other_refs_do_not(pair):
    one, _, run = pair
    one.adopt()
    gone = run(one.repo, "rev-parse", "HEAD")
    run(one.repo, "reset", "-q", "--hard", "HEAD~1")
    run(one.repo, "update-ref", "refs/other/kept", gone)
    assert "unreachable" in {r.name for r in one.doctor().collect()}
    run(one.repo, "tag", "-a", "v1", "-m", "kept", gone)
    assert "unreachable" not in {r.name for r in one.doctor().collect()}


@pytest.mark.parametrize("line, want", [("=\trefs/notes/intent:refs/notes/intent\t[up to date]", "up-to-date"), ("!\tr:r\t[rejected] (fetch first)", "rejected"), ("*\tr:r\t[new reference]", "pushed"), ("To /tmp/x", None), ("Done", None), ("", None)])
def test_lines_of_a_push(line, want):
    got = push_status(line)
    assert (got[1] if got else None) == want


def test_tools_of_an_answering_model(pair):
    one, _, run = pair
    one.adopt()
    shas = run(one.repo, "log", "--format=%H").split()
    one.annotate(shas[1], {"author": {"type": "agent", "tool": "t"}, "summary": "Second file", "reasoning": {"intent": "to have two", "rejected": [{"option": "none", "why": "too few"}]}, "provenance": "agent-captured", "created_at": "2024-01-01T00:00:00Z"})
    one.annotate(shas[0], {"author": {"type": "human"}, "summary": "Touches it", "scope": [{"path": "f1", "blob": "b"}], "created_at": "2024-02-01T00:00:00Z"})
    assert [s.path for s in one.notes()[0].where(F.col("sha") == shas[1]).first().scope] == ["f1"]  # from the commit
    tools = {t.name: t for t in one.ask_tools()}
    call = lambda name, **given: run_tool(tools, name, given)
    ok, text = call("commit_diff", sha="HEAD~1")
    assert ok and f"commit {shas[1]}" in text and "subject: commit 1" in text and "1 file(s), +1 -0" in text and "+1" in text
    ok, text = call("show_change", target="c/" + B[:6])
    assert ok and "Second file" in text and "intent: to have two" in text and "rejected: none: too few" in text and "session: none" in text
    ok, text = call("log_intent", n="2")
    assert ok and len(text.splitlines()) == 2 and text.startswith(shas[0][:8]) and call("log_intent", path="nowhere") == (True, "(no commits matched)")
    ok, text = call("blame_why", file="f1", line=1)
    assert ok and "Second file" in text and "Touches it" in text
    for name, given in (("commit_diff", {}), ("log_intent", {"n": 51}), ("blame_why", {"file": "f1", "line": 0}), ("blame_why", {"file": "f1", "line": True}), ("show_change", {"target": "c/zzzz"}), ("none", {})):
        assert not call(name, **given)[0]
    told = {(r.change_id, r.path): (r.n_later, [t.summary for t in r.later]) for r in one.touches().collect()}
    assert told == {(B, "f1"): (1, ["Touches it"]), ("c" * 32, "f1"): (0, [])}
    assert [r.change_id for r in one.export("HEAD~1").collect()] == [B] and one.export("HEAD~2..HEAD").count() == 2 == one.export().count() and one.export("c/" + "c" * 32).count() == 1


def test_captures_are_recorded_once(pair, spark):
    one, _, run = pair
    one.adopt()
    head = run(one.repo, "rev-parse", "HEAD")
    events = spark.createDataFrame([("s", 1, "plan", None, None, False, "do it", None, None, None), ("s", 2, "maybe-commit", "Bash", "git commit -m x", False, None, head, "", "2024-01-01T00:00:00Z")], capture.EVENTS + ", at string")
    results = capture.capture(events.withColumn("change_id", F.lit("c" * 32)).withColumn("subject", F.lit("a subject")))
    for _ in range(2):
        one.record(results)
        e = one.notes()[0].collect()
        assert [(r.sha, r.summary, r.reasoning.intent) for r in e] == [(head, "a subject", "do it")] and one.sessions().count() == 1
    assert one.show("c/" + "c" * 32).first().session.status == "available"

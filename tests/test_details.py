"""Scopes, sessions, flags, usage and labels against plain loops and stated cases."""

import re

import pytest
from pyspark.sql import functions as F

from tracewell.functions.labels import split_citations, wrap_text
from tracewell.operators import details as d

ZERO = d.NO_BLOB
PATHS = "sha string, path string, old_blob string, new_blob string"


def test_scopes(spark):
    a, b = "a" * 40, "b" * 40
    paths = spark.createDataFrame([("1", "x\\y", ZERO, a), ("1", "gone", b, ZERO), ("2", "m", a, b), ("3", "none", ZERO, ZERO), ("3", "odd", a, None)], PATHS)
    merges = spark.createDataFrame([("2", 1)], "sha string, path int")
    assert sorted(map(tuple, d.captured_scope(paths, merges).collect())) == [("1", "x/y", a)]
    assert sorted(map(tuple, d.derived_scope(paths).collect())) == [("1", "gone", b), ("1", "x/y", a), ("2", "m", b), ("3", "odd", a)]
    assert d.captured_scope(paths.limit(0), merges).count() == 0


def test_session_info(spark):
    sessions = spark.createDataFrame([("s1", ("t", "v", "m"), ["x", "y"], "now", None)] * 2, "session_ref string, agent struct<tool:string,version:string,model:string>, spans array<string>, captured_at string, summary string")
    rows = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, None), (1, "s1")], "id int, session_ref string")
    got = sorted((r.id, r.session.status, r.session.reason, r.session.agent_model, r.session.span_count) for r in d.session_info(rows, sessions).collect())
    assert got == [(1, "available", None, "m", 2), (1, "available", None, "m", 2), (2, "unavailable", d.NO_SESSION, None, None), (3, "none", None, None, None)]


def test_flags_and_usage(spark):
    r = spark.createDataFrame([(1, (0.0, None, "hard")), (2, None)], "id int, reasoning struct<confidence:double,scope_risk:string,reversibility:string>")
    assert [x.f for x in r.orderBy("id").select(d.flags().alias("f")).collect()] == ['{"confidence":0.0,"reversibility":"hard"}', "{}"]
    u = spark.createDataFrame([("a", 3, None), ("a", None, None), ("b", None, None)], "k string, input_tokens long, output_tokens long")
    assert sorted(map(tuple, d.token_usage(u, "k").collect())) == [("a", 3, 0), ("b", None, None)]


def test_rewrite_pairs(spark):
    lines = spark.createDataFrame([("o n extra",), ("",), ("  \r",), (None,), ("\to2  n2\r",)], "value string")
    assert sorted(map(tuple, d.rewrite_pairs(lines).collect())) == [("o", "n"), ("o2", "n2")]
    with pytest.raises(Exception, match="no pair of commits"):
        d.rewrite_pairs(spark.createDataFrame([("alone",)], "value string")).collect()


def test_log_lines(spark, tmp_path):
    (tmp_path / "log").write_text("a\n\n  \nb")
    assert d.log_lines(spark, f"file://{tmp_path}/log") == 2
    assert d.log_lines(spark, f"file://{tmp_path}/none") == 0


def test_citations(spark):
    def plain(answer, n):
        out, last = [], 0
        for m in re.finditer(r"\[([0-9]+)\]", answer):
            if 1 <= int(m[1]) <= n:
                out += [("text", answer[last : m.start()], None)] * (m.start() > last) + [("citation", None, int(m[1]))]
                last = m.end()
        return out + [("text", answer[last:], None)] * (last < len(answer))

    answers = ["", "no mark", "[1]", "a [2] b [9] c [002][3]", "[0] x", f"[{'9' * 50}] [{'0' * 50}1]", "[1][", "[3]end [4]"]
    rows = spark.createDataFrame([(a,) for a in answers] + [(None,)], "a string").select("a", split_citations(F.col("a"), F.lit(3)).alias("s")).collect()
    for r in rows:
        assert r.s is None if r.a is None else [tuple(x) for x in r.s] == plain(r.a, 3)


def test_wrapped_texts(spark):
    def plain(text, first, indent, width):
        lines, line, bare = [], first, True
        for w in text.split():
            if not bare and len((line + " " + w).encode("utf-16-be")) // 2 > width:
                lines.append(line)
                line = indent + w
            else:
                line = line + w if bare else f"{line} {w}"
            bare = False
        return [*lines, line]

    texts = ["", "  ", "one", "word " * 50, "x" * 120 + " y", "a" * 10 + " " + "b" * 9 + " c", "\U0001f600" * 9 + " ab", "a b　c", " lead\n\ntrail\t"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", wrap_text(F.col("t"), "> ", "  ", 20).alias("w")).collect():
        assert r.w == plain(r.t, "> ", "  ", 20)


def test_labels(spark):
    n = spark.createDataFrame([(1, 1, 0), (2, 3, 1), (0, 0, 2)], "a int, b int, c int")
    got = [tuple(r) for r in n.select(d.notes_label(F.col("a"), F.col("b"), F.col("c")), d.sessions_label(F.col("a")), d.changes_label(F.col("b"))).collect()]
    assert got == [("1 entry on 1 commit", "1 trace, redacted", "1 change"), ("2 entries on 3 commits, 1 unreadable note", "2 traces, redacted", "3 changes"), ("0 entries on 0 commits, 2 unreadable notes", "0 traces, redacted", "0 changes")]

"""Queries on scopes, sessions, flags, usage and labels, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import split_citations, wrap_text
from ..operators import details as d
from .catalogue import Tables, query

_BLOB = "printf('%040x', {})"
_NEW, _OLD = f"CASE l_returnflag WHEN 'R' THEN '{d.NO_BLOB}' ELSE {_BLOB.format('l_suppkey + 1')} END", f"CASE l_returnflag WHEN 'N' THEN '{d.NO_BLOB}' ELSE {_BLOB.format('l_suppkey + 2')} END"


def _paths(x: Tables) -> DataFrame:
    """Lines of orders as changed files: those with flag R were deleted, those with flag N are new."""
    blob = lambda n, none: F.when(F.col("l_returnflag") == none, d.NO_BLOB).otherwise(F.lpad(F.lower(F.hex(n)), 40, "0"))
    return x.lineitem.select(F.col("l_orderkey").alias("sha"), F.format_string("src\\%d\\%d", F.col("l_linenumber"), F.col("l_partkey")).alias("path"), blob(F.col("l_suppkey") + 2, "N").alias("old_blob"), blob(F.col("l_suppkey") + 1, "R").alias("new_blob"))


@query(f"SELECT l_orderkey AS sha, 'src/' || l_linenumber || '/' || l_partkey AS path, {_NEW} AS blob FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def captured_scope(x: Tables) -> DataFrame:
    return d.captured_scope(_paths(x), x.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("sha")))


@query(f"SELECT l_orderkey AS sha, 'src/' || l_linenumber || '/' || l_partkey AS path, CASE l_returnflag WHEN 'R' THEN {_OLD} ELSE {_NEW} END AS blob FROM lineitem")
def derived_scope(x: Tables) -> DataFrame:
    return d.derived_scope(_paths(x))


@query(f"""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'none' WHEN c_custkey IS NULL THEN 'unavailable' ELSE 'available' END AS status, CASE WHEN o_custkey % 5 <> 0 AND c_custkey IS NULL THEN '{d.NO_SESSION}' END AS reason,
CASE WHEN o_custkey % 5 <> 0 THEN c_mktsegment END AS agent_tool, CASE WHEN o_custkey % 5 <> 0 AND c_custkey IS NOT NULL THEN c_nationkey END AS span_count
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def session_info(x: Tables) -> DataFrame:
    span = "array<struct<span_id:string>>"
    spans = F.when(F.col("c_nationkey") > 0, F.transform(F.sequence(F.lit(1), F.greatest("c_nationkey", F.lit(1))), lambda k: F.struct(k.cast("string").alias("span_id")))).otherwise(F.array().cast(span))
    agent = F.struct(F.col("c_mktsegment").alias("tool"), F.lit("m").alias("model"), F.lit("1").alias("version"))
    sessions = x.customer.where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("session_ref"), agent.alias("agent"), spans.alias("spans"), F.lit("2026-01-01T00:00:00Z").alias("captured_at"), F.lit(None).cast("string").alias("summary"))
    refs = x.orders.select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey").cast("string")).alias("session_ref"))
    return d.session_info(refs, sessions).select("o_orderkey", "session.status", "session.reason", "session.agent_tool", F.col("session.span_count").cast("long").alias("span_count"))


@query("""SELECT o_orderkey, '{' || array_to_string(list_filter([CASE WHEN o_orderkey % 3 > 0 THEN '"confidence":0.5' END, CASE WHEN o_orderstatus <> 'F' THEN '"scopeRisk":"' || o_orderstatus || '"' END,
CASE WHEN o_orderkey % 2 = 0 THEN '"reversibility":"hard"' END], lambda v: v IS NOT NULL), ',') || '}' AS flags FROM orders""")
def report_flags(x: Tables) -> DataFrame:
    said = F.struct(F.when(F.col("o_orderkey") % 3 > 0, F.lit(0.5)).alias("confidence"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("scope_risk"), F.when(F.col("o_orderkey") % 2 == 0, "hard").alias("reversibility"))
    return x.orders.select("o_orderkey", said.alias("reasoning")).select("o_orderkey", d.flags().alias("flags"))


@query("SELECT l_orderkey, sum(CASE WHEN l_returnflag <> 'R' THEN l_linenumber END)::BIGINT AS input_tokens, sum(CASE WHEN l_returnflag = 'A' THEN l_suppkey WHEN l_returnflag = 'N' THEN 0 END)::BIGINT AS output_tokens FROM lineitem GROUP BY l_orderkey")
def token_usage(x: Tables) -> DataFrame:
    told = F.col("l_returnflag")
    rounds = x.lineitem.select("l_orderkey", F.when(told != "R", F.col("l_linenumber")).cast("long").alias("input_tokens"), F.when(told == "A", F.col("l_suppkey")).cast("long").alias("output_tokens"))
    return d.token_usage(rounds, "l_orderkey")


@query("""SELECT l_orderkey, n || CASE n WHEN 1 THEN ' entry on ' ELSE ' entries on ' END || c || CASE c WHEN 1 THEN ' commit' ELSE ' commits' END || CASE WHEN u = 1 THEN ', 1 unreadable note' WHEN u > 1 THEN ', ' || u || ' unreadable notes' ELSE '' END AS notes,
n || CASE n WHEN 1 THEN ' trace, redacted' ELSE ' traces, redacted' END AS sessions, c || CASE c WHEN 1 THEN ' change' ELSE ' changes' END AS changes
FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS c, count(*) FILTER (l_returnflag = 'R') AS u FROM lineitem GROUP BY l_orderkey)""")
def payload_labels(x: Tables) -> DataFrame:
    n = x.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("c"), F.count_if(F.col("l_returnflag") == "R").alias("u"))
    return n.select("l_orderkey", d.notes_label(F.col("n"), F.col("c"), F.col("u")).alias("notes"), d.sessions_label(F.col("n")).alias("sessions"), d.changes_label(F.col("c")).alias("changes"))


@query("SELECT l_orderkey::VARCHAR AS old_sha, l_partkey::VARCHAR AS new_sha FROM lineitem")
def rewrite_pairs(x: Tables) -> DataFrame:
    line = F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit(" \t"), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") == 1, " amend\r").otherwise(""))
    return d.rewrite_pairs(x.lineitem.select(F.explode(F.array(line, F.lit(" \r"))).alias("value")))


_ANSWER = "'[' || doc_id % 9 || ']' || coalesce(text, '') || '[0' || doc_id % 4 || '] and [77][3]'"


@query(rf"""SELECT doc_id, len(list_filter(string_split_regex(a, '\[0*[1-5]\]'), lambda t: t <> '')) AS texts, array_to_string(regexp_extract_all(a, '\[0*([1-5])\]', 1), ',') AS cited,
sha256(array_to_string(list_filter(string_split_regex(a, '\[0*[1-5]\]'), lambda t: t <> ''), '|')) AS said FROM (SELECT doc_id, {_ANSWER} AS a FROM documents)""")
def answer_citations(x: Tables) -> DataFrame:
    answer = F.concat(F.lit("["), (F.col("doc_id") % 9).cast("string"), F.lit("]"), F.coalesce("text", F.lit("")), F.lit("[0"), (F.col("doc_id") % 4).cast("string"), F.lit("] and [77][3]"))
    s = x.documents.select("doc_id", split_citations(answer, F.lit(5)).alias("s"))
    texts, cited = F.filter("s", lambda v: v["kind"] == "text"), F.filter("s", lambda v: v["kind"] == "citation")
    return s.select("doc_id", F.size(texts).cast("long").alias("texts"), F.array_join(F.transform(cited, lambda v: v["n"].cast("string")), ",").alias("cited"), F.sha2(F.array_join(F.transform(texts, lambda v: v["text"]), "|"), 256).alias("said"))


@query()
def wrapped_texts(x: Tables) -> DataFrame:
    """Lines of every text and their digest. SQL would need a step for each word; tests hold it against a plain loop."""
    w = x.documents.select("doc_id", wrap_text(F.col("text"), "  > ", "    ").alias("lines"))
    return w.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))

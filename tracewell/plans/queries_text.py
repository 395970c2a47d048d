"""Queries on scalar functions, redaction, chunking, transcripts and diffs, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import redaction as red
from ..functions import shell
from ..functions import text as t
from ..operators import chunking as ch
from ..operators import diff as df_
from ..operators import transcript as tr
from ..streaming.capture import capture
from .catalogue import Tables, query
from .export import trace_files, trace_records

_ASSIGNED = red.ASSIGNED.replace("'", "''")


@query(f"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '{_ASSIGNED}', 2, 'i'), lambda v: regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8)) AS n FROM documents""")
def redact_generic_count(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", red.secret_count(F.col("text")).cast("long").alias("n"))


@query()
def redact_documents(x: Tables) -> DataFrame:
    """A digest of every row's text by all rules; a null text gives none. SQL can't say the gated rule's replacements."""
    return red.redact_rows(x.documents.select("doc_id", "text")).select("doc_id", F.sha2("redacted.text", 256).alias("digest"))


@query()
def redacted_texts(x: Tables) -> DataFrame:
    """Every row's text by all rules, by the whole-match rules alone, and what fired; a null text stays null. SQL can't say the gated rule's replacements."""
    d = red.redact_rows(x.documents.select("doc_id", "text"))
    return d.select("doc_id", F.col("redacted.text").alias("text"), red.redact_native(F.col("text")).alias("keys_text"), "redacted.rules")


@query()
def redaction_counts(x: Tables) -> DataFrame:
    return red.redact_rows(x.documents.select("doc_id", "text")).select("doc_id", "redacted.rules", "redacted.redacted_count")


def _quoted(pattern: str) -> str:
    """A pattern for DuckDB, whose word borders are ASCII ones."""
    for border in (red._B, red._FRONT, red._END):
        pattern = pattern.replace(border, r"\b")
    return pattern.replace("'", "''")


def _keys_sql() -> str:
    """The whole-match rules one inside the other."""
    text = "text"
    for rule, pattern in red.PATTERNS:
        text = f"regexp_replace({text}, '{_quoted(pattern)}', '{red.marker(rule)}', 'g')"
    return f"SELECT doc_id, sha256({text}) AS digest FROM documents"


def _key_counts_sql() -> str:
    """Each whole-match rule's matches in what the rules before it left."""
    steps, last = [], "documents"
    for k, (rule, pattern) in enumerate(red.PATTERNS):
        had = "".join(f"n{j}, " for j in range(k))
        steps.append(f"t{k} AS (SELECT doc_id, {had}len(regexp_extract_all(text, '{_quoted(pattern)}')) AS n{k}, regexp_replace(text, '{_quoted(pattern)}', '{red.marker(rule)}', 'g') AS text FROM {last})")
        last = f"t{k}"
    return f"WITH {', '.join(steps)} SELECT doc_id, " + ", ".join(f"coalesce(n{k}, 0)::BIGINT AS \"{rule}\"" for k, (rule, _) in enumerate(red.PATTERNS)) + f" FROM {last}"


@query(_key_counts_sql())
def redaction_key_counts(x: Tables) -> DataFrame:
    """What redact_rows() counts, rule by rule; the gated rule, which SQL can't say, comes after these."""
    fired = F.from_json("redacted.rules", "map<string,bigint>")
    d = red.redact_rows(x.documents.select("doc_id", "text")).withColumn("fired", fired)
    return d.select("doc_id", *[F.coalesce(F.try_element_at("fired", F.lit(rule)), F.lit(0)).cast("long").alias(rule) for rule, _ in red.PATTERNS])


@query(_keys_sql())
def redact_keys(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", F.sha2(red.redact_native(F.col("text")), 256).alias("digest"))


@query("WITH c AS (SELECT doc_id, text, unnest(range(1, least(len(text), 401) + 1)) AS k FROM documents), f AS (SELECT doc_id, max(k) FILTER (strlen(left(text, k)) <= 400) AS k FROM c GROUP BY doc_id) SELECT d.doc_id, sha256(CASE WHEN strlen(text) <= 400 THEN text ELSE left(text, f.k) || '«truncated»' END) AS digest FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id")
def byte_truncate(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", F.sha2(red.cap_column(F.col("text"), 400), 256).alias("digest"))


@query("SELECT page_id, url, regexp_matches(lower(url), '^.*secrets.*$') OR regexp_matches(lower(regexp_extract(url, '([^/]*)$', 1)), '^\\.env.*$|^.*\\.pem$|^.*secrets.*$|^id_rsa.*$|^.*\\.key$|^.*page.*$') OR regexp_matches(lower(url), '^\\.env.*$|^.*\\.pem$|^id_rsa.*$|^.*\\.key$|^.*page.*$') AS never FROM pages")
def never_capture(x: Tables) -> DataFrame:
    return x.pages.select("page_id", "url", t.never_captured(F.col("url"), [*red.NEVER_CAPTURE, "*page*"]).alias("never"))


@query("""WITH m AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Change-Id: I' || lpad(to_hex(o_orderkey), 32, '0') WHEN 'F' THEN 'Change-Id: bad' || chr(10) || 'change-id: ' || left(sha256(o_orderkey::VARCHAR), 40) ELSE 'Change-Id: short' END AS msg FROM orders)
SELECT o_orderkey, CASE WHEN msg LIKE 'Change-Id: I%' THEN lower(substr(msg, 13)) WHEN msg LIKE '%change-id: %' THEN substr(msg, instr(msg, 'change-id: ') + 11, 32) END AS change_id FROM m""")
def trailer_parse(x: Tables) -> DataFrame:
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    m = F.when(status == "O", F.concat(F.lit("text\n\nChange-Id: I"), F.lpad(F.hex(k), 32, "0"))).when(status == "F", F.concat(F.lit("Change-Id: bad\nchange-id: "), F.substring(F.sha2(k.cast("string"), 256), 1, 40))).otherwise("Change-Id: short")
    return x.orders.select("o_orderkey", t.trailer_change_id(m).alias("change_id"))


@query("WITH h AS (SELECT doc_id, left(sha256(text), 32) AS h FROM documents) SELECT doc_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS uuid, h[1:2] || '/' || h[3:] || '.json' AS shard FROM h")
def change_uuid(x: Tables) -> DataFrame:
    h = F.substring(F.sha2("text", 256), 1, 32)
    return x.documents.select("doc_id", t.uuid_form(h).alias("uuid"), t.shard_path(h).alias("shard"))


@query("SELECT p_partkey, CASE WHEN lower(p_name) LIKE 'claude%' THEN 'anthropic/' || p_name ELSE p_name END AS model FROM part")
def model_ids(x: Tables) -> DataFrame:
    return x.part.select("p_partkey", t.model_id(F.col("p_name")).alias("model"))


@query("SELECT user_id, event_id, CASE WHEN event_id % 9 BETWEEN 1 AND 5 AND user_id % 7 BETWEEN 1 AND 5 AND user_id % 7 <> event_id % 9 THEN (event_id % 9) || ',' || (user_id % 7) WHEN event_id % 9 BETWEEN 1 AND 5 THEN (event_id % 9)::VARCHAR WHEN user_id % 7 BETWEEN 1 AND 5 THEN (user_id % 7)::VARCHAR ELSE '' END AS cited FROM events")
def citations(x: Tables) -> DataFrame:
    a, b = (F.col("event_id") % 9).cast("string"), (F.col("user_id") % 7).cast("string")
    text = F.concat(F.lit("as ["), a, F.lit("] and ["), b, F.lit("], again ["), a, F.lit("] not [x] or []"))
    return x.events.select("user_id", "event_id", F.array_join(t.citations(text, 5), ",").alias("cited"))


@query("SELECT doc_id, CASE WHEN len(text) > 160 THEN left(text, 157) || '…' ELSE text END AS c160, CASE WHEN len(text) > 90 THEN left(text, 87) || '…' ELSE text END AS c90 FROM documents")
def clamp(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", t.clamp(F.col("text"), 160, 157).alias("c160"), t.clamp(F.col("text"), 90, 87).alias("c90"))


@query("SELECT page_id, CASE WHEN page_id > 0 THEN regexp_replace(url, ':[0-9]+$', '') END AS path, CASE WHEN page_id > 0 THEN page_id ELSE 0 END::INT AS line FROM pages")
def file_line(x: Tables) -> DataFrame:
    p = t.file_line(F.concat(F.col("url"), F.lit(":"), F.col("page_id").cast("string")))
    return x.pages.select("page_id", p["path"].alias("path"), F.coalesce(p["line"], F.lit(0)).alias("line"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 0 ELSE c_nationkey END AS ahead, CASE c_mktsegment WHEN 'MACHINERY' THEN c_nationkey + 1 ELSE 0 END AS behind FROM customer")
def branch_track(x: Tables) -> DataFrame:
    n, seg = F.col("c_nationkey"), F.col("c_mktsegment")
    track = F.when(seg == "HOUSEHOLD", "[gone]").when(seg == "MACHINERY", F.concat(F.lit("[ahead "), n.cast("string"), F.lit(", behind "), (n + 1).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("[ahead "), n.cast("string"), F.lit("]")))
    return x.customer.select("c_custkey", t.ahead_behind(track)["ahead"].alias("ahead"), t.ahead_behind(track)["behind"].alias("behind"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN strftime(ts, '%Y-%m-%d') = '2024-01-05' THEN 'Today' WHEN strftime(ts, '%Y-%m-%d') = '2024-01-04' THEN 'Yesterday' ELSE strftime(ts, '%Y-%m-%d') END AS heading, epoch_us(ts) // 1000 AS ms FROM events")
def event_days(x: Tables) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return x.events.select("event_id", t.day_of(iso).alias("day"), t.day_heading(t.day_of(iso), F.lit("2024-01-05").cast("date")).alias("heading"), t.instant_ms(iso).alias("ms"))


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events")
def canonical_props(x: Tables) -> DataFrame:
    return x.events.select("event_id", t.canonical_json(F.col("props")).alias("canonical"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey > 12 THEN 'p:' || s_nationkey ELSE 'p:' || s_nationkey || ':fp16' END AS fingerprint FROM supplier")
def model_fingerprints(x: Tables) -> DataFrame:
    return x.supplier.select("s_suppkey", t.model_fingerprint(F.lit("p"), F.col("s_nationkey"), F.when(F.col("s_nationkey") > 12, "q8").otherwise("fp16")).alias("fingerprint"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'tsx' WHEN 3 THEN 'javascript' ELSE 'text' END AS language FROM part")
def language_for_path(x: Tables) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ["PY", "ts", "Tsx", "mjs", "md"])), F.col("p_size") % 5 + 1)
    return x.part.select("p_partkey", t.language_of(F.concat("p_name", F.lit("."), ext)).alias("language"))


@query("SELECT doc_id, len(text) > 5000 OR contains(text, chr(0)) AS skipped, trim(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')[1]) AS first_line FROM documents")
def content_checks(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", t.skipped_content(F.col("text"), 5000).alias("skipped"), t.first_line(F.col("text")).alias("first_line"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'human · m · ' || o_orderpriority WHEN 'O' THEN 'agent · t · m' ELSE 'no reasoning recorded' END AS label FROM orders")
def badge_labels(x: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    kind = F.when(s == "F", "human").when(s == "O", "agent")
    b = t.badge(kind, F.when(s == "O", "t"), F.lit("m"), F.col("o_orderpriority"), F.lit(False))
    return x.orders.select("o_orderkey", b["label"].alias("label"))


def _entry_rows(x: Tables) -> DataFrame:
    """An entry for each order: its line items are the scope."""
    item = F.struct(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("path"), F.when(F.col("l_quantity") > 25, F.struct(F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + 1).alias("end_line"))).alias("range"), F.lit("b").alias("blob"))
    g = x.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("item")))), lambda z: z["item"]).alias("scope"))
    o = x.orders.join(g, F.col("o_orderkey") == F.col("l_orderkey"))
    reasoning = F.struct(F.col("o_orderpriority").alias("intent"), F.array(F.lit("a"), F.lit("b")).alias("constraints"), F.array(F.struct(F.lit("x").alias("option"), F.col("o_orderstatus").alias("why"))).alias("rejected"), F.lit(None).cast("string").alias("directive"), F.array().cast("array<string>").alias("tested"))
    author = F.struct(F.when(F.col("o_orderstatus") == "F", "human").otherwise("agent").alias("type"), F.lit("tool").alias("tool"), F.lit("claude-x").alias("model"))
    return o.select(F.lpad(F.lower(F.hex("o_orderkey")), 32, "0").alias("change_id"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.lpad(F.hex("o_custkey"), 40, "0").alias("revision"), F.col("o_orderpriority").alias("summary"), author.alias("author"), "scope", reasoning.alias("reasoning"), F.lit("agent-captured").alias("provenance"), F.lit(None).cast("string").alias("session_ref"))


@query("SELECT o_orderkey, o_orderpriority || chr(10) || 'Intent: ' || o_orderpriority || chr(10) || 'Constraints: a; b' || chr(10) || 'Rejected: x — ' || o_orderstatus AS text FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def ledger_texts(x: Tables) -> DataFrame:
    return _entry_rows(x).select("o_orderkey", t.ledger_text(F.col("summary"), F.col("reasoning")).alias("text"))


@query("SELECT printf('%032x', l_orderkey) AS change_id, 'p' || l_suppkey AS path, count(*) FILTER (l_quantity > 25) AS n_ranges FROM lineitem GROUP BY 1, 2")
def trace_file_groups(x: Tables) -> DataFrame:
    return trace_files(_entry_rows(x)).select("change_id", "path", "n_ranges")


@query("SELECT printf('%032x', o_orderkey) AS change_id, CASE WHEN o_orderstatus = 'F' THEN 'human' ELSE 'ai' END AS contributor, 'anthropic/claude-x' AS model, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_files FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def agent_trace(x: Tables) -> DataFrame:
    r = trace_records(_entry_rows(x))
    j = F.col("record")
    return r.select("change_id", F.get_json_object(j, "$.files[0].conversations[0].contributor.type").alias("contributor"), F.get_json_object(j, "$.files[0].conversations[0].contributor.model_id").alias("model"), F.size(F.from_json(F.get_json_object(j, "$.files"), "array<struct<path:string>>")).cast("long").alias("n_files"))


@query("""WITH l AS (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents), f AS (SELECT *, pos - row_number() OVER (PARTITION BY key ORDER BY pos) AS run FROM l WHERE trim(line) <> '')
SELECT key, min(pos) + 1 AS start_line, max(pos) + 1 AS end_line, sum(len(line))::BIGINT AS n_chars FROM f GROUP BY key, run""")
def chunk_gap_segments(x: Tables) -> DataFrame:
    return ch.filled_runs(x.documents, "doc_id", "text").withColumns({"start_line": F.col("start_line").cast("long"), "end_line": F.col("end_line").cast("long")})


@query("""WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda z: len(z)) AS s FROM documents), w(doc_id, k, size, ends) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT, '' FROM l
UNION ALL SELECT w.doc_id, k + 1, CASE WHEN size > 0 AND size + s[k + 1] + 1 > 600 THEN s[k + 1] + 1 ELSE size + s[k + 1] + 1 END, CASE WHEN size > 0 AND size + s[k + 1] + 1 > 600 THEN ends || k || ',' ELSE ends END FROM w JOIN l ON l.doc_id = w.doc_id WHERE k < len(s))
SELECT doc_id, arg_max(ends, k) || max(k) AS ends FROM w GROUP BY doc_id""")
def chunk_windows(x: Tables) -> DataFrame:
    return x.documents.select("doc_id", F.array_join(F.transform(ch.greedy_windows(F.col("text"), 600), lambda z: z.cast("string")), ",").alias("ends"))


@query()
def chunk_files(x: Tables) -> DataFrame:
    d = x.documents.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("blob_sha"), F.col("text").alias("content"))
    return ch.chunk_files(d).select("path", "node_path", "start_line", "end_line", F.length("text").alias("n_chars"))


def _lines(x: Tables) -> DataFrame:
    """Conversations as transcript lines: the assistant's turns say a text and call a tool; a system turn isn't JSON."""
    call = F.to_json(F.struct(F.lit("assistant").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.concat(F.lit("v"), F.col("turn").cast("string")).alias("version"), F.struct(F.lit("m").alias("model"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command:string>").alias("input")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Bash").alias("name"), F.struct(F.lit("ls").alias("command")).alias("input"))).alias("content")).alias("message")))
    line = F.when(F.col("role") == "assistant", call).when(F.col("role") == "user", F.to_json(F.struct(F.lit("user").alias("type")))).otherwise("not json")
    return x.conversations.select("conv_id", F.col("turn").alias("pos"), line.alias("line"))


@query("WITH s AS (SELECT conv_id, turn, unnest([0, 1]) AS block, text FROM conversations WHERE role = 'assistant') SELECT conv_id, 's' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, block) AS span_id, CASE block WHEN 0 THEN 'gen_ai.completion' ELSE 'gen_ai.tool.execution' END AS kind, CASE block WHEN 1 THEN 'Bash' END AS name, CASE block WHEN 1 THEN 'ls' END AS command FROM s WHERE NOT (block = 0 AND (text IS NULL OR trim(text) = ''))")
def transcript_spans(x: Tables) -> DataFrame:
    return tr.spans(tr.parsed_lines(_lines(x), "conv_id", "pos", "line"), "conv_id", "pos").select("conv_id", "span_id", "kind", "name", "command")


@query("SELECT conv_id, count(*) || ' tool executions, ' || count(*) || ' model turns' AS summary FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def session_summary(x: Tables) -> DataFrame:
    return tr.summaries(tr.spans(tr.parsed_lines(_lines(x), "conv_id", "pos", "line"), "conv_id", "pos"), "conv_id").select("conv_id", "summary")


@query("SELECT conv_id, 'v' || max(turn) FILTER (role = 'assistant') AS version, count(*) FILTER (role = 'system') AS skipped, count(*) FILTER (role <> 'system') > 0 AS ok FROM conversations GROUP BY conv_id")
def newest_meta(x: Tables) -> DataFrame:
    return tr.meta(tr.parsed_lines(_lines(x), "conv_id", "pos", "line"), "conv_id", "pos").select("conv_id", "version", "skipped", "ok")


@query("WITH t AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id) SELECT c.conv_id, turn AS pos FROM conversations c JOIN t ON t.conv_id = c.conv_id WHERE turn >= CASE WHEN 2 <= n THEN 2 ELSE 0 END")
def transcript_since(x: Tables) -> DataFrame:
    lines = _lines(x)
    return tr.since(lines, "conv_id", "pos", lines.select("conv_id").distinct().withColumn("since_line", F.lit(2))).select("conv_id", "pos")


@query("SELECT conv_id AS session_id, turn AS seq, CASE WHEN role = 'system' THEN 'buffered-plan' WHEN role = 'assistant' THEN 'captured' ELSE 'skipped' END AS status FROM conversations")
def capture_events(x: Tables) -> DataFrame:
    role = F.col("role")
    e = x.conversations.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.when(role == "system", "plan").otherwise("maybe-commit").alias("event"), F.lit("Bash").alias("tool_name"), F.when(role == "assistant", "git add . && git commit -m x").otherwise("echo git commit").alias("command"), F.lit(False).alias("response_failed"),
        F.when(role == "system", F.concat(F.lit("plan "), F.col("text"))).alias("plan"), F.concat(F.lit("h"), F.col("turn").cast("string")).alias("head"), F.lit('{"type":"user"}').alias("transcript"),
    )
    return capture(e).select(F.col("session_id").cast("long").alias("session_id"), "seq", "status")


@query("SELECT event_id, event_type IN ('click', 'error') AS commits FROM events")
def shell_commits(x: Tables) -> DataFrame:
    e = F.col("event_type")
    command = F.when(e == "click", "FOO=1 /usr/bin/git -C dir commit -m 'a && b'").when(e == "error", "make; git.exe -c a=b commit").when(e == "view", "echo 'git commit'").otherwise("git status | git commit-tree")
    return x.events.select("event_id", shell.git_commit(command).alias("commits"))


@query("SELECT event_id, event_type IN ('click', 'error') AS failed FROM events")
def tool_failures(x: Tables) -> DataFrame:
    e = F.col("event_type")
    response = F.when(e == "click", '{"exit_code":1}').when(e == "error", '{"is_error":true}').when(e == "view", '{"success":"no"}').otherwise(F.col("props"))
    return x.events.select("event_id", shell.says_failed(response).alias("failed"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE l_returnflag WHEN 'N' THEN 'context' WHEN 'A' THEN 'add' ELSE 'del' END AS kind FROM lineitem)
SELECT l_orderkey, l_linenumber, kind, CASE WHEN kind <> 'add' THEN 10 + coalesce(sum((kind <> 'add')::INT) OVER w, 0) ELSE 0 END::BIGINT AS old_line, CASE WHEN kind <> 'del' THEN 20 + coalesce(sum((kind <> 'del')::INT) OVER w, 0) ELSE 0 END::BIGINT AS new_line FROM k WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def diff_numbering(x: Tables) -> DataFrame:
    k = _diff_kind(x)
    return df_.numbered_lines(k, ["l_orderkey"], "pos", "kind", F.lit(10), F.lit(20)).withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("old_line", "new_line")}).drop("pos")


def _diff_kind(x: Tables) -> DataFrame:
    f = F.col("l_returnflag")
    kind = F.when(f == "N", "context").when(f == "A", "add").otherwise("del")
    return x.lineitem.select("l_orderkey", "l_linenumber", kind.alias("kind"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", kind.alias("kind")).alias("pos"))


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS additions, count(*) FILTER (l_returnflag = 'R') AS deletions FROM lineitem GROUP BY 1")
def diff_totals(x: Tables) -> DataFrame:
    return df_.file_totals(_diff_kind(x), "l_orderkey")


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS additions, count(*) FILTER (l_returnflag = 'R') AS deletions, 'src/' || l_orderkey || '.txt' AS path FROM lineitem GROUP BY l_orderkey")
def patch_parse(x: Tables) -> DataFrame:
    f = F.col("l_returnflag")
    line = F.concat(F.when(f == "N", " ").when(f == "A", "+").otherwise("-"), F.col("l_partkey").cast("string"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda z: z["line"]), "\n")
    name = F.concat(F.lit("src/"), F.col("l_orderkey").cast("string"), F.lit(".txt"))
    p = x.lineitem.groupBy("l_orderkey").agg(body.alias("body"))
    patch = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1,9 +1,9 @@\n"), F.col("body"), F.lit("\n"))
    rows = df_.parse_patches(p.select(F.col("l_orderkey").cast("string").alias("sha"), patch.alias("patch")))
    return df_.file_totals(rows, "sha", "path").select(F.col("sha").cast("long").alias("l_orderkey"), "additions", "deletions", "path")

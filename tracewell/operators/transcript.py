"""Agent transcripts (a JSON event a line) as spans, by Spark's variant functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utc_time


def _text(v: Column, path: str) -> Column:
    """A string field that is a string and not empty; null else."""
    got = F.try_variant_get(v, path, "string")
    is_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    return F.when(is_text & (got != ""), got)


def parsed_lines(lines: DataFrame, by: str, pos: str, line: str) -> DataFrame:
    """by, pos, recognised, type, at, version, model and content of each line that isn't blank."""
    v = F.try_parse_json(F.col(line))
    rows = lines.where(F.trim(F.regexp_replace(line, r"\s", " ")) != "").select(by, pos, v.alias("v"))
    kind = _text(F.col("v"), "$.type")
    content = F.try_variant_get("v", "$.message.content", "array<variant>")
    return rows.select(by, pos, kind.isNotNull().alias("recognised"), kind.alias("type"), utc_time(_text(F.col("v"), "$.timestamp")).alias("at"), _text(F.col("v"), "$.version").alias("version"), _text(F.col("v"), "$.message.model").alias("model"), content.alias("content"))


def spans(parsed: DataFrame, by: str, pos: str) -> DataFrame:
    """Spans in order, numbered s1, s2, ... in each transcript: texts, plans and tool calls of the assistant's lines."""
    b = parsed.where(F.col("type") == "assistant").select(by, pos, "at", F.posexplode("content").alias("block", "c"))
    kind, name = _text(F.col("c"), "$.type"), _text(F.col("c"), "$.name")
    said, plan = _text(F.col("c"), "$.text"), _text(F.col("c"), "$.input.plan")
    span = F.when((kind == "text") & (F.trim(F.regexp_replace(said, r"\s", " ")) != ""), "gen_ai.completion")
    span = span.when((kind == "tool_use") & (name == "ExitPlanMode") & plan.isNotNull(), "agent.plan").when((kind == "tool_use") & (name != "ExitPlanMode"), "gen_ai.tool.execution")
    s = b.select(by, pos, "block", "at", span.alias("kind"), F.when(span == "gen_ai.tool.execution", name).alias("name"), F.when(span == "gen_ai.completion", said).when(span == "agent.plan", plan).alias("body"), F.when(span == "gen_ai.tool.execution", _text(F.col("c"), "$.input.file_path")).alias("file"), F.when(span == "gen_ai.tool.execution", _text(F.col("c"), "$.input.command")).alias("command"))
    s = s.where(F.col("kind").isNotNull())
    n = F.row_number().over(Window.partitionBy(by).orderBy(pos, "block"))
    return s.select(by, F.concat(F.lit("s"), n.cast("string")).alias("span_id"), "kind", "name", "at", "body", "file", "command")


def since(lines: DataFrame, by: str, pos: str, markers: DataFrame) -> DataFrame:
    """Lines after each transcript's marker (by, since_line); a marker past the end means a new file, which is read whole. pos counts from 0."""
    total = lines.groupBy(by).agg((F.max(pos) + 1).alias("total"))
    m = total.join(markers, by, "left").select(by, F.when(F.col("since_line") <= F.col("total"), F.col("since_line")).otherwise(0).alias("_from"))
    return lines.join(m, by).where(F.col(pos) >= F.col("_from")).drop("_from")


def meta(parsed: DataFrame, by: str, pos: str) -> DataFrame:
    """The last version and model that any line states, lines not understood, and whether the format was recognised at all."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(pos)))
    return parsed.groupBy(by).agg(last("version").alias("version"), last("model").alias("model"), F.count_if(~F.col("recognised")).alias("skipped"), (F.count_if(F.col("recognised")) > 0).alias("ok"))


def summaries(spans_: DataFrame, by: str) -> DataFrame:
    """What a session did, in a sentence."""
    g = spans_.groupBy(by).agg(F.count_if(F.col("kind") == "agent.plan").alias("plans"), F.count_if(F.col("kind") == "gen_ai.tool.execution").alias("tools"), F.count_if(F.col("kind") == "gen_ai.completion").alias("turns"))
    parts = F.concat_ws(", ", F.when(F.col("plans") > 0, "plan"), F.when(F.col("tools") > 0, F.concat(F.col("tools").cast("string"), F.lit(" tool executions"))), F.when(F.col("turns") > 0, F.concat(F.col("turns").cast("string"), F.lit(" model turns"))))
    return g.withColumn("summary", parts)

"""Exact histogram of encoded lengths, and what its suffix sums answer.

Documents are counted by length (partial counts before the shuffle) into a table, so each is encoded once and all later work is on one row a
distinct length. Running sums go in two steps, over stripes of lengths and then within each stripe, so no
step sorts all lengths in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import token_lengths
from .common import Scratch

STRIPE = 1024


def length_counts(lengths: DataFrame) -> DataFrame:
    """n_tokens and n_docs: the rows of each length. Null lengths are not counted."""
    return lengths.where(F.col("n_tokens").isNotNull()).groupBy(F.col("n_tokens").cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def length_histogram(counts: DataFrame) -> DataFrame:
    """From length_counts(), one row a distinct length L:

    n_tokens (L), n_docs and sum_tokens of that length; docs_le, tokens_le of lengths up to L; docs_gt,
    tokens_gt of longer ones; truncated_tokens, what is left of all documents cut to L; lost_tokens, what the
    cut drops; cdf, the share of documents with at most L. Documents without tokens have length 0. No rows give no rows.
    The counts are read more than once: they should be a table.
    """
    h = counts.withColumn("sum_tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("stripe", F.floor(F.col("n_tokens") / STRIPE))
    within = Window.partitionBy("stripe").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    own = h.select("*", F.sum("n_docs").over(within).alias("d"), F.sum("sum_tokens").over(within).alias("t"))
    stripes = h.groupBy("stripe").agg(F.sum("n_docs").alias("sd"), F.sum("sum_tokens").alias("st"))
    before = Window.orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # one row a stripe of lengths: as many as the longest document has tokens / STRIPE
    stripes = stripes.select("stripe", F.coalesce(F.sum("sd").over(before), F.lit(0)).alias("bd"), F.coalesce(F.sum("st").over(before), F.lit(0)).alias("bt"), F.sum("sd").over(every).alias("all_d"), F.sum("st").over(every).alias("all_t"))
    x = own.join(stripes, "stripe")
    le, tle = F.col("bd") + F.col("d"), F.col("bt") + F.col("t")
    return x.select(
        "n_tokens", "n_docs", "sum_tokens", le.alias("docs_le"), tle.alias("tokens_le"), (F.col("all_d") - le).alias("docs_gt"), (F.col("all_t") - tle).alias("tokens_gt"),
        (tle + F.col("n_tokens") * (F.col("all_d") - le)).alias("truncated_tokens"), (F.col("all_t") - tle - F.col("n_tokens") * (F.col("all_d") - le)).alias("lost_tokens"), (le / F.col("all_d")).alias("cdf"),
    )


def answers(histogram: DataFrame, limits: list[int], quantiles: list[float]) -> DataFrame:
    """kind, at, value: for each context limit the documents that are cut and the tokens that stay, for each quantile the least length with that share of documents. From the histogram alone."""
    asks = []
    for n in limits:
        cut = F.col("n_tokens") > n
        asks += [(F.lit("truncated_docs"), float(n), F.coalesce(F.sum(F.when(cut, F.col("n_docs"))), F.lit(0))), (F.lit("kept_tokens"), float(n), F.coalesce(F.sum(F.least("n_tokens", F.lit(n)) * F.col("n_docs")), F.lit(0)))]
    asks += [(F.lit("quantile"), q, F.min(F.when(F.col("cdf") >= q, F.col("n_tokens")))) for q in quantiles]
    asks.append((F.lit("total_tokens"), 0.0, F.coalesce(F.sum("sum_tokens"), F.lit(0))))
    one = histogram.agg(*[v.cast("long").alias(f"v{k}") for k, (_, _, v) in enumerate(asks)])
    rows = F.array(*[F.struct(kind.alias("kind"), F.lit(at).alias("at"), F.col(f"v{k}").alias("value")) for k, (kind, at, _) in enumerate(asks)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def token_length_histogram(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """The histogram of whole texts under a tokenizer; a null text counts as empty (length 0)."""
    counts = Scratch(docs.sparkSession, "token-lengths").put(length_counts(token_lengths(docs, tokenizer_json)), "counts")  # a row a length
    return length_histogram(counts)

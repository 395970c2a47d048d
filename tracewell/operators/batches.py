"""Batches for a model whose cost is rows times the square of the longest text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import cut

BUDGET, MOST_ROWS = 40_000_000, 16


def length_class(length: Column) -> Column:
    """The length that texts of about this one are counted with: rounded up to its four leading bits, so by less than an eighth."""
    n = F.greatest(length.cast("long"), F.lit(1).cast("long"))
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(n)) - 4, F.lit(0))).cast("long")
    return F.ceil(n / step) * step


def by_cost(rows: DataFrame, length: str, key: str, budget: int = BUDGET, most_rows: int = MOST_ROWS) -> DataFrame:
    """rows with batch_class, batch and place: rows of a class, shortest first and then by key, in batches whose rows x class^2 stay within the budget; a row that is over it alone has a batch of its own.

    Batches are numbered from 0 in each class, and no class waits for another. Rows are range-sorted, counted in each range and shifted by the counts of
    those before, so a class of any size fills several tasks. A null length counts as 0; rows of one key and length stand in any order.
    """
    size = F.coalesce(F.col(length).cast("long"), F.lit(0).cast("long"))
    keyed = rows.withColumns({"_size": size, "batch_class": length_class(size)})
    runs = cut(keyed.repartitionByRange("batch_class", "_size", key).withColumn("_run", F.spark_partition_id()))
    counts = runs.groupBy("batch_class", "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("batch_class").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # a row a task of the sort
    shift = counts.select("batch_class", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    rank = F.row_number().over(Window.partitionBy("batch_class", "_run").orderBy("_size", key)) - 1
    most = F.greatest(F.least(F.floor(F.lit(budget) / (F.col("batch_class") * F.col("batch_class"))), F.lit(most_rows)), F.lit(1))
    ranked = runs.withColumn("_rank", rank).join(shift, ["batch_class", "_run"]).withColumn("_rank", F.col("_rank") + F.col("_shift"))
    return ranked.withColumns({"batch": F.floor(F.col("_rank") / most), "place": F.col("_rank") % most}).drop("_size", "_run", "_rank", "_shift")

"""A store of vectors in cells about pivots, which answers exactly from the cells that can hold an answer.

A vector lies in the cell of its nearest pivot, with its distance to it. For a question no vector of a cell is nearer than the question's distance to the pivot less the
cell's radius (triangle inequality), and none nearer than the difference of the two distances to the pivot. So cells are read nearest first until the k-th answer is nearer than all that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from ..sources.versioned import VersionedTable
from ..workspace import cut
from .sets import delete

#: Pivots, as many rows of the table as are nearest in the order of a hash: a model of fixed size. Cells of the first read.
PIVOTS, FIRST_CELLS = 256, 8
#: What rounding of sums of squares may add to a distance.
SLACK = 1e-7


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class VectorStore:
    """Rows (key, embedding, and any others) by cell. All embeddings have `dim` components; rows whose embedding is null, of another length, or not finite are refused by `build` and `upsert`."""

    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark, self.dim = spark, dim
        self.rows, self.pivots, self.cells = (VersionedTable(spark, f"{path.rstrip('/')}/{n}") for n in ("rows", "pivots", "cells"))

    def _checked(self, rows: DataFrame) -> DataFrame:
        e = F.col("embedding")
        fit = F.coalesce((F.size(e) == self.dim) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
        return rows.withColumn("embedding", F.when(fit, e.cast("array<double>")).otherwise(F.raise_error(F.concat(F.lit("no vector of the store: "), F.coalesce(F.col("key").cast("string"), F.lit("null"))))))

    def _placed(self, rows: DataFrame, pivots: np.ndarray) -> DataFrame:
        sent = self.spark.sparkContext.broadcast(pivots)  # at most PIVOTS x dim
        dim, schema = self.dim, StructType([*rows.schema.fields]).add("cell", IntegerType()).add("to_pivot", DoubleType())

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = sent.value
            for batch in batches:
                x = _matrix(batch.column(batch.schema.get_field_index("embedding")), dim)
                near = np.argmin((p * p).sum(1)[None] - 2 * (x @ p.T), 1)
                yield batch.append_column("cell", pa.array(near.astype(np.int32))).append_column("to_pivot", pa.array(np.sqrt(((x - p[near]) ** 2).sum(1))))

        return rows.mapInArrow(place, schema)

    def _write(self, placed: DataFrame) -> None:
        v, w = self.rows.version(), self.cells.version()
        self.rows.write(placed.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("cell", "to_pivot"), v, partition_by=["cell"])
        self.cells.write(self.rows.read().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("to_pivot").alias("nearest"), F.max("to_pivot").alias("radius")), w)

    def build(self, rows: DataFrame) -> None:
        """Anew from all rows; keys are distinct."""
        checked = cut(self._checked(rows))
        chosen = checked.orderBy(F.xxhash64("key"), "key").limit(PIVOTS).select("embedding").collect()  # PIVOTS rows
        p = np.array([r.embedding for r in chosen], np.float64).reshape(-1, self.dim)
        self.pivots.write(self.spark.createDataFrame([(k, [float(v) for v in x]) for k, x in enumerate(p)], "cell int, embedding array<double>"), self.pivots.version())
        self._write(self._placed(checked, p))

    def _pivots(self) -> np.ndarray:
        got = self.pivots.read()
        if got is None:
            raise FileNotFoundError("no store was built")
        return np.array([r.embedding for r in got.orderBy("cell").collect()], np.float64).reshape(-1, self.dim)

    def upsert(self, rows: DataFrame) -> None:
        """Rows of these keys come in place of old ones; pivots stay."""
        new = cut(self._checked(rows))
        old = self.rows.read()
        kept = delete(old, new, "key")
        self._write(kept.unionByName(self._placed(new, self._pivots()).select(kept.columns)))

    def delete(self, keys: DataFrame) -> None:
        self._write(delete(self.rows.read(), keys, "key"))

    def query(self, vector: list[float], k: int) -> tuple[DataFrame, list[int]]:
        """(key, distance and the other columns of the k nearest rows, ties by key; the cells that were read). Exact: equal to measuring every row."""
        q = np.array(vector, np.float64)
        p = self._pivots()
        to = np.sqrt(((p - q) ** 2).sum(1)) if len(p) else np.zeros(0)
        cells = sorted((max(0.0, float(to[c.cell]) - c.radius, c.nearest - float(to[c.cell])), c.cell, c.n) for c in self.cells.read().collect())  # a row a cell
        rows = self.rows.read()
        distance = F.sqrt(F.aggregate(F.zip_with("embedding", F.lit([float(v) for v in q]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))

        def best(names: list[int], worst: float | None) -> DataFrame:
            mine = rows.where(F.col("cell").isin(names))
            if worst is not None:  # what the distance to the pivot already rules out isn't measured
                between = F.element_at(F.lit([float(v) for v in to]), F.col("cell") + 1)
                mine = mine.where(F.abs(F.col("to_pivot") - between) <= worst + SLACK)
            return mine.withColumn("distance", distance).drop("embedding", "to_pivot", "cell").orderBy("distance", "key").limit(k)

        first, n = [], 0
        for _, cell, size in cells:
            if n >= k and len(first) >= FIRST_CELLS:
                break
            first.append(cell)
            n += size
        found = cut(best(first, None))
        worst = found.agg(F.max("distance")).first()[0] if n >= k and k else None
        more = [cell for bound, cell, _ in cells if cell not in set(first) and (worst is None or bound <= worst + SLACK)]
        if not more:
            return found, first
        return found.unionByName(best(more, worst)).orderBy("distance", "key").limit(k), first + more

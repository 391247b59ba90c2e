"""A table of last states by key, written batch by batch, whose cost per batch follows the batch and not the table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spans(n: int, fan: int) -> list[tuple[int, int]]:
    """The batches 0 to n - 1 as aligned spans of falling size, each fan ** k long: at most fan - 1 of each size."""
    out, at = [], 0
    while at < n:
        size = 1
        while at % (size * fan) == 0 and at + size * fan <= n:
            size *= fan
        out.append((at, at + size))
        at += size
    return out


@dataclass(frozen=True)
class UpsertLog:
    """Merged batches under `path`, one folder for each span of them.

    merge(rows) takes rows of the schema with `_seq` (greater for later batches) and returns one row a key; it must not
    matter whether it is applied to parts first. Batch n writes the span that ends with it, which takes in the shorter ones
    before it where their number reaches `fan`: so a row is written again a logarithm of times, and a reader meets few folders.
    A span is written before its batch is committed; a batch that is repeated overwrites its own span only.
    """

    path: str
    schema: str
    merge: Callable[[DataFrame], DataFrame]
    fan: int = 4

    def _span(self, spark: SparkSession, span: tuple[int, int]) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/span={span[0]}-{span[1]}").withColumn("_seq", F.lit(span[0]))

    def upsert(self, batch: DataFrame, n: int) -> None:
        """Adds batch n; those before it must have been added."""
        spark = batch.sparkSession
        begin, end = spans(n + 1, self.fan)[-1]
        inner = [s for s in spans(n, self.fan) if s[0] >= begin]
        rows = reduce(DataFrame.unionByName, [self._span(spark, s) for s in inner], batch.withColumn("_seq", F.lit(n)))
        self.merge(rows).write.mode("overwrite").parquet(f"{self.path}/span={begin}-{end}")
        spark.range(n, n + 1).select(F.col("id").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/at={n % (2 * self.fan)}")

    def committed(self, spark: SparkSession) -> int:
        """How many batches there are. The last few commits are kept; an empty path is an error."""
        return spark.read.schema("n long").parquet(f"{self.path}/commits").agg(F.max("n")).first()[0] + 1

    def rows(self, spark: SparkSession, n: int | None = None) -> DataFrame:
        """One row a key as n batches have left it; all that are committed, unless n is given."""
        parts = [self._span(spark, s) for s in spans(self.committed(spark) if n is None else n, self.fan)]
        return self.merge(reduce(DataFrame.unionByName, parts))

    def vacuum(self, spark: SparkSession) -> int:
        """Deletes the spans that longer ones have taken in; returns how many. For when nobody reads an earlier state."""
        live = {f"span={a}-{b}" for a, b in spans(self.committed(spark), self.fan)}
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("span=") and s.getPath().getName() not in live]
        return sum(fs.delete(p, True) for p in old)

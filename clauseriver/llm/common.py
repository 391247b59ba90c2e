"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a session without that setting whose executors are the driver itself gets a temporary one; on a
    cluster a missing setting is an error, as other machines could not read a folder of this one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Rows go to Python workers in batches of at most `size`, however long texts are, unless the session has its own limit.

    Spark's own one, 64 MB, is held several times over by each task and its worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, size)


def text_pieces(data: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """data in pieces of about `most` bytes, cut before a space, so that the words of a long text need not be held at once."""
    at = 0
    while len(data) - at > most:
        end = data.find(b" ", at + most)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to be one of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def joined_small(df: DataFrame, small: DataFrame, key: str, most_bytes: int = 32_000_000, salts: int = 64) -> DataFrame:
    """df left-joined with `small` (at most one row a key), without a hot key in one task.

    small is broadcast if its measured size is at most most_bytes, so that df's rows stay where they are;
    else each of its rows goes to `salts` places, among which the rows of df with that key are dealt.
    """
    small = cut(small)
    width = sum((F.length(F.to_json(F.struct(F.col(f"`{c}`")))) for c in small.columns), F.lit(64))
    if (small.agg(F.sum(width)).first()[0] or 0) <= most_bytes:
        return df.join(F.broadcast(small), key, "left")
    (salt,) = own_names(df, "_salt")
    dealt = df.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t]), F.lit(salts)))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [key, salt], "left").drop(salt)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table written once to the shared folder, compressed; for what is too large to checkpoint as it is."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(df: DataFrame) -> Column:
    """128 bits over all columns of a row. Rows that agree in every column share a key."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    return F.struct(F.xxhash64(F.lit(17), *cols).alias("a"), F.xxhash64(F.lit(71), *cols).alias("b"))


def hex_slot(digest: str) -> Column:
    """One of 4096 ranges of a hex string that is uniform over rows."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def sums_before(df: DataFrame, key: str, slot: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same key that come before the row.

    Rows are ordered by `slot` (a number that cuts the key's rows into ranges), then `order`. Sums of
    whole ranges meet in one small table, so no task holds all rows of a hot key. `key` must have no nulls.
    """
    slots = df.withColumn("_slot", slot)
    base = slots.groupBy(key, "_slot").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(key).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    base = base.select(key, "_slot", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(key, "_slot").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        slots.join(base, [key, "_slot"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_slot", "_base")
    )

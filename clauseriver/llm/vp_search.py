"""Approximate nearest neighbours by inner product: vantage-point trees, one per shard."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from clauseriver.llm.common import cut, read, small_batches

K = 20
#: Rows of one tree, which bound the memory of a task; queries that go through a tree together, and that share one.
SHARD_ROWS, AT_ONCE, BLOCK_QUERIES = 8192, 4096, 1_000_000
LEAF = 256
#: 1 is exact; above it, a branch is passed over if its least distance times the factor is too far.
FACTOR = 1.1
#: What rounding may add to a distance between points of norm 1.
SLACK = 1e-7
#: Products of one query are taken for equal, until they are summed anew, if they agree to so many digits of the largest
#: possible one; so many more than k are held, that those at the limit are in.
DIGITS, SPARE = 12, 12
#: Numbers beyond this are scaled down by a power of two, as their products may not be finite.
LARGE = 2.0**500
FOUND = "query_row long, query_id long, vec_id long, near double, score double"


def norms_of(x: np.ndarray) -> np.ndarray:
    """Euclidean norms; no square over- or underflows."""
    top = np.abs(x).max(axis=1)
    top = np.where(top > 0, top, 1.0)
    return top * np.linalg.norm(x / top[:, None], axis=1)


class Node:
    """Points of an index range; split by their distance to one of them, the vantage point, or a leaf."""

    __slots__ = ("rows", "vantage", "split", "near", "far", "near_span", "far_span")

    def __init__(self, points: np.ndarray, rows: np.ndarray, leaf: int):
        self.rows, self.near = rows, None
        if len(rows) <= leaf:
            return
        self.vantage = points[rows[0]]
        away = np.linalg.norm(points[rows] - self.vantage, axis=1)
        self.split = np.median(away)
        inside = away < self.split
        if not inside.any():  # over half lie at the least distance
            inside = away <= self.split
            if inside.all():
                return
            self.split = np.nextafter(self.split, np.inf)
        self.near_span = away[inside].min(), away[inside].max()
        self.far_span = away[~inside].min(), away[~inside].max()
        self.near, self.far = Node(points, rows[inside], leaf), Node(points, rows[~inside], leaf)


class Shard:
    """The rows of one shard in layers of norms within a factor of two, longest first, each with a tree of its own.

    In a layer a further coordinate gives all points the norm 1, as the queries have, so that a larger inner
    product is a smaller distance. Neither a long vector nor a long query is then far from all others, where
    a relative bound would pass everything over.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, leaf: int):
        self.row, self.ids, self.vectors = rows, ids, vectors
        norms = norms_of(vectors)
        self.longest = norms.max()
        points = np.empty((len(vectors), vectors.shape[1] + 1))
        self.layers = []
        left = np.lexsort((rows, ids))
        while len(left):
            reach = norms[left].max() or 1.0
            inside = norms[left] >= min(norms[left].max(), reach / 2)
            within, left = left[inside], left[~inside]
            unit = vectors[within] / reach
            points[within] = np.column_stack([unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1)))])
            self.layers.append((reach, Node(points, within, leaf)))


class Search:
    """The k best rows of a shard for each of some queries."""

    def __init__(self, shard: Shard, rows: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.shard, self.row, self.queries, self.k, self.factor = shard, rows, queries, k, factor
        self.scores = np.full((len(queries), k + SPARE), -np.inf)
        self.rows = np.full((len(queries), k + SPARE), -1)
        sizes = norms_of(queries)
        self.sizes = np.where(sizes > 0, sizes, 1)
        self.lifted = np.column_stack([queries / self.sizes[:, None], np.zeros(len(queries))])
        for self.reach, root in shard.layers:
            self.visit(root, np.flatnonzero(self.worst(np.arange(len(queries))) >= -SLACK))

    def visit(self, node: Node, asked: np.ndarray) -> None:
        if not len(asked):
            return
        if node.near is None:
            self.scan(node.rows, asked)
            return
        away = np.linalg.norm(self.lifted[asked] - node.vantage, axis=1)
        inside = away < node.split
        sides = ((node.near, node.near_span, inside), (node.far, node.far_span, ~inside))
        for child, span, first in sides:
            self.visit(child, asked[first & self.open(asked, away, span)])
        for child, span, first in sides:
            self.visit(child, asked[~first & self.open(asked, away, span)])

    def open(self, asked: np.ndarray, away: np.ndarray, span: tuple[float, float]) -> np.ndarray:
        """Whether a child may hold something nearer, by the triangle inequality."""
        least = np.maximum(np.maximum(away - span[1], span[0] - away), 0)
        return least * self.factor <= np.sqrt(np.maximum(self.worst(asked), 0)) + SLACK

    def worst(self, asked: np.ndarray) -> np.ndarray:
        """The squared distance in this layer of the k-th best inner product; below 0 if no row of it can reach that."""
        return 2 - 2 * self.scores[asked, self.k - 1] / np.maximum(self.sizes[asked] * self.reach, 1e-300)

    def scan(self, rows: np.ndarray, asked: np.ndarray) -> None:
        found = self.queries[asked] @ self.shard.vectors[rows].T
        found[self.row[asked][:, None] == self.shard.row[rows][None, :]] = -np.inf
        scores = np.concatenate([self.scores[asked], found], axis=1)
        places = np.concatenate([self.rows[asked], np.broadcast_to(rows, found.shape)], axis=1)
        ids = np.where(places < 0, np.iinfo(np.int64).max, self.shard.ids[places])
        # rounded against the largest product there can be, so that equal vectors tie in whatever order their products were summed
        largest = np.maximum(self.sizes[asked] * self.shard.longest, 1e-300)
        best = np.lexsort((ids, -np.round(scores / largest[:, None], DIGITS)), axis=1)[:, : self.k + SPARE]
        self.scores[asked] = np.take_along_axis(scores, best, axis=1)
        self.rows[asked] = np.take_along_axis(places, best, axis=1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, row and inner product of the k best, summed alike for all."""
        q, place = np.nonzero(np.isfinite(self.scores))
        rows = self.rows[q, place]
        near = (self.queries[q] * self.shard.vectors[rows]).sum(axis=1)
        order = np.lexsort((self.shard.ids[rows], -near, q))
        q, rows, near = q[order], rows[order], near[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < self.k], rows[rank < self.k], near[rank < self.k]


def search_shards(batches: Iterator[pd.DataFrame], k: int, factor: float, leaf: int, scale: float) -> Iterator[pd.DataFrame]:
    """Rows come by shard, its vectors before its queries: each tree is built once and queries stream past it."""
    held: list[pd.DataFrame] = []
    shard, current = None, None
    for batch in batches:
        for key, part in batch.groupby(["dims", "shard", "block"], sort=False):
            if key != current:
                held, shard, current = [], None, key
            held.append(part[part["is_query"] == 0])
            asked = part[part["is_query"] == 1]
            if not len(asked):
                continue
            if shard is None:
                rows = pd.concat(held)
                held = []
                if not len(rows):
                    continue
                vectors = np.stack(rows["vector"].to_numpy()).astype(float) * scale
                shard = Shard(rows["row"].to_numpy(), rows["vec_id"].to_numpy(), vectors, leaf)
            for at in range(0, len(asked), AT_ONCE):
                some = asked.iloc[at : at + AT_ONCE]
                done = Search(shard, some["row"].to_numpy(), np.stack(some["vector"].to_numpy()).astype(float) * scale, k, factor)
                q, rows, near = done.found()
                with np.errstate(over="ignore"):
                    score = near / scale / scale
                yield pd.DataFrame({
                    "query_row": done.row[q], "query_id": some["vec_id"].to_numpy()[q], "vec_id": shard.ids[rows], "near": near, "score": score,
                })


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, vector (doubles), dims: vectors that aren't null or zero and hold finite numbers only.

    Rows without a vec_id take no part. Rows of one vec_id are different candidates (row, a number of its own,
    tells them apart). Other columns are dropped; an empty table gives none.
    """
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "vector", lambda x: x != 0
    )
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", F.size("vector").alias("dims")))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, leaf: int = LEAF,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of largest inner product found, but for its own row.

    vectors and queries have row, vec_id, vector and dims, as valid_vectors() gives them; a query meets the
    vectors of as many dimensions only. The vectors are dealt into shards of about shard_rows rows; a shard's
    tree is built once (once for each block_queries queries, where there are more) and the queries stream
    past it, so that a vector travels once and a task holds one shard. With factor 1 the result is exact; a
    larger one prunes more. A query with fewer than k candidates gets them all. Equal scores rank by vec_id;
    equal vectors have equal scores. Numbers too large to multiply are scaled by a power of two and rank right,
    though their score may be infinite. Queries of one vec_id get their rows each. Nothing is broadcast.
    """
    small_batches(vectors.sparkSession)
    largest = F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))
    about = vectors.agg(F.count("*").alias("n"), largest.alias("top")).first()
    asked = queries.agg(F.count("*").alias("n"), largest.alias("top")).first()
    shards, blocks = max(1, -(-about["n"] // shard_rows)), max(1, -(-asked["n"] // block_queries))
    top = max(about["top"] or 0.0, asked["top"] or 0.0)
    scale = 2.0 ** -math.frexp(top)[1] if top > LARGE else 1.0
    dealt = lambda n, by: F.pmod(F.xxhash64("row", F.lit(by)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["dims", "shard", "block", "is_query", "row", "vec_id", "vector"]
    left = vectors.withColumn("shard", dealt(shards, 1)).withColumn("block", every(blocks)).withColumn("is_query", F.lit(0))
    right = queries.withColumn("block", dealt(blocks, 2)).withColumn("shard", every(shards)).withColumn("is_query", F.lit(1))
    tasks = shards * blocks
    together = left.select(*cols).union(right.select(*cols)).repartitionById(tasks, F.pmod(F.col("shard") * blocks + F.col("block") + F.col("dims"), F.lit(tasks)).cast("int"))
    run = partial(search_shards, k=k, factor=factor, leaf=leaf, scale=scale)
    found = together.sortWithinPartitions(*cols[:4]).mapInPandas(run, FOUND)
    order = W.partitionBy("query_row").orderBy(F.desc("near"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(read(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("vec_id % 20 = 0"))

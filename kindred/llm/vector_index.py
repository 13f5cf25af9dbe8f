"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised separately; a cell is a pair of centroids, one per half. A
query walks the cells by the sum of its two centroid distances, until the cells walked hold the wanted
share of the index; what travels with a query is the last cell it walks, not the list of them. The vectors in
the walked cells are ranked by their exact inner product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kindred.llm import arrow
from kindred.session import store

SAMPLE = 20_000
SHARD_VECTORS = 16_384
SHARD_QUERIES = 16_384
CELL_VECTORS = 10
MOST_CENTROIDS = 256


@dataclass
class Index:
    """Centroids of the two halves, and how many vectors each cell holds (by first * k + second)."""

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray

    def distances(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Negated inner products with both halves' centroids; plain sums, the same in every task."""
        half = self.first.shape[1]
        return -(self.first * query[:half]).sum(1), -(self.second * query[half:]).sum(1)

    def reach(self, query: np.ndarray, wanted: int) -> tuple[float, int]:
        """The last of the cells, in order of summed distance, that together hold `wanted` vectors or all: its sum and its place.

        Places number the cells by the rank of their first centroid, then of their second; equal sums are walked in order of place.
        """
        a, b = self.distances(query)
        k, i_of, j_of = len(a), np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        sums = (a[i_of][:, None] + b[j_of][None, :]).ravel()
        order = np.argsort(sums, kind="stable")
        held = np.cumsum(self.sizes.reshape(k, k)[i_of][:, j_of].ravel()[order])
        last = order[min(np.searchsorted(held, wanted), len(order) - 1)]
        return float(sums[last]), int(last)

    def walked(self, query: np.ndarray, cells: np.ndarray, reach: float, place: int) -> np.ndarray:
        """Which of some cells (by first * k + second) lie within a reach."""
        a, b = self.distances(query)
        k, i, j = len(a), *np.divmod(cells, len(a))
        sums, rank_a, rank_b = a[i] + b[j], np.argsort(np.argsort(a, kind="stable")), np.argsort(np.argsort(b, kind="stable"))
        return ~((sums > reach) | ((sums == reach) & (rank_a[i] * k + rank_b[j] > place)))


def kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids from distinct starting rows; an empty cluster keeps its centroid."""
    rows = np.unique(x, axis=0)
    rows = rows[np.random.default_rng(8).permutation(len(rows))]
    centroids = rows[:k].copy()
    for _ in range(rounds):
        near = ((centroids ** 2).sum(1)[None, :] - 2 * (x @ centroids.T)).argmin(1)
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: doubles): vectors that are not null, not zero and hold only finite components; one row per id.

    Only vectors of the most frequent length (equal: the smallest) take part. Rows that repeat an id count
    once (the smallest vector); rows without an id are left out.
    """
    v = F.col("embedding").cast("array<double>")
    rows = (vectors.select(F.col("vec_id").cast("bigint"), v.alias("v")).where("vec_id is not null and v is not null")
            .where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (most["n"] if most else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def fit(rows: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves, learned on about SAMPLE rows chosen by a hash of the id.

    There are as many per half as give about CELL_VECTORS vectors per cell, at most MOST_CENTROIDS.
    """
    share = min(1.0, SAMPLE / max(1, count))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < share * (1 << 30)).orderBy("vec_id").select("v").collect()
    if not sample:
        sample = rows.select("v").limit(1).collect()
    x = np.array([r["v"] for r in sample])
    k = int(min(MOST_CENTROIDS, max(2, round((count / CELL_VECTORS) ** 0.5))))
    half = x.shape[1] // 2
    first, second = kmeans(x[:, :half], k), kmeans(x[:, half:], k)
    k = min(len(first), len(second))
    return first[:k], second[:k]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _assign(shared):
    def run(batches):
        first, second = shared.value
        half = first.shape[1]
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                i = ((first ** 2).sum(1)[None, :] - 2 * (v[:, :half] @ first.T)).argmin(1)
                j = ((second ** 2).sum(1)[None, :] - 2 * (v[:, half:] @ second.T)).argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array((i * len(first) + j).astype(np.int32)), batch.column("v")],
                                                 names=["vec_id", "cell", "v"])
    return run


def _reaches(shared, wanted: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                reach, place = zip(*[shared.value.reach(q, wanted) for q in _matrix(batch.column("v"))], strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(reach, pa.float64()), pa.array(place, pa.int32())],
                                                 names=["vec_id", "v", "reach", "cell"])
    return run


def _search(shared, k: int):
    """Per block of a shard's vectors and some queries: the k best vectors of each query among the cells it walks."""
    def run(batches):
        for rows in arrow.runs(batches, "block"):
            ids, v = rows.column("vec_id").to_numpy(), _matrix(rows.column("v"))
            cells, reach = rows.column("cell").to_numpy(), rows.column("reach").to_numpy()
            kind = rows.column("kind").to_numpy()
            entries, queries = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            if not len(entries) or not len(queries):
                continue
            e, e_ids, own = v[entries], ids[entries], cells[entries]
            out = []
            for at in range(0, len(queries), 256):
                some = queries[at:at + 256]
                near = v[some] @ e.T
                for n, i in enumerate(some):
                    near[n, ~shared.value.walked(v[i], own, reach[i], cells[i])] = -np.inf
                near[e_ids[None, :] == ids[some][:, None]] = -np.inf
                bar = np.partition(near, -k, axis=1)[:, -k] if len(e) > k else np.full(len(some), -np.inf)
                for n, i in enumerate(some):
                    # The product of a matrix may round rows differently; the last bits are taken from one plain sum.
                    close = np.flatnonzero((near[n] >= bar[n] - 1e-9 * max(1.0, abs(bar[n]))) & (near[n] > -np.inf)
                                           if np.isfinite(bar[n]) else near[n] > -np.inf)
                    score = (e[close] * v[i]).sum(1)
                    best = np.lexsort((e_ids[close], -score))[:k]
                    out.append((np.full(len(best), ids[i]), e_ids[close][best], score[best]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                 names=["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, share: float = 0.55) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of `vectors` (vec_id, embedding) found nearest to each of its rows in `queries` (vec_id).

    Nearest is the largest inner product in double precision; a query's own row does not count; ties go to the
    smaller id. A query walks cells until they hold `share` of all vectors, and at least 125 k vectors, so that
    fewer than k come back only if there are no more. No queries given: every vector is one. See
    `usable` for the vectors that take part. An empty table gives no rows.

    Every vector is indexed, in shards by a hash of the id, so a cell of any size spreads over all shards. Of
    the index, only centroids and cell sizes (at most MOST_CENTROIDS squared) reach the driver.
    """
    spark = vectors.sparkSession
    rows = store(usable(vectors), "vectors")
    count = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], schema)
    halves = fit(rows, count)
    cells = store(rows.mapInArrow(_assign(spark.sparkContext.broadcast(halves)), "vec_id long, cell int, v array<double>"), "cells")
    sizes = np.zeros(len(halves[0]) * len(halves[1]), np.int64)
    for r in cells.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    index = spark.sparkContext.broadcast(Index(*halves, sizes))
    asked = rows if queries is None else rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    asked = store(asked.mapInArrow(_reaches(index, max(int(share * count), 125 * k)), "vec_id long, v array<double>, reach double, cell int"), "walks")
    shards = -(-count // SHARD_VECTORS)
    turns = max(1, -(-asked.count() // SHARD_QUERIES))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    turn = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(turns))
    wanted = asked.withColumn("shard", every).select((F.col("shard") * turns + turn).alias("block"), F.lit(1).alias("kind"), "vec_id", "v", "cell", "reach")
    held = (cells.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
            .select((F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)) * turns + F.col("turn")).alias("block"), F.lit(0).alias("kind"),
                    "vec_id", "v", "cell", F.lit(0.0).alias("reach")))
    found = (held.unionAll(wanted).repartition("block").sortWithinPartitions("block")
             .mapInArrow(_search(index, k), "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact top-k search by inner product: MaxScore over impact bounds, shard by shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, materialise

#: Components of an index shard, and of a block of queries that meets it: what a task holds, whatever the width.
SHARD_WEIGHTS, QUERY_WEIGHTS = 4 << 20, 1 << 19
#: Rows of a shard that set the first threshold.
FIRST = 64


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Shard:
    """Postings of one shard: for each term (component) the rows with a non-zero weight, and the extreme weights."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        ids, weights = _distinct(ids, weights)
        self.ids, self.terms = ids, np.ascontiguousarray(weights.T)
        self.dense = (self.terms != 0).mean(axis=1) > 0.5
        self.postings = [None if dense else np.flatnonzero(term) for dense, term in zip(self.dense, self.terms, strict=True)]
        self.high, self.low = self.terms.max(axis=1), self.terms.min(axis=1)

    def search(self, query_id: int, query: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) of this shard, ties to the smaller id; less than ``floor`` need not be found.

        Terms go in order of the most they can add. Those at the end whose bounds together stay below the
        threshold are non-essential: a row without an essential term can't enter. Rows of the essential postings get
        their partial scores; the other terms are then probed one by one, for the rows that can still enter.
        """
        used = np.flatnonzero(query)
        bounds = np.maximum(query[used] * self.high[used], query[used] * self.low[used])
        order = used[np.argsort(-bounds, kind="stable")]
        rest = np.append(np.cumsum(np.sort(bounds))[::-1], 0)
        own = self.ids == query_id
        first = np.flatnonzero(~own)[:FIRST]
        scores = query[used] @ self.terms[used[:, None], first[None, :]]
        threshold = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else floor
        threshold = threshold if floor is None else max(threshold, floor)
        if threshold is None or not (rest < threshold).any():
            # a row without any of the terms scores 0, which may still be enough
            essential, rows = len(order), np.flatnonzero(~own)
        else:
            essential = int(np.argmax(rest < threshold))
            lists = [self.postings[t] for t in order[:essential]]
            # a row outside all essential postings scores at most the rest, which is below the threshold
            rows = np.arange(len(self.ids)) if any(p is None for p in lists) else np.unique(np.concatenate([*lists, np.zeros(0, np.int64)])).astype(np.int64)
            rows = rows[~own[rows]]
        partial = np.zeros(len(rows), np.int64)
        for t in order[:essential]:
            partial += query[t] * (self.terms[t] if len(rows) == len(self.ids) else self.terms[t, rows])
        for at in range(essential, len(order) + 1):
            if threshold is not None:
                alive = partial + rest[at] >= threshold
                rows, partial = rows[alive], partial[alive]
            if at < len(order):
                partial = partial + query[order[at]] * self.terms[order[at], rows]
        best = np.lexsort((self.ids[rows], -partial))[:k]
        return list(zip(partial[best].tolist(), self.ids[rows][best].tolist(), strict=True))


def _distinct(ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by id; of equal rows one."""
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (np.diff(ids[order]) == 0).any():
        order = np.lexsort((*weights.T[::-1], ids))
        ids, weights = ids[order], weights[order]
        fresh = np.append(True, (ids[1:] != ids[:-1]) | (weights[1:] != weights[:-1]).any(axis=1))
        return ids[fresh], weights[fresh]
    return ids[order], weights[order]


def _matrix(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; missing trailing components are zero."""
    sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    flat = pc.list_flatten(rows).to_numpy(zero_copy_only=False) if len(rows) else np.zeros(0, np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_weights: int = SHARD_WEIGHTS, query_weights: int = QUERY_WEIGHTS) -> DataFrame:
    """The k highest inner products of each query against all rows but its own, exactly.

    vectors and queries: vec_id, v (array<bigint>); missing trailing components are zero. Rows are dealt
    to shards by a hash of their id, queries to blocks; each (shard, block) pair is one bounded group that runs
    MaxScore, and the shards' lists are merged by rank. The first shard is searched before the others, and the k-th score that a query
    has there is where its search of the others starts. Work grows as rows times queries, as the stated query set asks, and
    so does what is sent: rows times blocks and queries times shards; a group's memory doesn't grow.

    Null ids or vectors take no part. Equal rows (id and vector) count once; of queries that share an id only
    the one with the smallest vector is asked. Very long vectors make smaller groups. Scores must fit 64 bits. Empty tables give no rows.

    Returns query_id, rank (from 1), vec_id, score.
    """
    vectors, queries = vectors.where("vec_id is not null and v is not null"), queries.where("vec_id is not null and v is not null")
    measure = lambda df: df.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    (n, wide), (m, wide_q) = measure(vectors), measure(queries)
    width = max(1, wide, wide_q)
    shards, blocks = max(1, -(-n * width // shard_weights)), max(1, -(-m * width // query_weights))
    deal = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(parts)).cast("int")
    every = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high)))
    left = vectors.select("vec_id", "v", deal(shards, 1).alias("shard"), every(0, blocks - 1).alias("block"))

    def search(index: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if len(index) and len(asked):
            shard = Shard(index.column("vec_id").to_numpy().astype(np.int64), _matrix(index.column("v"), width))
            ids, weights = asked.column("query_id").to_numpy().astype(np.int64), _matrix(asked.column("weights"), width)
            floors = asked.column("floor").to_pylist()
            order = np.lexsort((*weights.T[::-1], ids)) if len(set(ids.tolist())) < len(ids) else np.argsort(ids)
            for i in order[np.append(True, ids[order][1:] != ids[order][:-1])]:
                found += [(int(ids[i]), vec_id, score) for score, vec_id in shard.search(int(ids[i]), weights[i], k, floors[i])]
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        give_back()
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    def searched(low: int, high: int, asked: DataFrame) -> DataFrame:
        # names of their own, as both sides come from one table
        right = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("weights"), "floor", every(low, high).alias("shard"), deal(blocks, 2).alias("block"))
        index = left.where(F.col("shard").between(low, high))
        return index.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    first = searched(0, 0, queries.withColumn("floor", F.lit(None).cast("long")))
    if shards == 1:
        local = first
    else:
        first = materialise(first)
        floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
        asked = queries.join(floors.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left")
        local = first.unionByName(searched(1, shards - 1, asked))
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of quantised queries that are broadcast at once; further queries take further passes.
MOST_BROADCAST = 32 << 20
#: Candidates and queries in a tile, and lists that a node of the merge tree joins.
TILE, BLOCK, FAN_IN = 4096, 512, 16
SCALE = 256.0


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantised(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values.astype(np.float64))


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in the narrowest arithmetic that holds every partial sum."""
    bound = queries.shape[1] * max(1.0, float(np.abs(queries).max())) * max(1.0, float(np.abs(candidates).max()))
    if bound < 2**24:
        return (queries.astype(np.float32) @ candidates.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (queries @ candidates.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in queries], object) @ np.array([[int(x) for x in row] for row in candidates], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class TopLists:
    """The best k candidates so far of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.filled = np.zeros((len(ids), k), bool)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        for at in range(0, len(self.ids), BLOCK):
            own = slice(at, at + BLOCK)
            score = products(self.vectors[own], vectors)
            other = self.ids[own, None] != ids[None, :]
            width = min(self.k, len(ids))
            if width < len(ids):
                # ids ascend, so a smaller column wins a tie; columns of the k best by score, ties included
                kth = np.partition(np.where(other, score, np.iinfo(np.int64).min), len(ids) - width, axis=1)[:, len(ids) - width, None]
                above = other & (score > kth)
                tied = other & (score == kth)
                need = width - above.sum(1, keepdims=True)
                pick = above | (tied & (np.cumsum(tied, axis=1) <= need))
            else:
                pick = other
            row, col = np.nonzero(pick)
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            new_score, new_vec, new_filled = (np.full((score.shape[0], width), x) for x in (np.iinfo(np.int64).min, np.iinfo(np.int64).max, False))
            new_score[row, rank], new_vec[row, rank], new_filled[row, rank] = score[row, col], ids[col], True
            both = [np.concatenate([a[own], b], axis=1) for a, b in ((self.score, new_score), (self.vec, new_vec), (self.filled, new_filled))]
            best = np.lexsort((both[1], np.invert(both[0]), ~both[2]), axis=1)[:, : self.k]
            self.score[own], self.vec[own], self.filled[own] = (np.take_along_axis(x, best, axis=1) for x in both)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids and quantised vectors, by dimension."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    length = np.asarray(lists.value_lengths())
    values = np.asarray(lists.flatten())
    start = np.cumsum(length) - length
    for dim in np.unique(length):
        own = np.flatnonzero(length == dim)
        yield int(dim), ids[own], quantised(values[start[own][:, None] + np.arange(dim)])


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k best candidates of every query, ties to smaller vec_id.

    vectors and queries: vec_id long, embedding array. A candidate is any row with another vec_id than
    the query; a repeated vec_id counts as often as it occurs. A query id that repeats is asked once, with
    its smallest vector. Vectors that are null, empty or hold null or non-finite components and rows
    without an id take no part; only vectors of the query's dimension are compared. Scores are exact;
    beyond 64 bits they are held at the bounds. Other columns have no effect; without candidates a
    query has no rows.

    Candidates never move: each task offers its rows, tile by tile, to all queries of a pass and sends on
    k candidates a query at most. The queries of a pass are broadcast and hold no more than MOST_BROADCAST bytes; passes
    run one after the other, each writes its lists and frees its broadcast.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    clean = [x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))) for x in (vectors, queries)]
    asked = clean[1].groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    size = (asked.agg(F.sum(F.size("embedding").cast("long") * 8 + 16)).first()[0] or 0) * 1.25
    passes = max(1, -(-int(size) // MOST_BROADCAST))
    tiles = clean[0].rdd.getNumPartitions()
    lists = None
    for number in range(passes):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == number).toArrow()
        held: dict[int, list] = {}
        for batch in block.to_batches():
            for dim, ids, values in rows_of(batch):
                held.setdefault(dim, []).append((ids, values))
        sent = spark.sparkContext.broadcast({d: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for d, parts in held.items()})

        def offer(batches, sent=sent):
            from pyspark import TaskContext

            best = {d: TopLists(ids, values, k) for d, (ids, values) in sent.value.items()}
            for batch in batches:
                for at in range(0, batch.num_rows, TILE):
                    for dim, ids, values in rows_of(batch.slice(at, TILE)):
                        if dim in best:
                            best[dim].offer(ids, values)
            for top in best.values():
                row, col = np.nonzero(top.filled)
                node = np.full(len(row), TaskContext.get().partitionId())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (top.ids[row], node, top.vec[row, col], top.score[row, col])], names=["query_id", "node", "vec_id", "score"])

        found = scratch.write(clean[0].mapInArrow(offer, "query_id long, node long, vec_id long, score long"), f"lists{number}")
        sent.destroy()
        lists = found if lists is None else lists.unionAll(found)
    # smaller is better, so arrays sort by themselves; bitwise not keeps the order of 64-bit scores
    lists = lists.select("query_id", F.expr("node div 16").alias("node"), F.array(F.struct(F.bitwise_not("score").alias("worse"), "vec_id")).alias("top"))
    nodes = -(-tiles // FAN_IN)
    while True:
        lists = lists.groupBy("query_id", "node").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        if nodes <= 1:
            break
        nodes = -(-nodes // FAN_IN)
        lists = lists.withColumn("node", F.expr("node div 16"))
    out = lists.select("query_id", F.posexplode("top").alias("pos", "one"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.bitwise_not(F.col("one.worse")).alias("score"))


#: DuckDB, for the query's columns.
ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
    from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""

"""Exact top-k inner products by block-at-a-time pruning.

Vectors lie in blocks of consecutive ids; a block keeps the largest and the
smallest value of each of its terms (components) beside its forward index (the
matrix of its rows). For a query, a block's bound is the sum over terms of the
better of the two products. Blocks are taken in order of falling bounds and
scored in full until the next bound is below the query's k-th score; equal
bounds are still scored, as a smaller id wins a tie. Scores are exact integers.
The k-th score of a query starts at its k-th best among the other queries of its
batch, which are candidates as well: a bound that holds in every group of blocks.

Blocks are gathered in groups. Queries meet every group in batches: one task
holds one batch and one group, both of fixed size, and returns k rows a query.

Defined results: vectors that are null or hold a null or non-finite component,
and rows without an id, take no part. Vectors are compared with those of their
own length. A row that repeats an id is a candidate of its own, and never one
for a query of that id; a query that repeats is answered once. With fewer than
k candidates all are returned. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

BLOCK_ROWS = 256
GROUP_ROWS = 4_096  # rows of a group of blocks, about
BATCH_QUERIES = 1_024  # queries of a batch, about
EXACT = 1 << 53  # float64 holds every integer below


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long; null unless all are finite."""
    doubles = vector.cast("array<double>")
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(doubles, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers: by float64 where no sum can leave its range."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


NONE = -((1 << 63) - 1)  # a score below all others


def _merged(ids: np.ndarray, scores: np.ndarray, more_ids: np.ndarray, more: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line of two tables of candidates, ties to smaller ids."""
    ids, scores = np.concatenate([ids, more_ids], axis=1), np.concatenate([scores, more], axis=1)
    keep = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, keep, axis=1), np.take_along_axis(scores, keep, axis=1)


def known_bounds(queries: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """A score that each query's k-th best reaches for sure: its k-th best among the other queries of
    the batch, which are candidates too."""
    q_ids, q = queries
    if len(q_ids) <= k:
        return np.full(len(q_ids), NONE, dtype=np.int64)
    scores = np.where(q_ids[:, None] == q_ids[None, :], NONE, _products(q, q))
    return np.partition(scores, len(q_ids) - k, axis=1)[:, len(q_ids) - k]


def search(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int, floor: np.ndarray | None = None,
           scored: list | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, ids, scores) of the k best rows per query, best first, those below its ``floor`` left out.

    ``scored``: gets the number of (query, block) pairs that were scored, and of all.
    """
    q_ids, q = queries
    order = np.argsort(rows[0], kind="stable")
    ids, matrix = rows[0][order], rows[1][order]
    firsts = np.arange(0, len(ids), BLOCK_ROWS)
    most, least = np.maximum.reduceat(matrix, firsts), np.minimum.reduceat(matrix, firsts)
    bounds = _products(np.maximum(q, 0), most) + _products(np.minimum(q, 0), least)
    turn = np.argsort(-bounds, axis=1, kind="stable")
    floor = np.full(len(q_ids), NONE, dtype=np.int64) if floor is None else floor
    best_ids = np.full((len(q_ids), k), np.iinfo(np.int64).max)
    best = np.full((len(q_ids), k), NONE)
    active, n_scored = np.arange(len(q_ids)), 0
    for r in range(len(firsts)):  # each query's r-th block; queries that take the same one are scored together
        bound = bounds[active, turn[active, r]]
        active = active[bound >= np.maximum(best[active, -1], floor[active])]
        if not len(active):
            break
        n_scored += len(active)
        blocks = turn[active, r]
        for b in np.unique(blocks):
            at, some = slice(int(firsts[b]), int(firsts[b]) + BLOCK_ROWS), active[blocks == b]
            scores = _products(q[some], matrix[at])
            scores[q_ids[some][:, None] == ids[at][None, :]] = NONE
            best_ids[some], best[some] = _merged(best_ids[some], best[some], np.broadcast_to(ids[at], scores.shape), scores, k)
    if scored is not None:
        scored.append((n_scored, len(q_ids) * len(firsts)))
    for i in range(len(q_ids)):
        found = (best[i] != NONE) & (best[i] >= floor[i])
        yield i, best_ids[i][found], best[i][found]


def top_k(vectors: DataFrame, k: int = 10, query_step: int = 100, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query, a row whose id divides by ``query_step``."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), quantised(vectors[vector_col], scale).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = written(rows.select("id", "v", F.size("v").alias("dim")), "vectors")
    dims = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"),
                                   F.count_if(F.col("id") % query_step == 0).alias("n_queries"))
    # groups are id ranges, so that blocks are ranges of the table; a crowded range is split by hash
    span = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) * GROUP_ROWS / F.col("n"))).cast("long")
    dims = dims.select("dim", "low", span.alias("span"), F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("lanes"),
                       F.greatest(F.lit(1), F.ceil(F.col("n_queries") / BATCH_QUERIES)).alias("n_batches"))
    # a row for each vector length there is: a small broadcast
    dims = F.broadcast(dims)
    placed = rows.join(dims, "dim").withColumn("slice", F.floor((F.col("id") - F.col("low")) / F.col("span")))
    crowd = placed.groupBy("dim", "slice").agg(F.ceil(F.count(F.lit(1)) / (2 * GROUP_ROWS)).alias("parts"))
    grouped = (placed.join(crowd, ["dim", "slice"])
               .withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")))
               .groupBy("dim", "lanes", "slice", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
               .select("dim", F.pmod(F.xxhash64("slice", "part"), F.col("lanes").cast("long")).alias("lane"), "rows"))
    asked = (rows.where(F.col("id") % query_step == 0).distinct().join(dims.select("dim", "n_batches", "lanes"), "dim")
             .withColumn("batch", F.pmod(F.xxhash64("id"), F.col("n_batches")))
             .groupBy("dim", "lanes", "batch").agg(F.collect_list(F.struct("id", "v")).alias("queries")))
    # every batch goes to every lane, each group to one: the pairs spread over as many keys as there are groups
    asked = asked.select("dim", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes").cast("long") - 1)).alias("lane"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = []
                for name in ("queries", "rows"):
                    cells = batch.column(name).slice(row, 1).flatten()
                    sides.append((cells.field("id").to_numpy(zero_copy_only=False), _matrix(cells.field("v"))))
                queries, found = sides[0], list(search(sides[0], sides[1], k, known_bounds(sides[0], k)))
                counts = [len(ids) for _, ids, _ in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([int(queries[0][i]) for i, _, _ in found], counts), pa.int64()),
                    pa.array(np.repeat([i for i, _, _ in found], counts), pa.int64()),
                    pa.array(np.concatenate([ids for _, ids, _ in found]), pa.int64()),
                    pa.array(np.concatenate([s for _, _, s in found]), pa.int64()),
                ], names=["query_id", "nth", "vec_id", "score"])

    # merged: Spark knows the queries' size before they go to every lane only, and would broadcast what is that many times as large
    pairs = asked.hint("merge").join(grouped, ["dim", "lane"])
    met = pairs.select("queries", "rows").mapInArrow(scored, "query_id long, nth long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))


def oracle() -> str:
    return """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score
      from (select distinct * from v where vec_id % 100 = 0) q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 10"""

"""Exact top-k search: columnar branch and bound over blocks of vectors held dimension by dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudweave.llm import common

#: Candidates, and queries, that one task holds at a time; dimensions between two prunings.
CANDIDATES, QUERIES, STEP = 8192, 2048, 8
#: A score is ranked as top * 2**126 + high * 2**63 + low.
_OUT = "row long, query_id long, vec_id long, top long, high long, low long"


def floor_256(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double; null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vertical layout: a row for each dimension; short vectors end in zeros."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == dims).all():
        return np.ascontiguousarray(flat.reshape(-1, dims).T)
    out, at = np.zeros((dims, len(lengths)), np.int64), 0
    for i, n in enumerate(lengths):
        out[:n, i] = flat[at : at + n]
        at += n
    return out


def branch_and_bound(q: np.ndarray, live: np.ndarray, x: np.ndarray, rest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k best of the columns live of x for q (more on ties, all if fewer).

    After each block of dimensions a candidate stays only if its partial sum and the most that the remaining
    mass can add reach the k-th best of what the candidates have for certain. rest[b] holds the norms of the
    candidates' components from block b on.
    """
    dims = len(q)
    sums = np.zeros(len(live), q.dtype)
    exact = q.dtype == np.int64
    for b, at in enumerate(range(0, dims, STEP)):
        block = x[at : at + STEP]
        sums = sums + (q[at : at + STEP] @ (block if len(live) == x.shape[1] else block[:, live]))
        if at + STEP >= dims or len(live) <= k:
            continue
        q_rest = np.sqrt(float((q[at + STEP :].astype(np.float64) ** 2).sum()))
        room = q_rest * rest[b + 1][live]
        low = sums - room
        least = np.partition(low, len(low) - k)[len(low) - k]
        keep = sums + room >= least - (1e-9 * abs(least) + 1e-6 if not exact else 1e-6 * (abs(least) + 1))
        if not keep.all():
            live, sums = live[keep], sums[keep]
    if len(live) > k:
        best = np.partition(sums, len(sums) - k)[len(sums) - k]
        live, sums = live[sums >= best], sums[sums >= best]
    return live, sums


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of greatest integer inner product for each query vector.

    Queries and candidates meet block by block, in as many tasks as there are pairs of blocks; each query keeps
    k rows of a block, and one window over (queries x blocks x k) rows ranks them. Ties go to the smaller id.
    Null vectors, and those with null or non-finite components, take no part; nor does a null id. Vectors of
    unlike length are compared as if the shorter ended in zeros. Every row is a vector of its own: rows of one id are
    queries each, and candidates for each other. An empty table gives no rows. Components beyond 64 bits are held at their ends. Where a
    candidate's sum may not fit 64 bits it is made of integers without limit, and ranks by them; a score that does not fit is null.
    """
    v = vectors.select(F.col(id_column).cast("long").alias("vec_id"), floor_256(F.col(vector_column)).alias("v"), is_query.alias("q")).where("vec_id is not null and v is not null")
    v = common.materialize(v.withColumn("row", F.monotonically_increasing_id()))
    n, n_queries, dims = v.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).head()
    blocks, query_blocks = max(1, -(-n // candidates)), max(1, -(-n_queries // queries))
    dims = max(1, dims or 1)
    left = v.where("q").withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(query_blocks))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("qb", "b", "row", "vec_id", "v")
    right = v.select("row", "vec_id", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("b"))
    right = right.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).select(F.col("qb").cast("long").alias("qb"), "b", "row", "vec_id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            qs, q_ids, q_rows = _matrix(left.column("v"), dims), left.column("vec_id").to_numpy(), left.column("row").to_numpy()
            whole, ids, rows = _matrix(right.column("v"), dims), right.column("vec_id").to_numpy(), right.column("row").to_numpy()
            q_most, x_most = (np.abs(m.astype(np.float64)).max(0, initial=0) for m in (qs, whole))
            small = q_most.max(initial=0) * x_most.max(initial=0) * dims < 2**53
            kind = np.float64 if small else np.int64  # then doubles are exact, and much faster
            qs, x = qs.astype(kind), whole.astype(kind)
            squares = np.array([(x[a : a + STEP].astype(np.float64) ** 2).sum(0) for a in range(0, dims, STEP)])
            rest = np.sqrt(np.cumsum(squares[::-1], 0)[::-1])
            for j, q_row in enumerate(q_rows):
                wide = np.zeros(len(ids), bool) if small else q_most[j] * x_most * dims >= 2**62
                q = np.ascontiguousarray(qs[:, j])
                live, sums = branch_and_bound(q, np.flatnonzero((rows != q_row) & ~wide), x, rest, k)
                scores = [int(s) for s in sums]
                if wide.any():
                    more = np.flatnonzero(wide & (rows != q_row))
                    scores += [sum(a * b for a, b in zip(q.tolist(), c, strict=True)) for c in x[:, more].T.tolist()]
                    live = np.concatenate([live, more])
                order = sorted(range(len(live)), key=lambda i: (-scores[i], ids[live[i]]))[:k]
                best = [scores[i] for i in order]
                digits = [np.array([s >> 63 * i if i == 2 else s >> 63 * i & (2**63 - 1) for s in best], np.int64) for i in (2, 1, 0)]
                found.append((np.full(len(order), q_row), np.full(len(order), q_ids[j]), ids[live[order]], *digits))
        parts = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (list(zip(*found, strict=True)) or [[]] * 6)]
        return pa.table({n: pa.array(p.astype(np.int64)) for n, p in zip(("row", "query_id", "vec_id", "top", "high", "low"), parts, strict=True)})

    near = left.groupBy("qb", "b").cogroup(right.groupBy("qb", "b")).applyInArrow(search, _OUT)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("top"), F.desc("high"), F.desc("low"), "vec_id")))
    least = F.lit(-(2**63)).cast("long")
    score = F.when((F.col("top") == 0) & (F.col("high") == 0), F.col("low")).when((F.col("top") == -1) & (F.col("high") == 2**63 - 1), F.col("low") + least)
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))

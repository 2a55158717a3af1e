"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.llm.common import discard, materialize


#: Edges that a task contracts at a time.
HELD = 1 << 19


def contract(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Edges from each id to the smallest that the edges of this run reach: the same components, shorter paths."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        up = np.arange(len(ids))
        x, y = at[: len(a)], at[len(a) :]
        while True:  # pull both ends to the lesser root, then shorten all paths
            np.minimum.at(up, np.maximum(up[x], up[y]), np.minimum(up[x], up[y]))
            while not np.array_equal(jumped := up[up], up):
                up = jumped
            if (up[x] == up[y]).all():
                break
        off = np.flatnonzero(up != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[off]), pa.array(ids[up[off]])], names=["a", "b"])

    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        size += batch.num_rows
        if size >= most:
            yield stars(*np.concatenate(held, 1))
            held, size = [], 0
    if size:
        yield stars(*np.concatenate(held, 1))


def _digest(e: DataFrame) -> tuple:
    """The number of edges and the sum of their hashes: equal for equal tables."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """(id, component) of every id in edges (a, b); component is the smallest id that links reach.

    Tasks first contract the edges they read. Each step after that is a minimum by id and a join; nothing gathers a neighbourhood, so an id of any degree is fine.
    Steps end when a pass changes no edge; their number grows with the logarithm of the longest path.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    e = materialize(e.mapInArrow(lambda batches: contract(batches, held), "a long, b long"))
    seen = _digest(e)
    while True:
        before = e
        # large star: each neighbour above u points to the least of u's neighbourhood
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its neighbours below point to the least of them
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = materialize(e.select("e.a", "e.b").where("a <> b").distinct())
        discard(before)
        now = _digest(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return roots.union(e.select("b", "b")).groupBy("id").agg(F.min("component").alias("component"))

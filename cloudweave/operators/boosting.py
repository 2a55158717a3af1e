"""Boosted trees for any number of classes: softmax loss, a tree for each class and iteration, splits from histograms.

Values are put into bins once. A level of all classes' trees is one pass: tasks add up gradients, hessians and counts by (class, node,
feature, bin), the sums meet by class and group of features, and the best split of each is found there. So what reaches the
driver is a split for each node; rows never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features whose sums meet in one task; iterations after which the scores so far are kept with the rows.
CHUNK, REFRESH = 64, 20
_SPLIT = "k int, node int, gain double, feature int, bin int, gl double, hl double, nl double, g double, h double, n double"


@dataclass
class Tree:
    """Complete to its depth: node i splits into 2 i + 1 and 2 i + 2; a node that is not split sends all left, and its leaves share a value."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        return cls(np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, 255, np.int32), np.zeros(2**depth))

    def node(self, binned: np.ndarray, level: int) -> np.ndarray:
        """Each row's node, counted within the level."""
        at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(level):
            at = 2 * at + 1 + (binned[rows, self.feature[at]] > self.bin[at])
        return at - (2**level - 1)

    def scores(self, binned: np.ndarray) -> np.ndarray:
        return self.value[self.node(binned, len(self.value).bit_length() - 1)]


def gains(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: int, l2: float) -> np.ndarray:
    """What a split behind each bin (last axis) lowers the loss by; -inf where a side has too little."""
    gl, hl, nl = (np.cumsum(x, -1) for x in (g, h, n))
    gt, ht, nt = gl[..., -1:], hl[..., -1:], nl[..., -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        found = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
    return np.where((nl >= least) & (nt - nl >= least) & (hl >= 1e-3) & (ht - hl >= 1e-3), found, -np.inf)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The number of a feature's cuts below each value."""
    return np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1).astype(np.uint8) if len(cuts) else np.zeros((len(x), 0), np.uint8)


@dataclass
class BoostedModel:
    cuts: list[np.ndarray]
    first: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = np.tile(self.first, (len(rows), 1))
        for trees in self.rounds:
            out += np.stack([t.scores(rows) for t in trees], 1)
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with probability (a vector over the classes' indices) and prediction (an index, the lowest on ties)."""

        def run(x: pd.Series) -> pd.Series:
            values = np.stack(x.map(np.asarray).to_list()).astype(float) if len(x) else np.zeros((0, len(self.cuts)))
            return pd.Series(list(softmax(self.scores(binned(values, self.cuts)))))

        scored = rows.withColumn("_p", F.pandas_udf(run, "array<double>")(vector_to_array("features")))
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return scored.withColumn("prediction", best).withColumn("probability", array_to_vector("_p")).drop("_p")


@dataclass(frozen=True)
class BoostedTrees:
    """An estimator as evaluate.Classifier takes it: rows have _index (a class's place) and features (a vector)."""

    iterations: int = 100
    depth: int = 3
    rate: float = 0.1
    bins: int = 255
    least: int = 20
    l2: float = 0.0

    def fit(self, rows: DataFrame) -> BoostedModel:
        table = rows.select(F.col("_index").cast("int").alias("y"), vector_to_array("features").alias("x"))
        dims, classes = table.agg(F.max(F.size("x")), F.max("y") + 1).head()
        quantiles = ",".join(f"{i}/{self.bins}D" for i in range(1, self.bins))
        found = table.select(F.posexplode("x").alias("slot", "v")).groupBy("slot").agg(F.expr(f"array_distinct(approx_percentile(v, array({quantiles}), 10000))").alias("c")).collect()
        cuts = [np.array(c) for _, c in sorted((r.slot, r.c) for r in found)]
        counts = dict(table.groupBy("y").count().collect())
        share = np.array([counts.get(k, 0) for k in range(classes)], float) / sum(counts.values())
        model = BoostedModel(cuts, np.log(np.maximum(share, 1e-10)))
        state = self._state(table, cuts, model.first).persist()
        fresh: list[list[Tree]] = []
        for i in range(self.iterations):
            trees = self._round(state, fresh, dims, classes)
            model.rounds.append(trees)
            fresh.append(trees)
            if len(fresh) == REFRESH and i + 1 < self.iterations:
                state, old, fresh = self._scored(state, fresh, dims, classes).persist(), state, []
                state.count()  # before the one it is made of goes
                old.unpersist()
        state.unpersist()
        return model

    def _state(self, table: DataFrame, cuts: list[np.ndarray], first: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, len(cuts)))
                rows, start = binned(x, cuts), first.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([start] * n, pa.binary())], names=["y", "b", "s"])

        return table.mapInArrow(run, "y int, b binary, s binary")

    @staticmethod
    def _read(batch: pa.RecordBatch, rounds: list[list[Tree]], dims: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels, bins and scores of a batch."""
        n = batch.num_rows
        rows = np.frombuffer(b"".join(batch.column("b").to_pylist()), np.uint8).reshape(n, dims)
        scores = np.frombuffer(b"".join(batch.column("s").to_pylist())).reshape(n, classes).copy()
        for trees in rounds:
            scores += np.stack([t.scores(rows) for t in trees], 1)
        return batch.column("y").to_numpy(), rows, scores

    def _scored(self, state: DataFrame, rounds: list[list[Tree]], dims: int, classes: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, _, scores = self._read(batch, rounds, dims, classes)
                yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("b"), pa.array([s.tobytes() for s in scores], pa.binary())], names=["y", "b", "s"])

        return state.mapInArrow(run, "y int, b binary, s binary")

    def _round(self, state: DataFrame, rounds: list[list[Tree]], dims: int, classes: int) -> list[Tree]:
        """The next tree of every class, level by level."""
        trees = [Tree.empty(self.depth) for _ in range(classes)]
        leaf: dict[tuple[int, int], float] = {}  # of nodes of the level that are not split further
        for level in range(self.depth):
            width, base = 2**level, 2**level - 1
            best: dict[tuple[int, int], tuple] = {}
            for r in self._splits(state, rounds, trees, level, dims, classes).collect():
                key = (r.k, r.node)
                if key not in best or (-r.gain, r.feature, r.bin) < (-best[key].gain, best[key].feature, best[key].bin):
                    best[key] = r
            held, leaf = leaf, {}
            for k in range(classes):
                for node in range(width):
                    r = best.get((k, node))
                    if (k, node) in held or r is None:
                        leaf[k, 2 * node] = leaf[k, 2 * node + 1] = held.get((k, node), 0.0)
                    elif not r.gain > 0:
                        leaf[k, 2 * node] = leaf[k, 2 * node + 1] = -self.rate * r.g / (r.h + self.l2) if r.h + self.l2 > 0 else 0.0
                    else:
                        trees[k].feature[base + node], trees[k].bin[base + node] = r.feature, r.bin
                        for side, g, h in ((0, r.gl, r.hl), (1, r.g - r.gl, r.h - r.hl)):
                            trees[k].value[(2 * node + side) * 2 ** (self.depth - level - 1)] = -self.rate * g / (h + self.l2)
            if level + 1 == self.depth:
                for (k, node), v in leaf.items():
                    trees[k].value[node] = v
        return trees

    def _splits(self, state: DataFrame, rounds: list[list[Tree]], trees: list[Tree], level: int, dims: int, classes: int) -> DataFrame:
        bins, width, depth = self.bins, 2**level, level
        least, l2 = self.least, self.l2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((classes, dims, 3, width * bins))
            for batch in batches:
                if not batch.num_rows:
                    continue
                y, rows, scores = self._read(batch, rounds, dims, classes)
                p = softmax(scores)
                for k in range(classes):
                    node = trees[k].node(rows, depth) * bins
                    g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])
                    for f in range(dims):
                        at = node + rows[:, f]
                        for i, w in enumerate((g, h, None)):
                            total[k, f, i] += np.bincount(at, w, width * bins)
            starts = range(0, dims, CHUNK)
            keys = [(k, a) for k in range(classes) for a in starts]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([a for _, a in keys], pa.int32()), pa.array([total[k, a : a + CHUNK].tobytes() for k, a in keys], pa.binary())], names=["k", "a", "m"])

        def best(part: pa.Table) -> pa.Table:
            k, a = part.column("k")[0].as_py(), part.column("a")[0].as_py()
            m = sum(np.frombuffer(x.as_buffer()) for c in part.column("m").chunks for x in c).reshape(-1, 3, width, bins)
            g, h, n = m[:, 0], m[:, 1], m[:, 2]
            found = gains(g, h, n, least, l2)
            out = []
            for node in range(width):
                f, b = np.unravel_index(found[:, node].argmax(), found[:, node].shape)
                sums = [x[f, node, : b + 1].sum() for x in (g, h, n)] + [x[0, node].sum() for x in (g, h, n)]
                out.append((k, node, found[f, node, b], a + f, b, *sums))
            return pa.Table.from_pandas(pd.DataFrame(out, columns=[c.split()[0] for c in _SPLIT.split(", ")]).astype({"k": "int32", "node": "int32", "feature": "int32", "bin": "int32"}), preserve_index=False)

        return state.mapInArrow(run, "k int, a int, m binary").groupBy("k", "a").applyInArrow(best, _SPLIT)

"""How much of a feature block another block explains: out-of-sample R2, canonical correlations, permutation nulls.

Rows are (row_id, x array<double>, y array<double>): a block and its partner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudweave.operators.evaluate import folds
from cloudweave.operators.ordering import md5_of, ranked


def n_splits(n: int) -> int:
    return max(2, min(5, n // 4))


def assign_folds(rows: DataFrame, seed: int, key: str = "row_id") -> DataFrame:
    return folds(rows, n_splits(rows.count()), seed, key)


def standardised(rows: DataFrame, column: str) -> DataFrame:
    """(row_id, fold, slot, value, z) for every fold: z by the mean and population deviation of the other folds.

    Sums by (fold, slot) are made once; those of a fold's complement are the totals less its own. A slot without
    spread has scale 1.
    """
    long = rows.select("row_id", "fold", F.posexplode(column).alias("slot", "value"))
    own = long.groupBy("slot", "fold").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    total = own.groupBy("slot").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    rest = own.join(total, "slot").select("slot", "fold", (F.col("tn") - F.col("n")).alias("n"), (F.col("ts") - F.col("s")).alias("s"), (F.col("tq") - F.col("q")).alias("q"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    scale = rest.select("slot", "fold", mean.alias("mean"), F.when(spread > 1e-12, spread).otherwise(1.0).alias("scale"))
    return long.join(scale, ["slot", "fold"]).withColumn("z", (F.col("value") - F.col("mean")) / F.col("scale"))


def capped_pca(rows: DataFrame, column: str, train: Column | None = None, most: int = 20) -> DataFrame:
    """rows with column reduced to its principal components where it is wider than min(n - 2, width, most).

    Components, and n, are those of the rows where train holds (all, if it is not given).
    """
    fitted = rows if train is None else rows.where(train)
    width, n = rows.select(F.size(column)).head()[0], fitted.count()
    cap = max(1, min(n - 2, width, most))
    if width <= cap:
        return rows
    vectors = lambda t: t.withColumn("_v", array_to_vector(column))
    return PCA(k=cap, inputCol="_v", outputCol="_o").fit(vectors(fitted)).transform(vectors(rows)).withColumn(column, vector_to_array("_o")).drop("_v", "_o")


#: Rows whose products one task adds up before sums meet.
PART = 100_000


def _moments(rows: DataFrame, n: int) -> DataFrame:
    """(replicate, fold, m): the sums of products of (1, x, y), a square matrix of bytes, of each replicate and fold.

    Rows come sorted by replicate and fold in parts of about PART, so that a task holds one matrix at a time, however wide the blocks and many the replicates.
    """
    keys = ["replicate", "fold"]
    rows = rows if "replicate" in rows.columns else rows.withColumn("replicate", F.lit(0))
    dealt = rows.select(*(F.col(k).cast("int").alias(k) for k in keys), F.pmod(F.xxhash64("row_id"), F.lit(max(1, n // PART))).cast("int").alias("part"), "x", "y")
    dealt = dealt.repartition(*keys, "part").sortWithinPartitions(*keys, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda key, m: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=[*keys, "m"])
        held, total = None, None
        for batch in batches:
            where = np.stack([batch.column(k).to_numpy() for k in (*keys, "part")], 1)
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(where), -1) if len(where) else np.zeros((0, 0)) for c in ("x", "y"))
            for a, b in _runs(where):
                m = np.column_stack([np.ones(b - a), x[a:b], y[a:b]])
                key = tuple(where[a].tolist())
                if held is not None and key != held:
                    yield row(held, total)
                    total = None
                held, total = key, m.T @ m if total is None else total + m.T @ m
        if held is not None:
            yield row(held, total)

    def summed(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m.as_buffer()) for c in part.column("m").chunks for m in c)
        return part.slice(0, 1).set_column(2, "m", pa.array([total.tobytes()], pa.binary()))

    return dealt.mapInArrow(run, "replicate int, fold int, m binary").groupBy(*keys).applyInArrow(summed, "replicate int, fold int, m binary")


def _runs(where: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of equal rows."""
    if not len(where):
        return []
    cuts = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)], strict=True))


def _solved(rows: DataFrame, of: Callable[[dict[int, np.ndarray]], list[float]]) -> DataFrame:
    """(replicate, slot, value): of(sums by fold) of every replicate, each solved in its own task. Numbers alone leave the executors."""

    def solve(part: pa.Table) -> pa.Table:
        sums = {}
        for f, m in zip(part.column("fold").to_pylist(), part.column("m").to_pylist(), strict=True):
            side = int(round((len(m) // 8) ** 0.5))
            sums[f] = np.frombuffer(m).reshape(side, side)
        found = of(sums)
        return pa.table({"replicate": pa.array([part.column("replicate")[0].as_py()] * len(found), pa.int32()), "slot": pa.array(range(len(found)), pa.int32()), "value": pa.array(found, pa.float64())})

    return _moments(rows, rows.count()).groupBy("replicate").applyInArrow(solve, "replicate int, slot int, value double")


def _train(sums: dict[int, np.ndarray], fold: int) -> np.ndarray:
    return sum(m for f, m in sums.items() if f != fold)


def _standard(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and the correlation-like matrix of standardised columns."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale < 1e-12] = 1
    return mean, scale, cov / np.outer(scale, scale)


def _axes(c: np.ndarray, n: float, most: int = 20) -> np.ndarray:
    """The leading principal axes of standardised columns where there are more than min(n - 2, most), else all columns."""
    cap = max(1, min(int(n) - 2, len(c), most))
    return np.eye(len(c)) if len(c) <= cap else np.linalg.eigh(c)[1][:, ::-1][:, :cap]


def _r2(sums: dict[int, np.ndarray], p: int, alpha: float = 1.0) -> np.ndarray:
    """Out-of-sample R2 of each column of x. The held-out errors follow from the fold's own sums of products."""
    rest = np.zeros(p)
    for f, own in sums.items():
        m = _train(sums, f)
        mean, scale, c = _standard(m)
        n = m[0, 0]
        v = _axes(c[p:, p:], n)
        beta = np.linalg.solve(v.T @ c[p:, p:] @ v + alpha / n * np.eye(v.shape[1]), v.T @ c[p:, :p]) * scale[:p]
        b = v / scale[p:, None] @ beta
        error = np.concatenate([-(mean[:p] - mean[p:] @ b)[None], np.eye(p), -b])
        rest += np.einsum("ij,ik,kj->j", error, own, error)
    total = sum(sums.values())
    n = total[0, 0]
    spread = np.diag(total)[1 : p + 1] - total[0, 1 : p + 1] ** 2 / n
    return np.clip(np.where(spread > 1e-12, 1 - rest / np.where(spread > 1e-12, spread, 1), 0.0), 0, 1)


def _rho(sums: dict[int, np.ndarray], p: int, most: int = 5) -> float:
    """Mean absolute held-out correlation of the canonical pairs fitted on the other folds; 0 if there are none."""
    found = []
    for f, own in sums.items():
        m = _train(sums, f)
        _, scale, c = _standard(m)
        n = m[0, 0]
        vx, vy = _axes(c[:p, :p], n), _axes(c[p:, p:], n)
        a, b = (v.T @ x @ v + 1e-8 * np.eye(v.shape[1]) for v, x in ((vx, c[:p, :p]), (vy, c[p:, p:])))
        k = min(most, len(a), len(b), int(n) - 1)
        if k < 1:
            continue
        wa, wb = np.linalg.cholesky(np.linalg.inv(a)), np.linalg.cholesky(np.linalg.inv(b))
        u, _, v = np.linalg.svd(wa.T @ vx.T @ c[:p, p:] @ vy @ wb)
        u, v = vx @ wa @ u[:, :k] / scale[:p, None], vy @ wb @ v.T[:, :k] / scale[p:, None]
        # The held-out correlation follows from the fold's own sums.
        mean = own[0, 1:] / own[0, 0]
        cov = own[1:, 1:] / own[0, 0] - np.outer(mean, mean)
        top = np.einsum("ik,ij,jk->k", u, cov[:p, p:], v)
        low = np.einsum("ik,ij,jk->k", u, cov[:p, :p], u) * np.einsum("ik,ij,jk->k", v, cov[p:, p:], v)
        found += [abs(t) / np.sqrt(d) for t, d in zip(top, low, strict=True) if d > 1e-24]
    return float(np.mean(found)) if found else 0.0


def _width(rows: DataFrame) -> int:
    return rows.select(F.size("x")).head()[0]


def explained_r2(rows: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(slot, r2): for each column of x, how well a ridge on y predicts it out of sample, within 0 and 1.

    rows need fold. y is standardised, and reduced to its principal axes if it is wide, by the other folds. Sums of
    products are made on the executors; the solve is of the blocks' width.
    """
    p = _width(rows)
    return _solved(rows, lambda sums: _r2(sums, p, alpha).tolist()).select("slot", F.col("value").alias("r2"))


def canonical_correlation(rows: DataFrame, most: int = 5) -> float:
    """Mean absolute held-out correlation of the canonical pairs fitted on the other folds; 0 if there are none."""
    p = _width(rows)
    return _solved(rows, lambda sums: [_rho(sums, p, most)]).head()["value"]


#: Metrics of dependence by name: one number for a block and its partner, larger for more.
METRICS = {"r2": lambda sums, p: float(_r2(sums, p).mean()), "cca": _rho}


def permuted(rows: DataFrame, repeats: int, seed: int, key: str = "row_id") -> DataFrame:
    """rows with replicate: in replicate r > 0 the partner y is that of another row, by md5 order; 0 is as observed.

    Places are given to ids alone, in parts of a replicate; the arrays are joined to them afterwards.
    """
    at = ranked(rows.select(key), md5_of(seed, F.lit("at"), key), key, name="_at")
    grid = rows.select(F.col(key).alias("_donor"), F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("replicate"))
    drawn = ranked(grid, md5_of(seed, "replicate", "_donor"), "_donor", "replicate", name="_at")
    pairs = at.join(drawn, "_at").select(key, "replicate", "_donor")
    null = rows.drop("y").join(pairs, key).join(rows.select(F.col(key).alias("_donor"), "y"), "_donor")
    return rows.withColumn("replicate", F.lit(0)).unionByName(null.select(*rows.columns, "replicate"))


def null_values(rows: DataFrame, metric: str, repeats: int, seed: int) -> DataFrame:
    """(replicate, value) of a metric of METRICS: as observed (0) and under permutations of the partner. rows need fold."""
    p, of = _width(rows), METRICS[metric]
    return _solved(permuted(rows, repeats, seed), lambda sums: [of(sums, p)]).select("replicate", "value")


def p_value(statistics: DataFrame, *group: str) -> DataFrame:
    """group, value, null_mean, p_value from (group, replicate, value); replicate 0 is the observed one."""
    observed = statistics.where("replicate = 0").select(*group, F.col("value").alias("observed"))
    null = statistics.where("replicate > 0")
    if not group:  # one observed row
        observed, null = observed.withColumn("_all", F.lit(0)), null.withColumn("_all", F.lit(0))
    joined = null.join(observed, list(group) or ["_all"])
    out = joined.groupBy(*group, "observed").agg(F.avg("value").alias("null_mean"), F.count("*").alias("n"), F.count_if(F.col("value") >= F.col("observed")).alias("above"))
    return out.select(*group, F.col("observed").alias("value"), "null_mean", ((1 + F.col("above")) / (1 + F.col("n"))).alias("p_value"))


def over_seeds(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Mean value, mean null and median p-value over seeds, by dataset, block, partner and metric, sorted."""
    keys = ["dataset", "block", "partner", "metric"]
    out = rows.groupBy(*keys).agg(F.round(F.avg("value"), digits).alias("value"), F.round(F.avg("null_mean"), digits).alias("null_mean"), F.round(F.median("p_value"), digits).alias("p_value"))
    return out.orderBy(*keys)

"""Delay embedding, its limits and search, PCA, cloud budgets and cleaning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudweave.functions import kernels


def n_points(length: int | Column, tau: int, m: int, stride: int):
    """Points of an embedding that starts at index 0."""
    if isinstance(length, Column):
        return (F.floor((length - (m - 1) * tau - 1) / stride) + 1).cast("int")
    return (length - (m - 1) * tau - 1) // stride + 1


def delay_points(values: str | Column, tau: int, m: int, stride: int) -> Column:
    """The embedding as an array of points: (x[i s], x[i s + tau], ...). Stays in the row: no shuffle, no explode."""
    values = F.col(values) if isinstance(values, str) else values
    count = n_points(F.size(values), tau, m, stride)
    point = lambda i: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.get(values, i * stride + j * tau))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), point)).otherwise(F.array().cast("array<array<double>>"))


def embed(series: DataFrame, tau: int, m: int, stride: int) -> DataFrame:
    """(series_id, label, points) of each series."""
    return series.select("series_id", "label", delay_points("values", tau, m, stride).alias("points"))


def cap_embedding(length: int, tau: int, m: int, stride: int, min_points: int = 5) -> tuple[int, int, int]:
    """The largest (tau, m, stride) not above the given that fits the series.

    Stride is lowered last, then m, tau first; the first sweep asks for min_points points (counted as
    (length - span) // stride), the second only that the span fits. ValueError if nothing fits.
    """
    grid = [(t, d, s) for s in range(stride, 0, -1) for d in range(m, 0, -1) for t in range(tau, 0, -1)]
    for least in (min_points, None):
        for t, d, s in grid:
            span = (d - 1) * t + 1
            if span <= length and (least is None or (length - span) // s >= least):
                return t, d, s
    raise ValueError(f"a series of {length} values cannot be embedded")


def cap_grid(lengths: DataFrame, tau: int, m: int, stride: int, min_points: int = 5) -> DataFrame:
    """The same as rows: (length, tau, m, stride) for each distinct length of a table."""
    down = lambda n: F.explode(F.sequence(F.lit(n), F.lit(1), F.lit(-1)))
    grid = lengths.select("length").distinct().withColumn("s", down(stride)).withColumn("d", down(m)).withColumn("t", down(tau))
    span = (F.col("d") - 1) * F.col("t") + 1
    points = F.floor((F.col("length") - span) / F.col("s"))
    fits = grid.where(span <= F.col("length")).withColumn("enough", (points >= min_points).cast("int"))
    best = fits.groupBy("length").agg(F.max(F.struct("enough", F.col("s"), F.col("d"), F.col("t"))).alias("b"))
    return best.select("length", F.col("b.t").alias("tau"), F.col("b.d").alias("m"), F.col("b.s").alias("stride"))


def search_caps(length: int, max_tau: int, max_m: int, stride: int) -> tuple[int, int]:
    """Bounds of the search: neighbours are tried in up to two dimensions more, which must fit too. m is lowered first, to 2, then tau."""
    fits = lambda t, d: d + 2 <= (length - 1 - stride) // t + 1
    tau = max(1, max_tau)
    for d in range(max(2, max_m), 1, -1):
        if fits(tau, d):
            return tau, d
    return next((t for t in range(tau - 1, 0, -1) if fits(t, 2)), 1), 2


def search(series: DataFrame, max_tau: int, max_m: int, stride: int = 1, sample: int | None = 5, seed: int = 0) -> tuple[int, int, int]:
    """(tau, m, stride) from a sample of series, or all of them if it is None: medians of each one's first minimum of mutual information and of the
    dimension at which false neighbours end, capped so that they fit."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [kernels.embedding_parameters(np.asarray(v, float), max_tau, max_m) for v in batch["values"]]
            yield pd.DataFrame(found, columns=["tau", "m"])

    length = series.agg(F.min(F.size("values"))).head()[0]
    max_tau, max_m = search_caps(length, max_tau, max_m, stride)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("series_id").cast("string")))
    chosen = series if sample is None else series.orderBy(order).limit(sample)
    row = chosen.select("values").mapInPandas(one, "tau int, m int").agg(F.median("tau"), F.median("m")).head()
    return cap_embedding(length, round(row[0]), round(row[1]), stride)


class Projection:
    """A PCA of all points of the training series, at most three components; projects centred points in the row."""

    def __init__(self, mean: list[float], components: list[list[float]]):
        self.mean, self.components = mean, components

    @classmethod
    def fit(cls, clouds: DataFrame, components: int = 3) -> Projection:
        """Exploded points feed the covariance only; what returns to the driver is m x m."""
        points = clouds.select(F.explode("points").alias("p"))
        m = clouds.select(F.size(F.get("points", F.lit(0)))).head()[0]
        means = list(points.agg(*(F.avg(F.get("p", F.lit(i))) for i in range(m))).head())
        model = PCA(k=min(components, m), inputCol="v", outputCol="o").fit(points.select(array_to_vector("p").alias("v")))
        return cls(means, model.pc.toArray().T.tolist())

    def __call__(self, points: str) -> Column:
        centred = lambda p: F.zip_with(p, F.array(*map(F.lit, self.mean)), lambda x, y: x - y)
        dot = lambda p, w: F.aggregate(F.zip_with(p, F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return F.transform(points, lambda p: F.array(*(dot(centred(p), w) for w in self.components)))

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.mean, self.components)], "mean array<double>, components array<array<double>>")


def cloud_budget(n: Column, fraction: float, least: int, most: int, small: int) -> Column:
    """Points that a cloud of n keeps: none of none, all below small, else a share (half to even) within limits."""
    share = F.least(F.greatest(F.bround(n * fraction, 0), F.lit(least)), F.lit(most)).cast("int")
    return F.when(n <= 0, 0).when(n < small, n).otherwise(share).cast("int")


def clean(value: Column, limit: float = 1e6) -> Column:
    """NaN and null become 0, infinities the limit of their sign."""
    return F.when(value.isNull() | F.isnan(value), 0.0).when(value == float("inf"), limit).when(value == float("-inf"), -limit).otherwise(value)



#: The kinds of datasets that count as dynamical.
DYNAMICAL = ("SENSOR", "MOTION", "ECG", "DEVICE", "EOG", "HEMODYNAMICS")


def dynamical(rows: DataFrame, dimension: DataFrame, kinds: tuple[str, ...] = DYNAMICAL) -> DataFrame:
    """rows with dataset_type (UNKNOWN if the dimension lacks it) and is_dynamical."""
    joined = rows.join(dimension.select("dataset", "dataset_type"), "dataset", "left")
    return joined.withColumn("dataset_type", F.coalesce("dataset_type", F.lit("UNKNOWN"))).withColumn("is_dynamical", F.col("dataset_type").isin(*kinds))


def block_features(features: DataFrame, meta: DataFrame, block: str) -> DataFrame:
    """Long features (series_id, feature, value) of one block."""
    return features.join(meta.where(F.col("block") == block).select("feature"), "feature")

"""Per-series baseline features: descriptive statistics, spectra, catch22, cloud statistics, path signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudweave.functions import catch22 as c22
from cloudweave.functions import dynamics as dyn
from cloudweave.functions import kernels


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _count(a: Column, f) -> Column:
    return F.size(F.filter(a, f)).cast("double")


def _longest(flags: Column) -> Column:
    """The longest run of true."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
    step = lambda s, f: F.struct(F.when(f, s["run"] + 1).otherwise(0).alias("run"), F.greatest(s["best"], F.when(f, s["run"] + 1).otherwise(0)).alias("best"))
    return F.aggregate(flags, start, step, lambda s: s["best"].cast("double"))


def descriptive(series: DataFrame, lags: tuple[int, ...] = (1, 2), sigma: float = 2.0) -> DataFrame:
    """series_id and the aggregate and lag features of each series.

    A stated subset of the published family. All are array functions over the row: no shuffle, no explode.
    """
    v, n = F.col("values"), F.col("n")
    base = series.select("series_id", "values", F.size("values").cast("double").alias("n")).withColumn("total", _sum(v)).withColumn("mean", F.col("total") / n)
    base = base.withColumn("sorted", F.array_sort(v))
    base = base.withColumn("m2", _sum(F.transform(v, lambda x: (x - F.col("mean")) * (x - F.col("mean"))))).withColumn("m3", _sum(F.transform(v, lambda x: F.pow(x - F.col("mean"), F.lit(3))))).withColumn("m4", _sum(F.transform(v, lambda x: F.pow(x - F.col("mean"), F.lit(4)))))
    diffs = F.zip_with(F.slice(v, F.lit(2), F.size(v) - 1), F.slice(v, F.lit(1), F.size(v) - 1), lambda a, b: a - b)
    base = base.withColumn("d", diffs)
    std = F.sqrt(F.col("m2") / n)

    def quantile(q: float) -> Column:
        at = (n - 1) * q
        low, high = F.get("sorted", F.floor(at).cast("int")), F.get("sorted", F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    def lagged(k: int, f) -> Column:
        size = F.size(v) - k
        return F.zip_with(F.slice(v, F.lit(1), size), F.slice(v, F.lit(k + 1), size), f)

    mean = F.col("mean")
    least, most = F.array_min(v), F.array_max(v)
    reverse = F.reverse(v)
    out = {
        "sum_values": F.col("total"), "abs_energy": _sum(F.transform(v, lambda x: x * x)), "mean": mean, "median": quantile(0.5), "variance": F.col("m2") / n, "standard_deviation": std,
        "skew": F.when(F.col("m2") > 0, F.col("m3") / n / F.pow(F.col("m2") / n, F.lit(1.5))).otherwise(0.0), "kurtosis": F.when(F.col("m2") > 0, n * F.col("m4") / (F.col("m2") * F.col("m2")) - 3).otherwise(0.0),
        "root_mean_square": F.sqrt(_sum(F.transform(v, lambda x: x * x)) / n), "minimum": least, "maximum": most, "quantile_10": quantile(0.1), "quantile_90": quantile(0.9),
        "mean_change": (F.get(v, F.size(v) - 1) - F.get(v, F.lit(0))) / (n - 1), "mean_abs_change": _sum(F.transform("d", F.abs)) / (n - 1), "abs_sum_changes": _sum(F.transform("d", F.abs)),
        "mean_second_derivative": (F.get(v, F.size(v) - 1) - F.get(v, F.size(v) - 2) - F.get(v, F.lit(1)) + F.get(v, F.lit(0))) / (2 * (n - 2)),
        "count_above_mean": _count(v, lambda x: x > mean), "count_below_mean": _count(v, lambda x: x < mean),
        "first_location_of_maximum": (F.array_position(v, most) - 1) / n, "first_location_of_minimum": (F.array_position(v, least) - 1) / n, "last_location_of_maximum": 1 - (F.array_position(reverse, most) - 1) / n, "last_location_of_minimum": 1 - (F.array_position(reverse, least) - 1) / n,
        "longest_strike_above_mean": _longest(F.transform(v, lambda x: x > mean)), "longest_strike_below_mean": _longest(F.transform(v, lambda x: x < mean)),
        "crossings_of_0": _count(lagged(1, lambda a, b: ((a > 0) != (b > 0)).cast("int")), lambda x: x == 1),
        "peaks": _count(F.zip_with(F.slice("d", F.lit(1), F.size("d") - 1), F.slice("d", F.lit(2), F.size("d") - 1), lambda a, b: ((a > 0) & (b < 0)).cast("int")), lambda x: x == 1),
        "cid_ce": F.sqrt(_sum(F.transform("d", lambda x: x * x))), "ratio_beyond_sigma": _count(v, lambda x: F.abs(x - mean) > sigma * std) / n,
        "has_duplicate_max": F.when(_count(v, lambda x: x == most) > 1, 1.0).otherwise(0.0), "has_duplicate_min": F.when(_count(v, lambda x: x == least) > 1, 1.0).otherwise(0.0), "has_duplicate": F.when(F.size(F.array_distinct(v)) < F.size(v), 1.0).otherwise(0.0),
        "linear_trend_slope": (12 * _sum(F.transform(v, lambda x, i: x * i)) - 6 * (n - 1) * F.col("total")) / (n * (n * n - 1)),
    }
    for k in lags:
        out[f"autocorrelation_{k}"] = F.when(F.col("m2") > 0, _sum(lagged(k, lambda a, b: (a - mean) * (b - mean))) / (n - k) / (F.col("m2") / n)).otherwise(0.0)
        size = F.size(v) - 2 * k
        three = F.arrays_zip(F.slice(v, F.lit(1), size).alias("a"), F.slice(v, F.lit(k + 1), size).alias("b"), F.slice(v, F.lit(2 * k + 1), size).alias("c"))
        out[f"c3_{k}"] = _sum(F.transform(three, lambda t: t["a"] * t["b"] * t["c"])) / (n - 2 * k)
        out[f"time_reversal_{k}"] = _sum(F.transform(three, lambda t: t["c"] * t["c"] * t["b"] - t["b"] * t["a"] * t["a"])) / (n - 2 * k)
    return base.select("series_id", *(c.alias(k) for k, c in out.items()))


def _per_series(series: DataFrame, f, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [f(np.asarray(v, float)) for v in batch["values"]]
            yield pd.concat([batch[["series_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return series.select("series_id", "values").mapInPandas(run, "series_id long, " + ", ".join(f"{n} double" for n in names))


def spectrum(series: DataFrame, coefficients: int = 8) -> DataFrame:
    """Magnitudes of the first Fourier coefficients."""

    def f(x: np.ndarray) -> np.ndarray:
        found = np.abs(np.fft.rfft(x))[:coefficients]
        return np.pad(found, (0, coefficients - len(found)))

    return _per_series(series, f, [f"fft_{k}" for k in range(coefficients)])


def dynamics(series: DataFrame, order: int = 4) -> DataFrame:
    """Autoregression, Lempel-Ziv complexity, permutation entropy, wavelet peaks and a unit-root statistic of each series; a batch's series of one length are done at once."""
    names = dyn.names(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.zeros((len(batch), len(names)))
            lengths = batch["values"].map(len).to_numpy()
            for n in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == n)
                found[at] = dyn.dynamics(np.stack(batch["values"].iloc[at].to_list()).astype(float), order)
            yield pd.concat([batch[["series_id"]].reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

    return series.select("series_id", "values").mapInPandas(run, "series_id long, " + ", ".join(f"{n} double" for n in names))


def canonical(series: DataFrame) -> DataFrame:
    """The 22 canonical features of each series."""
    return _per_series(series, c22.catch22, list(c22.NAMES))


def cloud_statistics(embedded: DataFrame) -> DataFrame:
    """Mean and deviation of each series' cloud along its own three principal axes, and its number of points."""
    names = [f"{s}_{k}" for s in ("mean", "std") for k in range(3)] + ["n_points"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [kernels.cloud_statistics(np.array([np.asarray(p, float) for p in pts])) if len(pts) else np.zeros(7) for pts in batch["points"]]
            yield pd.concat([batch[["series_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return embedded.select("series_id", "points").mapInPandas(run, "series_id long, " + ", ".join(f"{n} double" for n in names))


def signature(series: DataFrame) -> DataFrame:
    """Level-2 signature of the path (t, x), t from 0 to 1: s_t, s_x, s_tt, s_tx, s_xt, s_xx."""
    v, n = F.col("values"), F.size("values")
    first = F.get(v, F.lit(0))
    dt = F.lit(1.0) / (n - 1)
    steps = F.zip_with(F.slice(v, F.lit(2), n - 1), F.slice(v, F.lit(1), n - 1), lambda b, a: F.struct(a.alias("a"), (b - a).alias("dx")))
    tx = _sum(F.transform(steps, lambda s, i: (i + 0.5) * dt * s["dx"]))
    xt = _sum(F.transform(steps, lambda s: (s["a"] - first + s["dx"] / 2) * dt))
    s_x = F.get(v, n - 1) - first
    return series.select("series_id", F.lit(1.0).alias("s_t"), s_x.alias("s_x"), F.lit(0.5).alias("s_tt"), tx.alias("s_tx"), xt.alias("s_xt"), (s_x * s_x / 2).alias("s_xx"))


def cloud_signature(embedded: DataFrame, dims: int = 3) -> DataFrame:
    """series_id, s (dims), s2 (dims x dims, row by row), log2: the level-2 signature of a cloud's path through its points, and the areas of its logarithm.

    Chen's product adds a step d to (s, s2): s2 + s x d + d x d / 2, s + d. It is associative, so a path is folded point by point within the row. The
    logarithm's second level is s2 - s x s / 2, of which the parts above the diagonal tell all. A path of one point, or none, has zeros.
    """
    pairs = [(i, j) for i in range(dims) for j in range(dims)]
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    state = F.struct(F.lit(None).cast("array<double>").alias("at"), zeros(dims).alias("s"), zeros(dims * dims).alias("s2"))

    def step(acc: Column, p: Column) -> Column:
        d = [F.when(acc["at"].isNull(), 0.0).otherwise(F.get(p, F.lit(i)) - F.get(acc["at"], F.lit(i))) for i in range(dims)]
        s = [F.get(acc["s"], F.lit(i)) for i in range(dims)]
        s2 = [F.get(acc["s2"], F.lit(i * dims + j)) + s[i] * d[j] + d[i] * d[j] / 2 for i, j in pairs]
        return F.struct(p.alias("at"), F.array(*(a + b for a, b in zip(s, d, strict=True))).alias("s"), F.array(*s2).alias("s2"))

    rows = embedded.select("series_id", F.aggregate("points", state, step).alias("a")).select("series_id", "a.s", "a.s2")
    areas = F.array(*(F.get("s2", F.lit(i * dims + j)) - F.get("s", F.lit(i)) * F.get("s", F.lit(j)) / 2 for i, j in pairs if i < j))
    return rows.withColumn("log2", areas)


#: Generators by name: each takes the series table and gives series_id and feature columns.
GENERATORS = {"statistics": descriptive, "spectrum": spectrum, "dynamics": dynamics, "catch22": canonical, "signature": signature}


def generator(name: str):
    if name not in GENERATORS:
        raise ValueError(f"no generator {name!r}; there are {sorted(GENERATORS)}")
    return GENERATORS[name]

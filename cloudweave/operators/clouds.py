"""Point clouds of series and of classes: sampling, pooling, leave-one-series-out subclouds.

A point table is (label, series_id, point_idx, coords). Which series a point is from is its provenance.
Random orders are md5 orders of seed and key: the same in any run and under any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudweave.functions import kernels
from cloudweave.operators.embedding import cloud_budget
from cloudweave.operators.farthest import farthest_subclouds


@dataclass(frozen=True)
class Sizes:
    """How many points of n a cloud keeps: all below small, else fraction of them, least to most."""

    fraction: float = 0.8
    least: int = 20
    most: int = 1000
    small: int = 100

    def of(self, n: Column) -> Column:
        return cloud_budget(n, self.fraction, self.least, self.most, self.small)


def md5_order(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def points(clouds: DataFrame, column: str = "points") -> DataFrame:
    """(label, series_id, point_idx, coords) from clouds held in rows."""
    return clouds.select("label", "series_id", F.posexplode(column).alias("point_idx", "coords"))


def pooled(clouds: DataFrame) -> DataFrame:
    """The class clouds: the union of their series' points, each with its series. Nothing is gathered."""
    return points(clouds)


def uniform_sample(rows: DataFrame, group: tuple[str, ...], size: int, seed: int, *key: str) -> DataFrame:
    """At most size rows of each group, without replacement, in md5 order of key."""
    w = Window.partitionBy(*group).orderBy(md5_order(seed, *key), *key)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= size).drop("_rank")


def sample_in_row(column: str, size: Column, seed: int) -> Column:
    """The same for points held as an array: no shuffle."""
    keyed = F.transform(F.col(column), lambda p, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("series_id").cast("string"), i.cast("string"))).alias("k"), i.alias("i"), p.alias("p")))
    return F.transform(F.slice(F.array_sort(keyed), F.lit(1), F.greatest(size, F.lit(0))), lambda x: x["p"])


def maxmin_sample(clouds: DataFrame, size: Column, seed: int = 0, column: str = "points") -> DataFrame:
    """Clouds cut to their farthest points, one at a time within a row; the first point is drawn by md5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pts, n, first in zip(batch[column], batch["_size"], batch["_first"], strict=True):
                cloud = np.array([np.asarray(p, float) for p in pts]) if len(pts) else np.zeros((0, 0))
                out.append(cloud[kernels.farthest_points(cloud, int(n), int(first))].tolist() if len(cloud) else [])
            yield batch.assign(**{column: out})[names]

    names = clouds.columns
    first = F.pmod(F.conv(F.substring(md5_order(seed, "series_id"), 1, 8), 16, 10).cast("long"), F.greatest(F.size(column), F.lit(1)))
    return clouds.withColumn("_size", size).withColumn("_first", first).mapInPandas(run, clouds.schema)


def series_clouds(embedded: DataFrame, sizes: Sizes, seed: int = 0, mode: str = "uniform", project=None) -> DataFrame:
    """Each series' cloud: its embedding, projected and cut to its budget. Stays in the row."""
    clouds = embedded.withColumn("points", project("points")) if project else embedded
    size = sizes.of(F.size("points"))
    return maxmin_sample(clouds, size, seed) if mode == "maxmin" else clouds.withColumn("points", sample_in_row("points", size, seed))


def class_sizes(pool: DataFrame, sizes: Sizes) -> DataFrame:
    """(label, n, series, largest, size): points, series, most points of a series, and the subcloud's size.

    Counted by series first and then by class, so that a class of any size is a few numbers for each task. The
    size leaves room to exclude any one series, as long as that is not less than the least.
    """
    by_series = pool.groupBy("label", "series_id").agg(F.count("*").alias("n"))
    by_class = by_series.groupBy("label").agg(F.sum("n").cast("int").alias("n"), F.count("*").alias("series"), F.max("n").cast("int").alias("largest"))
    size = sizes.of(F.col("n"))
    room = F.col("n") - F.col("largest")
    return by_class.withColumn("size", F.greatest(F.when(room >= sizes.least, F.least(size, room)).otherwise(size), F.lit(1)).cast("int"))


def subclouds(pool: DataFrame, sizes: DataFrame, seed: int = 0, default: bool = True) -> DataFrame:
    """(label, exclude_series, series_id, point_idx, coords): for each series its class's subcloud without it.

    One md5 order of a class serves all exclusions: without a series, a point's place is its rank less the
    series' points before it. So only the first size + largest points of a class matter, a bounded number, and
    they are joined with the class's series. With default there is also the subcloud that excludes none.
    """
    w = Window.partitionBy("label").orderBy(md5_order(seed, "label", "series_id", "point_idx"), "series_id", "point_idx")
    # A limit known beforehand lets every task cut its share of a class before the shuffle, whatever the class's size.
    most = sizes.agg(F.max(F.col("size") + F.col("largest"))).head()[0] or 0
    ranked = pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).join(sizes.select("label", "size", "largest"), "label")
    head = ranked.where(F.col("rank") <= F.col("size") + F.col("largest"))
    own = Window.partitionBy("label", "series_id").orderBy("rank")
    head = head.withColumn("own", F.row_number().over(own)).select("label", "series_id", "point_idx", "coords", "rank", "own", "size")
    series = pool.select("label", F.col("series_id").alias("exclude_series")).distinct()
    # Ranks that fall away before each point: those of the excluded series' own points in the head.
    gone = head.groupBy("label", F.col("series_id").alias("exclude_series")).agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    paired = series.join(gone, ["label", "exclude_series"], "left").join(head, "label").where("series_id <> exclude_series")
    place = F.col("rank") - F.coalesce(F.size(F.filter("ranks", lambda r: r < F.col("rank"))), F.lit(0))
    place = F.when(F.col("ranks").isNull(), F.col("rank")).otherwise(place)
    out = paired.where(place <= F.col("size")).select("label", "exclude_series", "series_id", "point_idx", "coords")
    if not default:
        return out
    whole = head.where("rank <= size").select("label", F.lit(None).cast("long").alias("exclude_series"), "series_id", "point_idx", "coords")
    return out.unionByName(whole)


def one_per_series(pool: DataFrame, size: int, seed: int = 0, mode: str = "uniform") -> DataFrame:
    """At most size series of each class, one point of each: drawn, or the point farthest from its series' others."""
    chosen = pool.select("label", "series_id").distinct()
    chosen = chosen.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(md5_order(seed, "label", "series_id"), "series_id"))).where(F.col("_r") <= size).drop("_r")
    rows = pool.join(chosen, ["label", "series_id"])
    if mode == "uniform":
        return uniform_sample(rows, ("label", "series_id"), 1, seed, "series_id", "point_idx")
    other = rows.select("label", "series_id", F.col("coords").alias("other"))
    apart = F.sqrt(F.aggregate(F.zip_with("coords", "other", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    summed = rows.join(other, ["label", "series_id"]).groupBy("label", "series_id", "point_idx", "coords").agg(F.round(F.sum(apart), 9).alias("apart"))
    first = Window.partitionBy("label", "series_id").orderBy(F.desc("apart"), "point_idx")
    return summed.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("label", "series_id", "point_idx", "coords")


def _changed(head: DataFrame, kept: Column) -> DataFrame:
    """(label, exclude_series, points): the points of head in order of rank, up to kept, of each class and without each series that has one of them."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "coords", "series_id")))  # size + largest points at most
    by_class = head.groupBy("label").agg(ordered.alias("head"), F.max("size").alias("size"))
    first = lambda points: F.transform(F.slice(points, F.lit(1), F.col("size")), lambda x: x["coords"])
    whole = by_class.select("label", F.lit(None).cast("long").alias("exclude_series"), first(F.col("head")).alias("points"))
    without = head.where(kept).select("label", F.col("series_id").cast("long").alias("exclude_series")).distinct().join(by_class, "label")
    rest = F.filter("head", lambda x: x["series_id"] != F.col("exclude_series"))
    return whole.unionByName(without.select("label", "exclude_series", first(rest).alias("points")))


def class_subclouds(pool: DataFrame, sizes: DataFrame, seed: int = 0, mode: str = "maxmin", class_mode: str = "A") -> DataFrame:
    """(label, exclude_series, points): the subcloud of each class, and those without each series that has a point in it.

    exclude_series is null for the whole class. Any other series shares that one, so a class has at most as many rows
    as its subcloud has points, and one. A class of one series has no points without it. Mode A samples the pooled points
    (maxmin: farthest points, else by md5); mode B keeps one point of each series, of as many series in md5 order.
    """
    if class_mode == "B":
        ordered = one_per_series(pool, int(sizes.agg(F.max("size")).head()[0] or 0) + 1, seed, mode).join(sizes.select("label", "size"), "label")
        w = Window.partitionBy("label").orderBy(md5_order(seed, "label", "series_id"), "series_id")
        return _changed(ordered.withColumn("rank", F.row_number().over(w)).where("rank <= size + 1"), F.expr("rank <= size"))
    if mode == "maxmin":
        return farthest_subclouds(pool, sizes, seed)
    w = Window.partitionBy("label").orderBy(md5_order(seed, "label", "series_id", "point_idx"), "series_id", "point_idx")
    most = sizes.agg(F.max(F.col("size") + F.col("largest"))).head()[0] or 0
    ranked = pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).join(sizes.select("label", "size", "largest"), "label")
    return _changed(ranked.where("rank <= size + largest"), F.expr("rank <= size"))


def size_report(pool: DataFrame, sizes: DataFrame, query_points: int, loops: bool = True, few: int = 15) -> DataFrame:
    """Points, series and sizes of each class; small where H1 has too few points to be of use."""
    counted = pool.groupBy("label").agg(F.count("*").alias("points"), F.count_distinct("series_id").alias("series"))
    out = counted.join(sizes.select("label", F.col("size").alias("target"), "largest"), "label")
    out = out.withColumn("actual", F.least(F.col("target").cast("long"), F.col("points")))
    return out.withColumn("empty_without_one", F.col("series") <= 1).withColumn("small", F.lit(loops) & (F.least(F.col("actual"), F.lit(query_points)) < few))


def gathered(rows: DataFrame, *keys: str) -> DataFrame:
    """Subclouds as one array a row, points in order of series and index. Their size is bounded by Sizes.most."""
    ordered = F.array_sort(F.collect_list(F.struct("series_id", "point_idx", "coords")))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: x["coords"]).alias("points"))

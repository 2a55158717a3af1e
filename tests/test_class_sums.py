"""Class comparison without listing bars, and farthest points without each series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudweave.functions import kernels
from cloudweave.operators import barcodes, embedding, farthest
from cloudweave.plans import class_features


@pytest.mark.parametrize(("n", "per", "size", "grain"), [(300, 10, 60, 0), (300, 10, 60, 2), (100, 10, 95, 0), (100, 10, 200, 0), (60, 5, 20, 1), (50, 1, 10, 0), (40, 40, 20, 0)])
def test_farthest_without_each_series(n, per, size, grain):
    """Dropped points and shared beginnings change no order, with ties and copies too."""
    rng = np.random.default_rng(n + size)
    points = rng.normal(size=(n, 3))
    points = np.round(points * grain) / grain if grain else points
    series, first = np.arange(n) // per, int(rng.integers(n))
    found = kernels.Farthest(points, series, size, first)
    assert (found.order == kernels.farthest_points(points, size, first)).all()
    asked = {s: (first + per) % n if series[first] == s else first for s in found.owners}
    for s, got in found.without(asked).items():
        left = np.flatnonzero(series != s)
        plain = left[kernels.farthest_points(points[left], size, int(np.searchsorted(left, asked[s])))] if len(left) else left
        assert got.tolist() == plain.tolist()


def test_few_points_are_looked_at(monkeypatch):
    """Without a series only points that may still be taken are compared: far fewer than size times the pool."""
    rng = np.random.default_rng(1)
    points, looked = rng.normal(size=(4000, 3)), []
    found = kernels.Farthest(points, np.arange(4000) // 10, 400, 0)
    reduce = np.minimum
    monkeypatch.setattr(kernels.np, "minimum", lambda a, *b, **k: (looked.append(len(a)), reduce(a, *b, **k))[1])
    asked = dict.fromkeys(sorted(found.owners - {0})[:100], 0)
    found.without(asked)
    assert sum(looked) < 0.2 * len(asked) * 400 * 4000


def pairs(spark):
    rng = np.random.default_rng(2)
    cloud = lambda n: np.round(rng.normal(size=(n, 3)), 1).tolist()
    classes = {1: cloud(60), 2: cloud(45)}  # none for label 4
    rows = [(k, 1 + k % 2, cloud(k % 12), cloud(40 + k % 2) if k % 3 == 0 else None, [1, 2, 4]) for k in range(60)]
    return spark.createDataFrame(rows, "series_id long, label int, points array<array<double>>, own array<array<double>>, wanted array<int>"), classes


def test_sums_are_those_of_listed_bars(spark):
    rows, classes = pairs(spark)
    keys = ["series_id", "class_label"]
    listed = barcodes.slots(barcodes.class_barcodes(rows, ["series_id"], classes), keys, (0,))
    t = barcodes.betti_thresholds(listed)
    expected = barcodes.scalars(listed, t).toPandas().set_index([*keys, "direction"]).sort_index()
    trees = barcodes.ClassTrees(classes)
    measured = barcodes.class_measures(rows, ["series_id"], trees)
    own = barcodes.life_thresholds(measured, trees.bases)
    assert own.collect()[0].thresholds == t.collect()[0].thresholds
    got = barcodes.measured_scalars(measured, own, trees.bases).toPandas().set_index([*keys, "direction"]).sort_index()
    assert len(got) == len(expected) == 60 * 3 * 2
    for name in barcodes.REPS:
        np.testing.assert_allclose(got[name], expected[name], rtol=1e-12, atol=1e-12)
    most = measured.where("direction = 'cq' and base is not null").agg(F.max(F.size("life") + F.size("gone"))).head()[0]
    assert most < 60  # what differs from the class's own tree


def test_thresholds_of_slots_without_bars(spark):
    none = spark.createDataFrame([(1, 0, None, [], [])], "series_id long, hom_dim int, base int, gone array<double>, life array<double>")
    assert barcodes.life_thresholds(none, {}).head().thresholds == [0.0, 0.0, 0.0]


def test_fitting_keeps_differences_only(spark, tmp_path):
    """The barcodes that fitting writes hold few lengths for each pair with a class's own cloud, however large that is."""
    values = F.array(*(F.sin(F.col("series_id") * 1.7 + k * (1 + F.col("label"))) for k in range(24)))
    rows = spark.range(60).select(F.col("id").alias("series_id"), (F.col("id") % 2).cast("int").alias("label")).withColumn("values", values)
    config = class_features.Config(tau=2, m=3, stride=2, reps=("mtd", "betti_1"))
    class_features.fit(rows, config, str(tmp_path))
    table = spark.read.parquet(f"{tmp_path}/barcode").where("direction = 'cq' and label <> class_label")
    points = embedding.embed(rows, 2, 3, 2).agg(F.max(F.size("points"))).head()[0]
    size = spark.read.parquet(f"{tmp_path}/subclouds").agg(F.min(F.size("points"))).head()[0]
    assert size > 5 * points and table.count() == 60
    assert table.agg(F.avg(F.size("life") + F.size("gone"))).head()[0] < 0.7 * size


def test_rounds_begin_where_the_class_does(spark, monkeypatch):
    """In rounds too an order without a series begins with the class's own, up to the series' first point."""
    rng = np.random.default_rng(5)
    pool = spark.createDataFrame([(0, i // 4, i % 4, rng.normal(size=3).tolist()) for i in range(160)], "label int, series_id long, point_idx int, coords array<double>")
    begun, rounds = {}, farthest._round
    monkeypatch.setattr(farthest, "_round", lambda pool, groups, top: ([begun.setdefault(g.without, len(g.keys)) for g in groups], rounds(pool, groups, top)))
    got = farthest.farthest_subclouds(pool, spark.createDataFrame([(0, 12)], "label int, size int"), 0, 0, 8).collect()
    whole = next(r.points for r in got if r.exclude_series is None)
    places = {tuple(r.coords): r.series_id for r in pool.collect()}
    first = {}
    for k, p in enumerate(whole):
        first.setdefault(places[tuple(p)], k)
    assert {s: max(k, 1) for s, k in first.items()} == {s: n for s, n in begun.items() if s is not None}


def test_unseen_series_are_compared_once(spark, tmp_path):
    """With a folder for their scores unseen series are embedded and compared once, not for each part of the tails; the features are the same."""
    values = F.array(*(F.sin(F.col("series_id") * 1.7 + k * (1 + F.col("label"))) for k in range(24)))
    rows = spark.range(40).select(F.col("id").alias("series_id"), (F.col("id") % 2).cast("int").alias("label")).withColumn("values", values)
    config = class_features.Config(tau=2, m=3, stride=2, reps=("mtd",))
    model, _ = class_features.fit(rows.where("series_id < 30"), config, str(tmp_path / "fit"))
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    unseen = rows.where("series_id >= 30")
    plain = {(r.series_id, r.feature): r.value for r in class_features.transform(unseen, model).collect()}
    got = {(r.series_id, r.feature): r.value for r in class_features.transform(unseen.mapInPandas(counted, unseen.schema), model, work=str(tmp_path)).collect()}
    assert made.value == 10 and got == plain and len(got) == 10 * len(model.names)

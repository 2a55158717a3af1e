import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudweave.operators import barcodes, baselines, clouds, density, embedding, evaluate, features, independence, ordering, reports
from cloudweave.plans import class_features, experiments
from cloudweave.sources import series as sources
from cloudweave.sources import sinks

INF = float("inf")


@pytest.fixture(scope="module")
def sines(spark):
    """Two classes of noisy sines, 30 each."""
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, (np.sin(np.arange(128) * (0.2 + 0.25 * (i % 2)) + rng.uniform(0, 6)) + rng.normal(0, 0.1, 128)).tolist()) for i in range(60)]
    return spark.createDataFrame(rows, "series_id long, label int, values array<double>").repartition(4).persist()


def test_text_source(spark, tmp_path):
    (tmp_path / "Toy_TRAIN.txt").write_text("  1.0000e+00  1.5e-1 2 3\n2 4 5 6\n\n")
    (tmp_path / "Toy_TEST.txt").write_text("1 7 8 9\n")
    rows = sorted((r.split, r.label, r["values"]) for r in sources.read_text(spark, str(tmp_path)).collect())
    assert rows == [("TEST", 1, [7, 8, 9]), ("TRAIN", 1, [0.15, 2, 3]), ("TRAIN", 2, [4, 5, 6])]


def test_validation(spark):
    good = [(1, 0, [1.0, 2.0]), (2, 1, [3.0, 4.0])]
    schema = "series_id long, label int, values array<double>"
    assert sources.validate(spark.createDataFrame(good, schema)).count() == 2
    for bad in ((3, 0, [float("nan"), 1.0]), (3, 0, [INF, 1.0]), (3, 0, None), (3, 0, []), (3, None, [1.0, 2.0]), (3, 0, [1.0]), (3, 0, [None, 1.0])):
        with pytest.raises(ValueError):
            sources.validate(spark.createDataFrame([*good, bad], schema))


def test_embedding_cap():
    assert embedding.cap_embedding(64, 4, 10, 3) == (4, 10, 3)
    for length in (6, 12, 40):
        t, m, s = embedding.cap_embedding(length, 8, 12, 4)
        assert (m - 1) * t + 1 <= length
    assert embedding.cap_embedding(6, 8, 12, 4) == (8, 1, 1)
    assert embedding.cap_embedding(2, 8, 12, 4) == (1, 2, 4)
    with pytest.raises(ValueError):
        embedding.cap_embedding(0, 2, 2, 1)


def test_cap_grid_is_the_function(spark):
    rows = spark.createDataFrame([(n,) for n in range(1, 60)], "length int")
    for r in embedding.cap_grid(rows, 8, 12, 4).collect():
        assert (r.tau, r.m, r.stride) == embedding.cap_embedding(r.length, 8, 12, 4)


def test_budget_rounds_half_to_even(spark):
    got = spark.createDataFrame([(0,), (5,), (25,), (35,), (1000,)], "n int").select(embedding.cloud_budget(F.col("n"), 0.1, 1, 60, 10).alias("b")).collect()
    assert [r.b for r in got] == [0, 5, 2, 4, 60]


def slotted(spark):
    rows = [("A", [(0.0, 1.0), (0.0, 2.0), (0.0, INF)]), ("B", [(0.0, INF), (1.0, INF)]), ("C", []), ("D", [(1.0, 2.0)] * 4)]
    return spark.createDataFrame([(k, "qc", 0, b) for k, b in rows], "pair string, direction string, hom_dim int, bars array<struct<birth:double,death:double>>")


def test_scalars_by_hand(spark):
    rows = slotted(spark)
    t = barcodes.betti_thresholds(rows)
    lives = [1.0, 2.0, 2.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0]
    assert np.allclose(t.head().thresholds, np.quantile(lives, [0.25, 0.5, 0.75]))
    got = {r.pair: r for r in barcodes.scalars(rows, t).collect()}
    assert (got["A"].mtd, got["A"].total_persistence) == (1e6, 1e6)
    assert np.isclose(got["A"].landscape_l2, 3) and np.isclose(got["A"].pers_entropy, -(0.2 * np.log2(0.2) + 0.8 * np.log2(0.4)))
    assert (got["B"].pers_entropy, got["B"].landscape_l2, got["B"].mtd) == (0, 0, 1e6)
    assert [got["C"][r] for r in barcodes.REPS] == [0.0] * 7
    assert (got["D"].mtd, got["D"].pers_entropy, got["D"].betti_1) == (4, 2, 4)


def test_sampling_does_not_depend_on_partitions(spark, sines):
    pool = clouds.pooled(embedding.embed(sines, 4, 3, 2))
    sizes = clouds.class_sizes(pool, clouds.Sizes(0.1, 20, 60, 30))
    out = []
    for n in (1, 17):
        p = pool.repartition(n)
        out.append(sorted((r.label, -1 if r.exclude_series is None else r.exclude_series, r.series_id, r.point_idx) for r in clouds.subclouds(p, sizes).collect()))
    assert out[0] == out[1]
    assert not any(e == s for _, e, s, _ in out[0])
    size = {r.label: r["size"] for r in sizes.collect()}
    from collections import Counter

    assert all(n == size[k[0]] for k, n in Counter((r[0], r[1]) for r in out[0]).items())


def test_single_series_class_has_no_subcloud(spark):
    rows = spark.createDataFrame([(1, 0, [float(x) for x in range(20)])], "series_id long, label int, values array<double>")
    pool = clouds.pooled(embedding.embed(rows, 1, 2, 1))
    sizes = clouds.class_sizes(pool, clouds.Sizes(0.1, 20, 60, 30))
    assert clouds.subclouds(pool, sizes, default=False).count() == 0
    assert clouds.size_report(pool, sizes, 10).head().empty_without_one


def test_maxmin_in_rows(spark, sines):
    got = clouds.maxmin_sample(embedding.embed(sines, 4, 3, 2), F.lit(10)).collect()
    assert all(len(r.points) == 10 for r in got)


def test_ecdf_tail_is_monotone(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(rng.normal(size=200))] + [(0, INF), (0, float("nan")), (7, 1.0)], "g int, value double")
    sample = rows.where("g < 2").limit(100)
    held = {g: sorted(r.value for r in sample.collect() if r.g == g and np.isfinite(r.value)) for g in (0, 1)}
    for r in density.ecdf_tail(rows, sample, ["g"]).collect():
        if r.g < 2 and np.isfinite(r.value):
            assert np.isclose(r.tail, 1 - np.searchsorted(held[r.g], r.value, "left") / len(held[r.g]))
        elif r.g < 2:
            assert r.tail == 1.0


def test_fusion_rules(spark):
    rows = spark.createDataFrame([(1, 0, "a", c, p) for c, p in ((0, 0.4), (1, 0.4), (2, 0.2))], "series_id long, label int, module string, class_label int, p double")
    assert evaluate.argmax(rows, ["series_id"]).head().prediction == 0
    acc = spark.createDataFrame([("x", "a", 0.5), ("x", "b", 1.0)], "combo string, module string, accuracy double")
    w = {r.module: r.weight for r in evaluate.cawpe_weights(acc, ["combo"]).collect()}
    assert np.isclose(sum(w.values()), 1) and np.isclose(w["b"] / w["a"], 16)
    with pytest.raises(Exception):
        evaluate.cawpe_weights(acc.withColumn("accuracy", F.lit(0.0)), ["combo"]).collect()


def test_folds_are_balanced(spark, sines):
    got = evaluate.folds(sines, 4, 1, "series_id", "label").groupBy("label", "fold").count().collect()
    assert len(got) == 8 and {r["count"] for r in got} <= {7, 8}


def test_summary_with_gaps(spark):
    rows = spark.createDataFrame([("d1", "m1", 0, 0.5), ("d1", "m1", 1, 0.7), ("d1", "m1", 2, 0.6), ("d2", "m1", 0, 0.2), ("d2", "m2", 0, 0.9)], "dataset string, method string, seed int, holdout_accuracy double")
    got = {r.dataset: (r.m1, r.m2) for r in reports.wide_summary(rows, ["m1", "m2"]).collect()}
    assert got == {"d1": (0.6, None), "d2": (0.2, 0.9), "MEAN": (0.4, 0.9)}


def test_features_tell_classes_apart(spark, sines, tmp_path):
    test = F.col("series_id") % 3 == 0
    config = class_features.Config(tau=4, m=3, stride=2, components=3, query_sizes=clouds.Sizes(0.5, 5, 40, 10), repeats=2)
    train, unseen = experiments.cloud_vectors(sines.where(~test), sines.where(test), config, str(tmp_path))
    assert len(train.head().features) == 2 * 7 * 4
    model = evaluate.Classifier(evaluate.random_forest(30, 6)).fit(train)
    assert evaluate.accuracy(model.predict(unseen)).head().accuracy > 0.9


def test_model_is_stored_and_frozen(spark, sines, tmp_path):
    config = class_features.Config(tau=4, m=3, stride=2, query_sizes=clouds.Sizes(0.5, 5, 20, 10), reps=("mtd",), tail="kde")
    model, found = class_features.fit(sines.where("series_id < 40"), config, str(tmp_path / "work"))
    model.save(str(tmp_path / "model"))
    loaded = class_features.Model.load(spark, str(tmp_path / "model"), config)
    unseen = sines.where("series_id >= 40")
    a, b = ({(r.series_id, r.feature): round(r.value, 9) for r in class_features.transform(unseen, m).collect()} for m in (model, loaded))
    assert a == b and len(a) == 20 * 2 * 4
    values = [r.value for r in found.where("feature like '%membership'").collect()]
    assert all(0 <= v <= 1 for v in values)


def test_stored_barcodes_are_not_made_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, [[0.0, 1.0]], [[1.0, 1.0]]), (2, [[0.0, 1.0]], [[1.0, 1.0]]), (3, [[5.0, 1.0]], [[1.0, 1.0]])], "id long, points array<array<double>>, class_points array<array<double>>")
    keyed = rows.withColumn("key", sinks.content_key("points", "class_points"))
    made = []

    def compute(p):
        made.append(p.count())
        return p.select("key")

    path = str(tmp_path / "store")
    assert sinks.with_store(keyed.where("id < 3"), path, compute).count() == 1
    assert sinks.with_store(keyed, path, compute).count() == 2 and made == [1, 1]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("d", 0, "c", "m", 0.5, 1.0, 4.0)], "dataset string, seed int, combo string, module string, oof_acc double, weight double, cawpe_alpha double")
    rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "w"))
    assert sinks.read_weights(spark, str(tmp_path / "w")).head().weight == 1.0
    sinks.write_table(rows, str(tmp_path / "t"), sinks.WEIGHTS)
    assert set(spark.read.parquet(str(tmp_path / "t")).columns) == set(sinks.WEIGHTS)
    sinks.append_split(rows, str(tmp_path / "s"))
    sinks.append_split(rows.withColumn("seed", F.lit(1)), str(tmp_path / "s"))
    sinks.append_split(rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_independence(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=(80, 3))
    x = np.column_stack([y @ [1.0, 2.0, 0.5] + rng.normal(0, 0.1, 80), rng.normal(size=80)])
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "row_id long, x array<double>, y array<double>")
    folded = independence.assign_folds(rows, 1).persist()
    r2 = {r.slot: r.r2 for r in independence.explained_r2(folded).collect()}
    assert r2[0] > 0.9 and r2[1] < 0.2
    assert independence.canonical_correlation(folded) > 0.4
    assert independence.capped_pca(rows, "y", F.col("row_id") < 4).select(F.size("y")).head()[0] == 2
    assert independence.n_splits(3) == 2 and independence.n_splits(100) == 5
    stat = independence.permuted(rows, 19, 1).groupBy("replicate").agg(F.abs(F.corr(F.get("x", F.lit(0)), F.get("y", F.lit(1)))).alias("value"))
    assert independence.p_value(stat).head().p_value == 0.05
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    for metric in independence.METRICS:
        got = independence.p_value(independence.null_values(folded, metric, 19, 1)).head()
        assert got.p_value == 0.05 and got.value > got.null_mean


def test_r2_equals_a_plain_ridge(spark):
    """With a wide partner, reduced to 20 axes by the training folds."""
    rng = np.random.default_rng(5)
    y = rng.normal(size=(90, 30)) @ rng.normal(size=(30, 30))
    x = y[:, :2] + rng.normal(size=(90, 2))
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "row_id long, x array<double>, y array<double>")
    folded = independence.assign_folds(rows, 3)
    fold = np.array([r.fold for r in folded.orderBy("row_id").collect()])
    guess = np.zeros_like(x)
    for f in range(5):
        a, b = fold != f, fold == f
        mean, scale = y[a].mean(0), y[a].std(0)
        z, t = (y[a] - mean) / scale, (y[b] - mean) / scale
        axes = np.linalg.svd(z, full_matrices=False)[2][:20].T
        z, t = z @ axes, t @ axes
        beta = np.linalg.solve(z.T @ z + np.eye(20), z.T @ (x[a] - x[a].mean(0)))
        guess[b] = t @ beta + x[a].mean(0)
    want = np.clip(1 - ((x - guess) ** 2).sum(0) / ((x - x.mean(0)) ** 2).sum(0), 0, 1)
    assert np.allclose([r.r2 for r in independence.explained_r2(folded).orderBy("slot").collect()], want)


def test_places_equal_a_window(spark):
    rows = spark.range(500).select(F.col("id"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 2).alias("g"))
    got = ordering.ranked(rows, ordering.md5_of(1, "id"), "id", "g").collect()
    for g in {r.g for r in got}:
        own = sorted((hashlib.md5(f"1:{r.id}".encode()).hexdigest(), r.id, r["rank"]) for r in got if r.g == g)
        assert [x[2] for x in own] == list(range(1, len(own) + 1))


def test_features_are_fitted_within_folds(spark, sines, tmp_path):
    """With shuffled labels the accuracy stays at chance, since no held-out series is in its class's cloud."""
    mixed = sines.withColumn("label", F.pmod(F.xxhash64("series_id"), F.lit(2)).cast("int"))
    made = iter(range(100))

    def methods(train, test, seed):
        assert train.join(test, "series_id").count() == 0
        return {"classes": experiments.cloud_vectors(train, test, class_features.QUICK, str(tmp_path / str(next(made))))}

    for rows, low, high in ((mixed, 0.2, 0.75), (sines, 0.85, 1.01)):
        got = experiments.cross_validation(rows, methods, evaluate.random_forest(10, 4), 2, 1).agg(F.avg("accuracy")).head()[0]
        assert low <= got < high


def test_importances(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, int(i % 2), [float(i % 2) + rng.normal(0, 0.1), rng.normal()]) for i in range(80)], "series_id long, label int, v array<double>")
    from pyspark.ml.functions import array_to_vector

    rows = rows.withColumn("features", array_to_vector("v"))
    model = evaluate.Classifier(evaluate.random_forest(10, 4)).fit(rows)
    got = {r.slot: r.importance for r in evaluate.permutation_importance(model, rows, 2, 5).collect()}
    assert got[0] > 0.3 > got[1]
    meta = spark.createDataFrame([(0, "a"), (1, "b")], "position int, feature string")
    own = {r.feature: r.importance for r in evaluate.impurity_importance(model, meta).collect()}
    assert own["a"] > own["b"]
    proba = evaluate.out_of_fold(rows, evaluate.random_forest(5, 3), "m", 3, 1)
    assert proba.count() == 160 and np.isclose(proba.groupBy("series_id").agg(F.sum("p").alias("s")).agg(F.max("s")).head()[0], 1)
    stacked = evaluate.stacking_matrix(proba, ["series_id", "label"], ["m"], [0, 1])
    for meta_learner in (evaluate.logistic(50), evaluate.boosted(2, 3)):
        assert evaluate.accuracy(evaluate.stack(stacked, stacked, ["p_m_0", "p_m_1"], meta_learner)).head().accuracy > 0.9


def test_generators(spark, sines):
    with pytest.raises(ValueError):
        baselines.generator("none")
    for name in baselines.GENERATORS:
        got = baselines.generator(name)(sines)
        assert got.count() == 60 and not got.dropna().count() < 60
    assert len(features.SUFFIXES) == 4

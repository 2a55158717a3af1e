import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cloudweave.operators import boosting, evaluate


def plain(x, y, classes, bins, iterations, depth, rate, least):
    """The same trees by loops over rows held in memory, bins given."""
    share = np.bincount(y, minlength=classes) / len(y)
    scores = np.tile(np.log(np.maximum(share, 1e-10)), (len(y), 1))
    for _ in range(iterations):
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for k in range(classes):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])
            parts, add = [np.arange(len(y))], np.zeros(len(y))
            for level in range(depth):
                further = []
                for rows in parts:
                    best = (0.0, None)
                    for f in range(x.shape[1]):
                        for b in range(bins):
                            left = rows[x[rows, f] <= b]
                            right = rows[x[rows, f] > b]
                            if min(len(left), len(right)) >= least and min(h[left].sum(), h[right].sum()) >= 1e-3:
                                gain = sum(g[s].sum() ** 2 / h[s].sum() for s in (left, right)) - g[rows].sum() ** 2 / h[rows].sum()
                                if gain > best[0] + 1e-12:
                                    best = (gain, (left, right))
                    if best[1] is None:
                        add[rows] = -rate * g[rows].sum() / h[rows].sum()
                    else:
                        further += best[1]
                parts = further
            for rows in parts:
                add[rows] = -rate * g[rows].sum() / h[rows].sum()
            scores[:, k] += add
    p = np.exp(scores - scores.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_boosted_trees_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(150, 3)), 1)
    y = (x[:, 0] + 0.5 * rng.normal(size=150) > 0.4).astype(int) + (x[:, 1] > 0.8)
    table = spark.createDataFrame([(i, int(c) * 10, v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "series_id long, label int, v array<double>").repartition(4)
    rows = table.select("series_id", "label", array_to_vector("v").alias("features"))
    learner = boosting.BoostedTrees(iterations=3, depth=2, bins=8, least=5)
    fitted = evaluate.Classifier(learner).fit(rows)
    assert fitted.classes == [0, 10, 20]
    want = plain(boosting.binned(x, fitted.model.cuts), y, 3, 8, 3, 2, 0.1, 5)
    got = {r.series_id: r for r in fitted.predict(rows).collect()}
    np.testing.assert_allclose([got[i].proba for i in range(150)], want, atol=1e-9)
    assert [got[i].prediction for i in range(150)] == [10 * int(p.argmax()) for p in want]


def test_boosted_trees_learn(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (300, 2))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0)
    rows = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "series_id long, label int, v array<double>").select("series_id", "label", array_to_vector("v").alias("features"))
    model = evaluate.Classifier(evaluate.boosted_softmax(8)).fit(rows.where("series_id < 200"))
    assert evaluate.accuracy(model.predict(rows.where("series_id >= 200"))).head().accuracy > 0.9
    one = evaluate.Classifier(evaluate.boosted_softmax(2)).fit(rows.where("label = 1"))  # one class only
    assert one.predict(rows.limit(5)).where(F.col("prediction") == 1).count() == 5

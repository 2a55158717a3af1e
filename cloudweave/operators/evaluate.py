"""Folds, classifiers, fusion, stacking and importances.

A probability row is (series_id, label, module, class_label, p).
"""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudweave.operators.boosting import BoostedTrees
from cloudweave.operators.ordering import md5_of, ranked


def folds(rows: DataFrame, k: int, seed: int, key: str, stratum: str | None = None) -> DataFrame:
    """rows with fold: shuffled by md5, and within each stratum as even as can be."""
    placed = ranked(rows, md5_of(seed, key), key, *([stratum] if stratum else []), name="_place")
    return placed.withColumn("fold", F.pmod(F.col("_place") - 1, F.lit(k)).cast("int")).drop("_place")


def accuracy(predictions: DataFrame, *group: str) -> DataFrame:
    return predictions.groupBy(*group).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def argmax(scores: DataFrame, keys: list[str], value: str = "p") -> DataFrame:
    """keys, prediction: the class of the greatest value, the smallest class on ties. An aggregate, not a sort."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col("class_label")).alias("c")))
    return scores.groupBy(*keys).agg((-best["c"]).cast("int").alias("prediction"))


def fuse_uniform(proba: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of the modules' probabilities."""
    return proba.groupBy(*keys, "class_label").agg(F.avg("p").alias("p"))


def cawpe_weights(accuracies: DataFrame, group: list[str], alpha: float = 4.0) -> DataFrame:
    """accuracies (group, module, accuracy) with weight = accuracy^alpha over its group's sum."""
    power = F.pow("accuracy", F.lit(alpha))
    total = F.sum(power).over(Window.partitionBy(*group)) if group else F.sum(power).over(Window.partitionBy(F.lit(0)))
    checked = F.when(total > 0, power / total).otherwise(F.raise_error(F.lit("the accuracies of a group are all 0")).cast("double"))
    return accuracies.withColumn("weight", checked)


def fuse_weighted(proba: DataFrame, weights: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """The weighted sum of the modules' probabilities. weights: one row for each module (and group)."""
    joined = proba.join(weights.select(*on, "weight"), on)
    return joined.groupBy(*keys, "class_label").agg(F.sum(F.col("weight") * F.col("p")).alias("p"))


def stacking_matrix(proba: DataFrame, keys: list[str], modules: list[str], classes: list[int]) -> DataFrame:
    """keys and a column p_{module}_{class} for each, modules in order, then classes."""
    cells = [F.max(F.when((F.col("module") == m) & (F.col("class_label") == c), F.col("p"))).alias(f"p_{m}_{c}") for m in modules for c in classes]
    return proba.groupBy(*keys).agg(*cells)


def random_forest(trees: int = 200, depth: int = 30, seed: int = 0) -> RandomForestClassifier:
    """Rows' places in the trees are kept between levels: deep trees are not sent to the tasks and walked again for each."""
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="_index", featuresCol="features", cacheNodeIds=True)


def logistic(iterations: int = 1000) -> LogisticRegression:
    return LogisticRegression(maxIter=iterations, labelCol="_index", featuresCol="features")


def boosted(depth: int = 3, iterations: int = 100, seed: int = 0) -> OneVsRest:
    """Boosted trees are binary here, so one for each class against the rest."""
    return OneVsRest(classifier=GBTClassifier(maxDepth=depth, maxIter=iterations, seed=seed, labelCol="_index", featuresCol="features"), labelCol="_index", featuresCol="features")


def boosted_softmax(iterations: int = 100, depth: int = 3) -> BoostedTrees:
    """Boosted trees of all classes at once."""
    return BoostedTrees(iterations, depth)


class Classifier:
    """An estimator over integer labels: classes are sorted, and an index is a place among them."""

    def __init__(self, estimator, model=None, classes: list[int] | None = None):
        self.estimator, self.model, self.classes = estimator, model, classes

    def _indexed(self, rows: DataFrame) -> DataFrame:
        places = F.create_map(*(x for i, c in enumerate(self.classes) for x in (F.lit(c), F.lit(float(i)))))
        return rows.withColumn("_index", places[F.col("label")])

    def fit(self, rows: DataFrame) -> Classifier:
        classes = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]
        fitted = Classifier(self.estimator, None, classes)
        own = self.estimator.copy() if isinstance(self.estimator, Estimator) else self.estimator  # fits may run side by side
        fitted.model = own.fit(fitted._indexed(rows))
        return fitted

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with prediction (a class), and proba (an array in order of classes) if the model has it."""
        out = self.model.transform(self._indexed(rows).na.fill(0.0, ["_index"]))
        names = F.array(*(F.lit(c) for c in self.classes))
        got = out.withColumn("prediction", F.get(names, F.col("prediction").cast("int")))
        if "probability" in out.columns:
            got = got.withColumn("proba", vector_to_array("probability"))
        return got.select(*rows.columns, "prediction", *(["proba"] if "probability" in out.columns else []))

    def probabilities(self, rows: DataFrame, module: str, keys: list[str]) -> DataFrame:
        scored = self.predict(rows).select(*keys, F.posexplode("proba").alias("_i", "p"))
        return scored.select(*keys, F.lit(module).alias("module"), F.get(F.array(*(F.lit(c) for c in self.classes)), F.col("_i")).alias("class_label"), "p")


def cross_validate(features: dict[int, tuple[DataFrame, DataFrame]], estimator) -> DataFrame:
    """(fold, accuracy, n) from each fold's (training, held-out) features, made once and used by any method."""
    out = None
    for fold, (train, held) in features.items():
        row = accuracy(Classifier(estimator).fit(train).predict(held)).withColumn("fold", F.lit(fold))
        out = row if out is None else out.unionByName(row)
    return out


def out_of_fold(rows: DataFrame, estimator, module: str, k: int, seed: int) -> DataFrame:
    """Probability rows of every training row, each from the model that did not see it. rows: series_id, label, features.

    For features of a row alone; those that are fitted to other rows need experiments.out_of_fold.
    """
    dealt = folds(rows, k, seed, "series_id", "label")
    out = None
    for f in range(k):
        model = Classifier(estimator).fit(dealt.where(F.col("fold") != f))
        part = model.probabilities(dealt.where(F.col("fold") == f), module, ["series_id", "label"])
        out = part if out is None else out.unionByName(part)
    return out


def stack(train: DataFrame, test: DataFrame, columns: list[str], estimator) -> DataFrame:
    """Predictions on test of a meta-learner that was fitted on the training stack."""
    assemble = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    return Classifier(estimator).fit(assemble.transform(train)).predict(assemble.transform(test))


def permutation_importance(model: Classifier, rows: DataFrame, size: int, repeats: int = 10, seed: int = 0) -> DataFrame:
    """(slot, importance, importance_std): mean and population deviation of the accuracy lost when a slot is shuffled.

    All repeats of a slot are one job: rows are paired with donors of the same place in another md5 order. Places
    are given to ids alone, and only the donated value travels with them; a row's vector is joined once a shuffle.
    """
    rows = rows.select("series_id", "label", "features")
    base = accuracy(model.predict(rows)).head()["accuracy"]
    ids = rows.select("series_id")
    at = ranked(ids, md5_of(seed, F.lit("at"), "series_id"), "series_id", name="at")
    grid = rows.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"), vector_to_array("features").alias("_v"))
    grid = grid.select("series_id", "repeat", F.posexplode("_v").alias("slot", "donated"))
    donors = ranked(grid, md5_of(seed, "slot", "repeat", "series_id"), "series_id", "slot", "repeat", name="at").drop("series_id")
    mixed = rows.withColumn("_v", vector_to_array("features")).join(at, "series_id").join(donors, "at")
    shuffled = mixed.withColumn("features", array_to_vector(F.transform("_v", lambda x, i: F.when(i == F.col("slot"), F.col("donated")).otherwise(x))))
    got = accuracy(model.predict(shuffled.select("series_id", "label", "features", "slot", "repeat")), "slot", "repeat")
    return got.groupBy("slot").agg(F.avg(base - F.col("accuracy")).alias("importance"), F.stddev_pop(base - F.col("accuracy")).alias("importance_std"))


def impurity_importance(model: Classifier, meta: DataFrame) -> DataFrame:
    """meta (position, ...) with the model's own importances; it has no deviation."""
    rows = [(i, float(v)) for i, v in enumerate(model.model.featureImportances.toArray())]
    found = meta.sparkSession.createDataFrame(rows, "position int, importance double")
    return meta.join(found, "position").withColumn("importance_std", F.lit(float("nan")))


def probability_rows(table: DataFrame, values: Column, modules: list[str], classes: int) -> DataFrame:
    """(series_id, label, module, class_label, p) from an array of len(modules) * classes weights, each module's scaled to 1."""
    split = F.explode(F.array(*(F.struct(F.lit(m).alias("module"), F.slice(values, k * classes + 1, classes).alias("w")) for k, m in enumerate(modules))))
    rows = table.select("series_id", "label", split.alias("s"))
    total = F.aggregate("s.w", F.lit(0.0), lambda a, x: a + x)
    return rows.select("series_id", "label", "s.module", F.posexplode(F.transform("s.w", lambda x: x / total)).alias("class_label", "p"))

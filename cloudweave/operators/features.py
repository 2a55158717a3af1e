"""Feature blocks B1 (raw), B2 (asymmetry), B3 (membership), their names and their wide form."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.operators.embedding import clean

SUFFIXES = (("qc", "B1"), ("cq", "B1"), ("asym", "B2"), ("membership", "B3"))


def sides(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, qc, cq, asym of long scores: both directions of a pair in one row."""
    both = scores.groupBy(*keys).agg(F.max(F.when(F.col("direction") == "qc", F.col("value"))).alias("qc"), F.max(F.when(F.col("direction") == "cq", F.col("value"))).alias("cq"))
    return both.withColumn("asym", F.col("qc") - F.col("cq"))


def membership(tail: str = "tail") -> Column:
    """A missing density counts as certain membership."""
    return F.coalesce(F.col(tail), F.lit(1.0))


def feature_name(class_label: str, rep: str, hom_dim: str, suffix: Column) -> Column:
    return F.concat(F.lit("class_"), F.col(class_label).cast("string"), F.lit("_"), F.col(rep), F.lit("_h"), F.col(hom_dim).cast("string"), F.lit("_"), suffix)


def long_features(rows: DataFrame, limit: float = 1e6) -> DataFrame:
    """(series_id, feature, value) from rows of (series_id, class_label, rep, hom_dim, qc, cq, asym, membership)."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("suffix"), F.col(s).alias("value")) for s, _ in SUFFIXES)))
    out = rows.select("series_id", "class_label", "rep", "hom_dim", each.alias("x"))
    return out.select("series_id", feature_name("class_label", "rep", "hom_dim", F.col("x.suffix")).alias("feature"), clean(F.col("x.value"), limit).alias("value"))


def feature_meta(spark: SparkSession, classes: list[int], hom_dims: tuple[int, ...], reps: tuple[str, ...], source: str = "clouds") -> DataFrame:
    """(position, feature, source, class_label, rep, hom_dim, block), in the order of the features."""
    rows = [(f"class_{c}_{r}_h{h}_{s}", source, c, r, h, b) for c in classes for h in hom_dims for r in reps for s, b in SUFFIXES]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, feature string, source string, class_label int, rep string, hom_dim int, block string")


def wide(features: DataFrame, names: list[str], key: str = "series_id") -> DataFrame:
    """A column for each name, 0 where a series lacks it. The names are given, so the pivot needs no pass of its own."""
    return features.groupBy(key).pivot("feature", names).agg(F.first("value")).fillna(0.0)


def combine(blocks: list[DataFrame], keys: list[str], output: str = "features") -> DataFrame:
    """Generators side by side in the given order, by an equi-join on keys, as one vector."""
    joined = blocks[0]
    for b in blocks[1:]:
        joined = joined.join(b, keys)
    inputs = [c for b in blocks for c in b.columns if c not in keys]
    return VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep").transform(joined).select(*keys, output)

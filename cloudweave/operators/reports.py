"""Summary tables over accuracy rows (dataset, is_dynamical, method, seed, holdout_accuracy, source)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_type(rows: DataFrame) -> DataFrame:
    """Mean accuracy and rows of each method, dynamical datasets and others apart."""
    return rows.groupBy("is_dynamical", "method").agg(F.avg("holdout_accuracy").alias("mean_accuracy"), F.count("*").alias("n")).orderBy(F.desc("is_dynamical"), "method")


def dataset_means(rows: DataFrame) -> DataFrame:
    """(dataset, method, mean): over seeds, not rounded."""
    return rows.groupBy("dataset", "method").agg(F.avg("holdout_accuracy").alias("mean"))


def wide_summary(rows: DataFrame, methods: list[str], digits: int = 6) -> DataFrame:
    """A row a dataset, a column a method, null where absent; and a MEAN row of the datasets' unrounded means.

    The MEAN row weighs datasets alike, whatever their number of seeds, so it is no rollup of the rows.
    """
    means = dataset_means(rows.where(F.col("method").isin(*methods)))
    cells = [F.max(F.when(F.col("method") == m, F.col("mean"))) for m in methods]
    per = means.groupBy("dataset").agg(*(F.round(c, digits).alias(m) for c, m in zip(cells, methods, strict=True)))
    total = means.groupBy().agg(F.lit("MEAN").alias("dataset"), *(F.round(F.avg(F.when(F.col("method") == m, F.col("mean"))), digits).alias(m) for m in methods))
    return per.unionByName(total.select("dataset", *methods))


def in_order(summary: DataFrame, order: DataFrame, sources: DataFrame, columns: list[str]) -> DataFrame:
    """summary in the order of a dimension (dataset, rank), MEAN last, with metadata from the first source that has it.

    sources: (dataset, source_rank, *columns).
    """
    meta = sources.groupBy("dataset").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_rank"))).alias(c) for c in columns))
    joined = summary.join(order, "dataset", "left").join(meta, "dataset", "left")
    return joined.withColumn("rank", F.when(F.col("dataset") == "MEAN", F.lit(None).cast("int")).otherwise(F.col("rank"))).orderBy(F.asc_nulls_last("rank"), "dataset")

"""Labelled series: from text, from tables, and their validation.

A series row is (series_id long, label int, values array<double>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace text, a series a line: the label, then the values. series_id is a hash of file, line, and which of its equals a line is.

    Equal lines are counted, and come out numbered: they have nothing else that tells them apart, so which is which does not matter, and every line is a series of its own under any split of the file.

    Adds split: TRAIN or TEST where the file's name ends so (before .txt), else null.
    """
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_name")).where(F.trim("value") != "")
    lines = lines.groupBy("file", "value").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    fields = F.split(F.trim("value"), r"\s+")
    numbers = F.transform(fields, lambda x: x.cast("double"))
    return lines.select(
        F.xxhash64("file", "value", "copy").alias("series_id"),
        F.element_at(numbers, 1).cast("int").alias("label"),
        F.slice(numbers, F.lit(2), F.greatest(F.size(numbers) - 1, F.lit(0))).alias("values"),
        F.nullif(F.regexp_extract("file", r"_(TRAIN|TEST)\.txt$", 1), F.lit("")).alias("split"),
    )


def from_vectors(table: DataFrame, key: str = "vec_id", values: str = "embedding", label: str = "label") -> DataFrame:
    return table.select(F.col(key).cast("long").alias("series_id"), F.col(label).cast("int").alias("label"), F.transform(values, lambda x: x.cast("double")).alias("values"))


def bucketed(rows: DataFrame, key: str, ts: str, value: str, start: str, seconds: int, buckets: int, fill: float = 0.0) -> DataFrame:
    """Long (key, ts, value) rows as one array of fixed length a key: the mean of each time bucket, fill where empty.

    One shuffle by key: buckets are averaged map-side first; the grid of buckets is a literal array, not a join.
    """
    number = F.floor((F.col(ts).cast("timestamp").cast("double") - F.lit(start).cast("timestamp").cast("double")) / seconds).cast("int")
    means = rows.select(F.col(key).alias("series_id"), number.alias("bucket"), F.col(value).alias("value")).where(F.col("bucket").between(0, buckets - 1)).groupBy("series_id", "bucket").agg(F.avg("value").alias("mean"))
    found = means.groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "mean"))).alias("by_bucket"))
    grid = F.sequence(F.lit(0), F.lit(buckets - 1))
    return found.select("series_id", F.transform(grid, lambda b: F.coalesce(F.element_at("by_bucket", b), F.lit(fill))).alias("values"))


def problems(series: DataFrame) -> DataFrame:
    """One row that counts what a series table may not have, in a single aggregate."""
    bad = F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return series.agg(
        F.count("*").alias("series"),
        F.count_if(F.col("values").isNull() | (F.size("values") <= 0)).alias("empty"),
        F.count_if(F.coalesce(bad, F.lit(False))).alias("not_finite"),
        F.count_if(F.col("label").isNull()).alias("unlabelled"),
        F.coalesce(F.min(F.size("values")), F.lit(0)).cast("long").alias("shortest"),
        F.coalesce(F.max(F.size("values")), F.lit(0)).cast("long").alias("longest"),
    )


def validate(series: DataFrame) -> DataFrame:
    """The table itself, or ValueError if it has null, empty, ragged or non-finite series, or missing labels."""
    found = problems(series).head().asDict()
    if found["empty"] or found["not_finite"] or found["unlabelled"] or found["shortest"] != found["longest"]:
        raise ValueError(f"the series are not valid: {found}")
    return series


def is_test(key: Column, every: int = 5) -> Column:
    return key % every == 0

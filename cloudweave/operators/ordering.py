"""Places in a random order, without a window over the whole table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_of(seed: int, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))


def ranked(rows: DataFrame, order: Column, key: str, *group: str, name: str = "rank") -> DataFrame:
    """rows with their place, from 1, by (order, key) within group; order is the text of an md5.

    Rows are counted by the first three digits of order and numbered within them, so a group of any size is spread
    over 4,096 windows; what is summed over a whole group is one count for each. A null is a group like others.
    """
    marked = rows.withColumn("_order", order).withColumn("_cell", F.substring("_order", 1, 3))
    counts = marked.groupBy(*group, "_cell").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    before = before.select("_before", *(F.col(c).alias(f"_b_{c}") for c in (*group, "_cell")))
    own = F.row_number().over(Window.partitionBy(*group, "_cell").orderBy("_order", key))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in (*group, "_cell")))
    return marked.withColumn("_own", own).join(before, same).withColumn(name, F.col("_own") + F.col("_before")).select(*rows.columns, name)

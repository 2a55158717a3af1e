"""A session with the settings that the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    built = SparkSession.builder.master(master).appName("cloudweave").config(map=settings).getOrCreate()
    built.sparkContext.setLogLevel("ERROR")
    return built

"""Runtime options the library's jobs are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution splits hot keys in joins even when a further shuffle follows.
OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in OPTIONS.items():
        spark.conf.set(name, value)
    return spark

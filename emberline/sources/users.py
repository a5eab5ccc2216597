"""User dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_users(src: DataFrame, date: dt.date) -> DataFrame:
    """Latest document per user, by (updated_at, doc_id), stamped with the load date.

    A maximum is combined on the map side, so a user with many documents does not
    gather in one task.
    """
    latest = src.groupBy("user_id").agg(
        F.max(F.struct("updated_at", "doc_id", "name", "nation", "segment")).alias("doc")
    )
    return latest.select(
        "user_id",
        *[F.col(f"doc.{name}").alias(name) for name in ("name", "nation", "segment")],
        F.lit(date).alias("load_date"),
    )


def save_users(users: DataFrame, path: str) -> None:
    """Write a load as its own partition; a rerun of the day replaces it."""
    users.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "load_date"
    ).parquet(path)

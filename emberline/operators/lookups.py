"""Joins to dimensions and calendars."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.calendar import event_date, hour_calendar
from emberline.settings import Settings


# What a stored byte may take up once decoded.
UNPACKED = 4


def planned_bytes(df: DataFrame) -> int:
    """Size of a dimension: the optimizer's estimate, or that of the files it is read from.

    The estimate of a join multiplies its sides, which says nothing about a dimension
    joined to its own lookups; what is read, unpacked, bounds such a frame.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return min(int(plan.stats().sizeInBytes()), UNPACKED * read)


def small_side(df: DataFrame, limit_bytes: int) -> DataFrame:
    """Mark a join side for broadcast only when its estimate is within the limit.

    Above it the frame is returned as is: the join is then shuffled on its key and
    adaptive execution splits the partitions of hot keys.
    """
    return F.broadcast(df) if planned_bytes(df) <= limit_bytes else df


def enrich(df: DataFrame, users: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Attach nation and segment of the user; rows without a user keep NULLs."""
    dim = users.select("user_id", "nation", "segment")
    return df.join(small_side(dim, cfg.broadcast_bytes), "user_id", "left").select(
        *df.columns, "nation", "segment"
    )


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """Store a table in the catalog, hashed into buckets by a key and sorted within them.

    Rows are dealt by the key before, so that a bucket is one file.
    """
    df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def enrich_bucketed(spark: SparkSession, facts: str, users: str, key: str = "user_id") -> DataFrame:
    """`enrich` for a dimension too large to broadcast: both tables lie in as many buckets of the key.

    Buckets meet one to one, and neither table is shuffled, however large. The join is asked
    to sort and merge, so that a bucket need not fit in memory.
    """
    left, dim = spark.table(facts), spark.table(users).select(key, "nation", "segment")
    return left.join(dim.hint("merge"), key, "left").select(*left.columns, "nation", "segment")


def missing_partitions(df: DataFrame, lo: dt.date, hi: dt.date) -> DataFrame:
    """Hours of a date range without any row."""
    seen = df.select(event_date().alias("event_date"), "event_hour").distinct()
    calendar = hour_calendar(df.sparkSession, lo, hi)
    return calendar.join(seen, ["event_date", "event_hour"], "left_anti")


class Lookup:
    """A static side that is loaded again once it is older than `every` seconds."""

    def __init__(
        self,
        loader: Callable[[], DataFrame],
        every: float,
        on: str,
        cfg: Settings = Settings(),
        clock: Callable[[], float] = time.monotonic,
    ):
        self._loader, self._every, self._on = loader, every, on
        self._cfg, self._clock = cfg, clock
        self._side: DataFrame | None = None
        self._loaded_at = 0.0
        self.loads = 0

    def side(self) -> DataFrame:
        now = self._clock()
        if self._side is None or now - self._loaded_at >= self._every:
            # Pinned, so that batches do not read files that may have been replaced.
            old, self._side, self._loaded_at = self._side, self._loader().persist(), now
            self._side.count()
            if old is not None:
                old.unpersist()
            self.loads += 1
        return self._side

    def join(self, batch: DataFrame) -> DataFrame:
        return batch.join(small_side(self.side(), self._cfg.broadcast_bytes), self._on, "left")

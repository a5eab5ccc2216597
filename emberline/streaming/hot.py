"""The hot table: keyed upsert on plain partitioned files.

A batch appends one part with its own merged rows; readers merge the parts by key.
Because the merge is idempotent, a part that is written twice, or that exists both by
itself and inside a fold, changes nothing. So a write never has to read or replace
existing rows, and a fold can write its result before it deletes what it covers.

Folders are half-day ranges, the unit in which hot rows are dropped. A batch with
stragglers of many hours then writes few files. Inside a folder rows are ordered by
hour, so that a read of one hour skips row groups.
"""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.columns import mapped_targets, partition_last, with_partitions
from emberline.operators.merge import merge_states, present, to_states, unfolded
from emberline.schema import DETAILS, HOT, HOT_ATTRIBUTES, PARTS, RANGES
from emberline.settings import Settings
from emberline.sources import folders
from emberline.sources.events import ROW_GROUP


def write_part(states: DataFrame, path: str, few: bool = False) -> None:
    """Write merged rows as one part, replacing it when it is there already.

    `few` says that one task has them all: they are not dealt out then.
    """
    half = F.expr("if(event_hour < 12, 0, 12)").alias("lower_hour")
    rows = states.select(*[half if name == "lower_hour" else name for name in HOT.fieldNames()])
    (
        (rows if few else rows.hint("rebalance", *RANGES))
        .sortWithinPartitions(*RANGES, "event_hour")
        .write.mode("overwrite")
        .option("parquet.block.size", ROW_GROUP)
        .partitionBy(*RANGES)
        .parquet(path)
    )


def upsert(batch: DataFrame, batch_id: int, target: str, writer: str = "batch", few: bool = False) -> None:
    """Write a batch of events as part `<writer>-<batch_id>`; a replay replaces it.

    The partition is taken from each message before anything is merged, as readers
    group by it too: where batches begin and end changes nothing.
    """
    states = merge_states(with_partitions(to_states(batch, HOT_ATTRIBUTES)), HOT_ATTRIBUTES, stable=PARTS)
    write_part(states, f"{target}/part={writer}-{batch_id:010d}", few)


def listed(spark: SparkSession, target: str) -> list[str]:
    """Range folders of all parts, as they are now."""
    return folders.partition_dirs(spark, target, ["part", *RANGES])


def stored(spark: SparkSession, target: str, paths: list[str] | None = None) -> DataFrame:
    """Rows of the listed range folders as they were written; a part that lands later is not seen."""
    return folders.read_listed(spark, target, HOT, listed(spark, target) if paths is None else paths)


def merged(rows: DataFrame) -> DataFrame:
    """One mergeable row per key.

    The partition tuple of a key never changes and is grouped on, so filters on it
    pass below the merge: the date prunes folders, the hour row groups.
    """
    return partition_last(merge_states(rows, HOT_ATTRIBUTES, stable=PARTS))


def read_hot(spark: SparkSession, target: str) -> DataFrame:
    """One row per key: flags, zone and every mapped field. What is not read is not merged.

    A range that one part alone holds, as after a fold, is merged already and is read as
    it is, without a shuffle.
    """
    found = listed(spark, target)
    held = Counter(path.split("/", 1)[1] for path in found)
    many = [numbered(folder) for folder, parts in held.items() if parts > 1]
    rows = stored(spark, target, found)
    plain = [name for name in HOT.fieldNames() if name != "lower_hour"]
    if len(many) == len(held):
        whole = merged(rows)
    else:
        several = range_number(*map(F.col, RANGES)).isin(many)
        whole = rows.where(~several).select(*plain)
        if many:
            whole = merged(rows.where(several)).unionByName(whole)
    return present(unfolded(whole, DETAILS, mapped_targets()))


def crowded_ranges(spark: SparkSession, target: str, min_parts: int) -> dict[str, list[str]]:
    """Range folders held by at least `min_parts` committed parts, with those parts.

    A part still being written has no commit marker and is left alone. Two entries per
    date of the hot window; no file is opened.
    """
    found = listed(spark, target)
    done = {part for part in folders.children(spark, target) if folders.committed(spark, f"{target}/{part}")}
    held = [path.split("/", 1) for path in found if path.split("/", 1)[0] in done]
    sizes = Counter(folder for _, folder in held)
    out: dict[str, list[str]] = {}
    for part, folder in held:
        if sizes[folder] >= min_parts:
            out.setdefault(folder, []).append(part)
    return out


def range_number(year, month, day, hour):
    """The range tuple as one number; tests on it still prune folders."""
    return ((year * 100 + month) * 100 + day) * 100 + hour


def numbered(folder: str) -> int:
    """The number of a range folder `event_year=2024/.../lower_hour=12`."""
    return range_number(*[int(level.split("=")[1]) for level in folder.split("/")])


def fold(spark: SparkSession, target: str, min_parts: int = Settings().fold_after_parts) -> list[str]:
    """Merge the parts of crowded ranges into one; return the ranges folded.

    Run one fold at a time per table. Streams may go on writing meanwhile.
    """
    crowded = crowded_ranges(spark, target, min_parts)
    if not crowded:
        return []
    covered = [f"{part}/{folder}" for folder, parts in crowded.items() for part in parts]
    write_part(merged(stored(spark, target, covered)), f"{target}/part=fold-{uuid.uuid4().hex}")
    for folder, parts in crowded.items():
        for part in parts:
            folders.delete(spark, f"{target}/{part}/{folder}")
    for part in {part for parts in crowded.values() for part in parts}:
        folders.delete_if_spent(spark, f"{target}/{part}")
    return sorted(crowded)

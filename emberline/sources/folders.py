"""Shared folders: where jobs may write, and partition directories."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder under the one the cluster names in `spark.checkpoint.dir`.

    Only a local session may go without that setting; it gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/emberline/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{tempfile.mkdtemp(prefix='run-')}/{name}"


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder; False when there was none."""
    fs, where = _open(spark, path)
    return fs.delete(where, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, where = _open(spark, target)
    fs.mkdirs(where.getParent())
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(source), where):
        raise OSError(f"could not move {source} to {target}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the visible folders directly under a path."""
    fs, where = _open(spark, path)
    if not fs.exists(where):
        return []
    names = [entry.getPath().getName() for entry in fs.listStatus(where) if entry.isDirectory()]
    return sorted(name for name in names if not name.startswith(("_", ".")))


def files(spark: SparkSession, path: str) -> set[str]:
    """Names of the visible files directly under a path."""
    fs, where = _open(spark, path)
    names = [entry.getPath().getName() for entry in fs.listStatus(where) if entry.isFile()] if fs.exists(where) else []
    return {name for name in names if not name.startswith(("_", "."))}


def committed(spark: SparkSession, path: str) -> bool:
    """A write into the folder has finished and left its marker."""
    return exists(spark, f"{path}/_SUCCESS")


def delete_if_spent(spark: SparkSession, path: str) -> bool:
    """Delete a committed folder whose last partition is gone, also from its years."""
    fs, where = _open(spark, path)
    if not committed(spark, path):
        return False
    files = fs.listFiles(where, True)
    while files.hasNext():
        if not files.next().getPath().getName().startswith(("_", ".")):
            return False
    return delete(spark, path)


def partition_dirs(spark: SparkSession, path: str, levels: list[str]) -> list[str]:
    """Relative directories `a=1/b=2/...` that exist for the given levels.

    A level is a column, for any value of it, or `column=value`.
    """
    pattern = [level if "=" in level else f"{level}=*" for level in levels]
    fs, where = _open(spark, "/".join([path, *pattern]))
    found = fs.globStatus(where) or []
    depth = len(levels)
    return sorted("/".join(entry.getPath().toString().split("/")[-depth:]) for entry in found)


def read_listed(spark: SparkSession, root: str, schema, paths: list[str]) -> DataFrame:
    """The rows under the listed partition folders of a table, and under no others.

    Folders are named as `partition_dirs` does, all by the same columns. The list is a filter
    on these, which prunes folders before any file is opened.
    """
    if not paths:
        return spark.createDataFrame([], schema)
    columns = [level.split("=", 1)[0] for level in paths[0].split("/")]
    name = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])
    return spark.read.schema(schema).parquet(root).where(name.isin(paths))


def day_dir(date) -> str:
    return f"event_year={date.year}/event_month={date.month}/event_day={date.day}"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole, in the place of one that is there; no job runs."""
    fs, where = _open(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delete_partitions(spark: SparkSession, path: str, parts: list[str]) -> None:
    """Delete partition folders, and the levels above that they leave empty."""
    for part in parts:
        delete(spark, f"{path}/{part}")
        above = part.rpartition("/")[0]
        while above and not children(spark, f"{path}/{above}"):
            delete(spark, f"{path}/{above}")
            above = above.rpartition("/")[0]

"""A message log in a shared folder, read as a stream with a record limit per batch.

A log has partitions, a partition has segments: `log_partition=2/base=5000/part-*.parquet`
holds the records from offset 5000 on, in order. The source plans a batch by offsets, at
most `maxRecords` of them, shared out over the partitions by what each has waiting; tasks
then read their slices of the segments. A restarted query goes on at its checkpoint.

Folders are opened by pyarrow, by a local path or a URI it knows.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RECORD = "log_partition int, offset bigint, event_id bigint, payload string"
COLUMNS = ["offset", "event_id", "payload"]


@dataclass(frozen=True)
class Topic:
    """A log to read: from its beginning, from its end, or from an offset per partition."""

    path: str
    starting: str | dict[str, int] = "earliest"


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


class Segments:
    """The segments of a log as they are stored; files never change, so each is opened once.

    `known` is what the last listing found: of each partition the base offsets, in order,
    and the end and path of the segment at each, up to one that is not there yet.
    """

    def __init__(self, path: str):
        self.fs, self.root = _open(path)
        self._rows: dict[str, int] = {}
        self.known: dict[str, tuple[list[int], list[tuple[int, str]]]] = {}

    def rows(self, path: str) -> int:
        if path not in self._rows:
            with self.fs.open_input_file(path) as file:
                self._rows[path] = pq.ParquetFile(file).metadata.num_rows
        return self._rows[path]

    def found(self) -> dict[str, list[tuple[int, str]]]:
        """Base offset and path of the segments of each partition, in order."""
        out: dict[str, list[tuple[int, str]]] = {}
        selector = arrow_fs.FileSelector(self.root, recursive=True, allow_not_found=True)
        for info in self.fs.get_file_info(selector):
            levels = info.path.split("/")
            if info.is_file and levels[-1].endswith(".parquet") and levels[-1][0] not in "_." and levels[-2].startswith("base="):
                out.setdefault(levels[-3].split("=")[1], []).append((int(levels[-2].split("=")[1]), info.path))
        return {name: sorted(found) for name, found in out.items()}

    def look(self) -> None:
        """List the log again."""
        self.known = {}
        for name, found in self.found().items():
            bases, held, end = [], [], 0
            for base, path in found:
                if base > end:
                    break
                end = base + self.rows(path)
                bases.append(base)
                held.append((end, path))
            self.known[name] = bases, held

    def known_ends(self) -> dict[str, int]:
        return {name: held[-1][0] if held else 0 for name, (_, held) in self.known.items()}

    def ends(self) -> dict[str, int]:
        """The offset after the last record of each partition, up to a segment that is not there yet."""
        self.look()
        return self.known_ends()

    def between(self, name: str, lo: int, hi: int) -> Iterator[tuple[int, int, str]]:
        """Base, end and path of the known segments that hold the offsets `lo` to `hi`."""
        bases, held = self.known.get(name, ([], []))
        at = max(bisect_right(bases, lo) - 1, 0)
        while at < len(bases) and bases[at] < hi:
            yield bases[at], *held[at]
            at += 1


def allotted(waiting: dict[str, int], limit: int) -> dict[str, int]:
    """Records to take of each partition: all, or `limit` in proportion to what waits, to the record."""
    total = sum(waiting.values())
    if total <= limit:
        return dict(waiting)
    share = {name: limit * n // total for name, n in waiting.items()}
    # What rounding left goes to the largest remainders.
    order = sorted(waiting, key=lambda name: (-(limit * waiting[name] % total), name))
    for name in order[: limit - sum(share.values())]:
        share[name] += 1
    return share


@dataclass
class Slice(InputPartition):
    """Records `lo` to `hi` of a segment that begins at `base`."""

    path: str
    name: str
    base: int
    lo: int
    hi: int


@dataclass
class Slices(InputPartition):
    """Slices that one task reads, one after the other."""

    held: list[Slice]


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("maxRecords", 1 << 62))
        self.one_task = options.get("oneTask", "false") == "true"
        self.starting = json.loads(options.get("startingOffsets", '"earliest"'))
        self.segments = Segments(self.path)
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        if self.starting == "latest":
            self.at = self.segments.ends()
        else:
            self.at = {} if self.starting == "earliest" else dict(self.starting)
        return self.at

    def latestOffset(self) -> dict:
        """The log is listed again once less than a batch is known to wait, so that a long log is not listed for every batch."""
        if self.at is None:
            self.initialOffset()
        waiting = self._waiting()
        if sum(waiting.values()) < self.limit:
            self.segments.look()
            waiting = self._waiting()
        taken = allotted(waiting, self.limit)
        return {name: self.at.get(name, 0) + taken.get(name, 0) for name in sorted({*waiting, *self.at})}

    def _waiting(self) -> dict[str, int]:
        return {name: max(0, end - self.at.get(name, 0)) for name, end in self.segments.known_ends().items()}

    def partitions(self, start: dict, end: dict) -> list[Slice] | list[Slices]:
        """Slices between two offsets. A restarted query asks for none, from where it stands: the place to go on."""
        self.at = dict(end)
        if start == end:
            return []
        known = self.segments.known_ends()
        if any(hi > known.get(name, 0) for name, hi in end.items()):
            self.segments.look()
        out = []
        for name, hi in sorted(end.items()):
            lo = start.get(name, 0)
            for base, last, path in self.segments.between(name, lo, hi):
                if max(lo, base) < min(hi, last):
                    out.append(Slice(path, name, base, max(lo, base), min(hi, last)))
        return [Slices(out)] if self.one_task and out else out

    def read(self, partition: Slice | Slices) -> Iterator[pa.RecordBatch]:
        source = _open(self.path)[0]
        for piece in partition.held if isinstance(partition, Slices) else [partition]:
            yield from self._slice(source, piece)

    def _slice(self, source: arrow_fs.FileSystem, partition: Slice) -> Iterator[pa.RecordBatch]:
        with source.open_input_file(partition.path) as file:
            at = partition.base
            for batch in pq.ParquetFile(file).iter_batches(4096, columns=COLUMNS):
                lo, hi = max(partition.lo - at, 0), min(partition.hi - at, batch.num_rows)
                at += batch.num_rows
                if lo < hi:
                    kept = batch.slice(lo, hi - lo)
                    number = pa.array([int(partition.name)] * kept.num_rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([number, *[kept.column(c) for c in COLUMNS]], names=["log_partition", *COLUMNS])
                if at >= partition.hi:
                    return

    def commit(self, end: dict) -> None:
        self.at = dict(end)


class LogSource(DataSource):
    """`spark.readStream.format("message_log")` with `path`, `maxRecords`, `startingOffsets` (JSON) and `oneTask`."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def read_log(spark: SparkSession, topic: Topic, max_records: int, one_task: bool = False) -> DataFrame:
    """Stream of a log's records, at most `max_records` of them in a batch.

    With `one_task` one task reads a batch, in a partition of its own: what follows needs no shuffle.
    """
    spark.dataSource.register(LogSource)
    reader = spark.readStream.format("message_log").option("path", topic.path).option("maxRecords", str(max_records))
    rows = reader.option("startingOffsets", json.dumps(topic.starting)).option("oneTask", str(one_task).lower()).load()
    return rows.coalesce(1) if one_task else rows


def append_log(messages: DataFrame, path: str, partitions: int = 4, segment_records: int = 100_000) -> None:
    """Append `event_id` and `payload` to a log; a message's partition follows from its id.

    One writer at a time. Offsets go on where the log ends. A partition is numbered by one
    task, as it is by one writer of a message topic.
    """
    ends = Segments(path).ends()
    after = F.coalesce(F.create_map(*[F.lit(x) for pair in ((int(k), v) for k, v in ends.items()) for x in pair])[F.col("log_partition")], F.lit(0)) if ends else F.lit(0)
    rows = messages.select("event_id", "payload", F.pmod(F.xxhash64("event_id"), F.lit(partitions)).cast("int").alias("log_partition"))
    number = F.row_number().over(Window.partitionBy("log_partition").orderBy("event_id")) - 1
    rows = rows.withColumn("_n", number).withColumn("_after", after.cast("bigint")).withColumn("offset", F.col("_n") + F.col("_after"))
    rows = rows.withColumn("base", F.col("offset") - F.col("_n") % segment_records)
    dealt = rows.repartition("log_partition", "base").sortWithinPartitions("log_partition", "base", "offset")
    dealt.select(*COLUMNS, "log_partition", "base").write.mode("append").partitionBy("log_partition", "base").parquet(path)

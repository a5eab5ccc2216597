"""Line dedup by sorted line hashes; decisions are bitmaps, not texts.

A line's key is the line without white space at both ends, A-Z lower-cased. Every line with
a key becomes a row of 128-bit hash, document and position. Spark deals the rows in ranges
of (hash, document, position) and sorts them; a task streams its range, run after run of
equal hashes. A line that a third of all documents hold fills several ranges, as any
other rows would: a range tells the driver one row about its first and last run, and gets
back what the runs that cross its borders hold in all.

A document that loses lines gets a bitmap of the lines it keeps, deflated. Texts move once,
to meet their bitmaps.

A document is a row; rows equal in id and text are one document, answered once per row.
Null and empty texts are one empty line. Lines without a key always stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import common
from emberline.llm.components import checkpointed

SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HASH, DOC = ["hi", "lo"], ["doc_id", "tag"]
OCCURRENCES = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("at", pa.int32())])


def keys_of(text: bytes) -> list[bytes]:
    """The keys of a text's lines."""
    return [line.strip(SPACE) for line in text.translate(_LOWER).split(b"\n")]


def _occurrences(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches, "text"):
            data, starts = common.flat(rows.column("text"))
            whole, spots, at, digests = data.tobytes(), [], [], []
            docs = list(zip(rows.column("doc_id").to_pylist(), rows.column("tag").to_pylist()))
            # Repeated rows are one document: of a chunk's copies one is sent.
            first = {doc: i for i, doc in reversed(list(enumerate(docs)))}
            for i in sorted(first.values()):
                for n, key in enumerate(keys_of(whole[starts[i] : starts[i + 1]])):
                    if len(key) >= least and (least < 2 or len(key.decode()) >= least):
                        spots.append(i)
                        at.append(n)
                        digests.append(xxhash.xxh3_128_digest(key))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            doc = [rows.column(name).combine_chunks().take(pa.array(spots, pa.int64())) for name in DOC]
            yield from common.frames({"hi": halves[:, 0], "lo": halves[:, 1], "doc_id": doc[0], "tag": doc[1], "at": np.array(at, np.int32)}, OCCURRENCES)

    return run


def _rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    rows = common.small_batches(documents).select(F.col(key).cast("long").alias("doc_id"), common.text_of(text).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("tag"), "text")


def sorted_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 1) -> DataFrame:
    """All lines with a key, dealt in ranges and sorted by hash, document and position.

    `part` numbers the ranges in their order. Kept in the shared folder, as its ranges
    are read twice.
    """
    order = ["hi", "lo", "doc_id", "tag", "at"]
    found = _rows(documents, key, text).mapInArrow(_occurrences(max(1, least_chars)), "hi long, lo long, doc_id long, tag long, at int")
    dealt = found.repartitionByRange(common.partitions(documents), *order).sortWithinPartitions(*order)
    return checkpointed(dealt.withColumn("part", F.spark_partition_id()))


@dataclass
class Run:
    """What is known of the lines of one hash: their documents, and the first of them."""

    docs: int
    head: tuple


def _marks(rows: pa.Table, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows in runs that begin at `at`: the rows that open a document, and documents per run."""
    new = np.zeros(rows.num_rows, bool)
    new[at[:-1]] = True
    none = rows.column("doc_id").is_null().to_numpy()
    for values in (rows.column("doc_id").fill_null(0).to_numpy(), none, rows.column("tag").to_numpy()):
        new[1:] |= values[1:] != values[:-1]
    return new, np.add.reduceat(new.astype(np.int64), at[:-1])


def _row(rows: pa.Table, i: int, *names: str) -> tuple:
    return tuple(rows.column(name)[int(i)].as_py() for name in names)


BORDERS = "part int, runs long, hi long, lo long, docs long, doc_id long, tag long, at int, last_hi long, last_lo long, last_docs long, last_doc_id long, last_tag long, last_at int, end_doc_id long, end_tag long"


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range: its first and its last run, with documents, first place and last document."""
    first = last = None
    runs = 0
    for rows, at in common.groups(batches, HASH):
        docs = _marks(rows, at)[1]
        runs += len(docs)
        if first is None:
            first = (*_row(rows, at[0], "hi", "lo"), int(docs[0]), *_row(rows, at[0], *DOC, "at"))
            part = _row(rows, 0, "part")
        last = (*_row(rows, at[-2], "hi", "lo"), int(docs[-1]), *_row(rows, at[-2], *DOC, "at"), *_row(rows, at[-1] - 1, *DOC))
    if first is not None:
        schema = pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.int64()) for f in BORDERS.split(", ")])
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*part, runs, *first, *last), schema)], schema=schema)


def crossing(borders: list) -> dict[int, tuple[Run, Run]]:
    """Per range, its first and last run as they are over all ranges. `borders`: rows of `_borders`."""
    found, open_, key, end = {}, None, None, None
    for x in sorted(borders, key=lambda x: x["part"]):
        begin = (x["hi"], x["lo"])
        if key == begin:
            # A document whose lines lie on both sides counts once.
            open_.docs += x["docs"] - (end == (x["doc_id"], x["tag"]))
        else:
            open_ = Run(x["docs"], (x["doc_id"], x["tag"], x["at"]))
        first = open_
        if x["runs"] > 1:
            open_ = Run(x["last_docs"], (x["last_doc_id"], x["last_tag"], x["last_at"]))
        key, end = (x["last_hi"], x["last_lo"]), (x["end_doc_id"], x["end_tag"])
        found[x["part"]] = (first, open_)
    return found


def _dropped(known: dict[int, tuple[Run, Run]], least: int | None):
    """Places of the lines that go: of runs of `least` documents all, or else all but the first."""

    def places(rows: pa.Table, gone: np.ndarray) -> pa.RecordBatch:
        return rows.select([*DOC, "at"]).filter(pa.array(gone)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        opening = True

        def judged(rows: pa.Table, at: np.ndarray, closing: bool):
            nonlocal opening
            new, docs = _marks(rows, at)
            first, last = known[_row(rows, 0, "part")[0]]
            sizes = np.diff(at)
            if opening:
                docs[0] = first.docs
            if closing:
                docs[-1] = last.docs
            if least is not None:
                gone = np.repeat(docs >= least, sizes)
            else:
                # The first place of a run stays, in all copies of its row.
                same = np.ones(rows.num_rows, bool)
                head = np.repeat(at[:-1], sizes)
                for values in (rows.column("at").to_numpy(), rows.column("tag").to_numpy(), rows.column("doc_id").fill_null(0).to_numpy(), rows.column("doc_id").is_null().to_numpy()):
                    same &= values == values[head]
                gone = ~same
                if opening:
                    begin = slice(0, int(sizes[0]))
                    doc, tag, spot = first.head
                    ids = rows.column("doc_id").slice(0, begin.stop)
                    alike = ids.is_null().to_numpy() if doc is None else ids.fill_null(0).to_numpy() == doc
                    alike &= ids.is_valid().to_numpy() if doc is not None else True
                    gone[begin] = ~(alike & (rows.column("tag").to_numpy()[begin] == tag) & (rows.column("at").to_numpy()[begin] == spot))
            opening = False
            yield from places(rows, gone)

        for rows, at in common.groups(batches, HASH):
            if held is not None:
                yield from judged(*held, False)
            held = rows, at
        if held is not None:
            yield from judged(*held, True)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, count = [], []
        for spots in batch.column("spots"):
            spots = np.unique(spots.values.to_numpy(zero_copy_only=False))
            bits = np.ones(-(-(int(spots[-1]) + 1) // 8) * 8, bool)
            bits[spots] = False
            packed.append(zlib.compress(np.packbits(bits).tobytes(), 6))
            count.append(len(spots))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(count, pa.int64()), pa.array(packed, pa.binary())], names=[*DOC, "n_dropped", "keep"])


def unpacked(keep: bytes, lines: int) -> np.ndarray:
    """A bitmap's bits; lines after its end stay."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).astype(bool)[:lines]
    return np.append(bits, np.ones(lines - len(bits), bool))


def bitmaps(documents: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int | None = None, least_chars: int = 1) -> DataFrame:
    """`doc_id`, `tag` (hash of the text), `n_dropped` and `keep` of each document that loses lines.

    Without `least_docs` the first line of each key stays, by document and position, and
    its later copies go; texts of one
    id come in the order of their tags. With it all lines go whose key at least so many documents hold.
    Keys of fewer than `least_chars` code points stay. `keep` has one bit per line, the
    first highest, up to the byte of the last line that goes; deflated.
    """
    lines = sorted_lines(documents, key, text, least_chars)
    # One row per range.
    known = crossing(lines.mapInArrow(_borders, BORDERS).collect())
    gone = lines.mapInArrow(_dropped(known, least_docs), "doc_id long, tag long, at int")
    spots = gone.groupBy("doc_id", "tag").agg(F.collect_set("at").alias("spots"))
    return spots.mapInArrow(_bitmaps, "doc_id long, tag long, n_dropped long, keep binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in common.gathered(batches, "text"):
        data, starts = common.flat(rows.column("text"))
        whole, texts, counts = data.tobytes(), [], []
        for i, keep in enumerate(rows.column("keep").to_pylist()):
            lines = whole[starts[i] : starts[i + 1]].split(b"\n")
            counts.append(len(lines))
            if keep is not None:
                lines = [line for line, stays in zip(lines, unpacked(keep, len(lines)).tolist()) if stays]
            texts.append(b"\n".join(lines))
        columns = [rows.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), rows.column("n_dropped").fill_null(0)]
        yield from pa.table(columns, names=["doc_id", "text", "n_lines", "n_dropped"]).combine_chunks().to_batches()


def without_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int | None = None, least_chars: int = 1) -> DataFrame:
    """`doc_id`, `text` as it is without the lines that `bitmaps` drops, `n_lines` before, `n_dropped`."""
    keep = bitmaps(documents, key, text, least_docs, least_chars).withColumnsRenamed({"doc_id": "doc", "tag": "mark"})
    rows = _rows(documents, key, text)
    met = rows.join(keep, rows["doc_id"].eqNullSafe(keep["doc"]) & (rows["tag"] == keep["mark"]), "left")
    return met.select("doc_id", "text", "n_dropped", "keep").mapInArrow(_kept, "doc_id long, text string, n_lines long, n_dropped long")


def digests(documents: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int | None = 10, least_chars: int = 1) -> DataFrame:
    """`doc_id`, `n_lines`, `n_dropped` and `kept_sha256` of every row, as `without_lines` leaves it."""
    left = without_lines(documents, key, text, least_docs, least_chars)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT n, doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM docs
),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
),
common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT (doc_id, text)) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY spot) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (key) GROUP BY n, doc_id
"""

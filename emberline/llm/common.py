"""Helpers the operators share: Arrow text as flat bytes, names of substrings, groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows of one Arrow batch: texts are long, so that a batch stays at a few MB.
ARROW_ROWS = 256
# Bytes of text that a task holds at once, unless a single text is longer.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with batches small enough for long texts."""
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def small_batches(df: DataFrame) -> DataFrame:
    """The frame; its session hands rows to tasks in batches small enough for long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """A text column, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def identified(df: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    """`doc_id`, `no_id`, `id`, `text` and the columns `others` of every row; the first two name its document.

    A document is an id, the row's own, and a text. Rows without an id, and those that
    repeat an id with another text, are named by a hash of both (`no_id` is true); of the
    texts of an id the one with the least hash keeps it.
    """
    from emberline.llm.components import Stored

    rows = small_batches(df).select(F.col(key).cast("long").alias("id"), text_of(text).alias("text"), *others)
    whole = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(" "), F.col("text"))
    mark = F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")
    marks = rows.where("id is not null").select("id", mark.alias("mark")).groupBy("id").agg(F.min("mark").alias("_least"), F.max("mark").alias("_most"))
    several = Stored(marks.where("_least <> _most").select(F.col("id").alias("_id"), "_least"))
    own = F.col("id").isNull()
    if several.rows.isEmpty():
        several.drop()
    else:
        # Few as a rule: the size of what was stored tells whether texts have to move to meet it.
        rows = rows.join(several.rows, F.col("id") == F.col("_id"), "left")
        own = own | F.coalesce(F.col("_least") != mark, F.lit(False))
    # Never null, and known not to be: a join adds no filter for it, and plans share the exchange.
    named = F.coalesce(F.when(own, mark).otherwise(F.col("id")), F.lit(0))
    return rows.select(named.alias("doc_id"), own.alias("no_id"), "id", "text", *others)


def one_row_per(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document of `identified`, dealt by its name, so that plans that use it more than once share one exchange."""
    first = Window.partitionBy("doc_id", "no_id").orderBy("id")
    rows = identified(df, key, text).repartition("doc_id", "no_id")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values after each other, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Tables of at most about `limit` bytes of text, or of one longer text."""
    held, size = [], 0
    for batch in batches:
        for row in _cut(batch, text, limit):
            held.append(row)
            size += row.column(row.schema.get_field_index(text)).nbytes
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cut(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    data, starts = flat(batch.column(batch.schema.get_field_index(text)))
    if len(data) <= limit:
        yield batch
        return
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + limit, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def frames(arrays: dict[str, np.ndarray | pa.Array], schema: pa.Schema, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Columns as Arrow batches of bounded size."""
    cols = [a if isinstance(a, pa.Array) else pa.array(a, schema.field(n).type) for n, a in arrays.items()]
    whole = pa.Table.from_arrays(cols, schema=schema)
    yield from whole.to_batches(max_chunksize=rows)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups of a partition sorted by `keys`, and where each group begins.

    Several small groups come together. A table ends with a group, so that it holds
    `limit` rows and the rest of one group at most.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def starts(whole: pa.Table) -> np.ndarray:
        new = np.zeros(whole.num_rows, bool)
        new[0] = True
        for key in keys:
            values = whole.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(new), whole.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= limit:
            whole = pa.Table.from_batches(held).combine_chunks()
            at = starts(whole)
            if len(at) > 2:
                yield whole.slice(0, at[-2]), at[:-1]
            rest = whole.slice(at[-2])
            held, size = rest.to_batches(), rest.num_rows
            if len(at) == 2:
                limit = max(limit, 2 * size)
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole, starts(whole)


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values with every input bit spread over all output bits."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(32)
    return values


FILTER_BITS, FILTER_BLOCK = 25, 15


def _packed_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for cells in batch.column("cells"):
            bits = np.zeros(1 << FILTER_BLOCK, bool)
            bits[cells.values.to_numpy(zero_copy_only=False)] = True
            out.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], names=["block", "bits"])


def bit_filter(df: DataFrame, column: str) -> np.ndarray:
    """Packed bits, one set for each 64-bit name by its first bits: 4 MB whatever the table.

    Tells which names the column may hold; false positives grow with the table.
    """
    cell = F.shiftrightunsigned(column, 64 - FILTER_BITS)
    cells = df.select(F.shiftright(cell, FILTER_BLOCK).cast("int").alias("block"), cell.bitwiseAND((1 << FILTER_BLOCK) - 1).cast("int").alias("cell"))
    blocks = cells.groupBy("block").agg(F.collect_set("cell").alias("cells")).mapInArrow(_packed_bits, "block int, bits binary")
    out = np.zeros((1 << (FILTER_BITS - FILTER_BLOCK), 1 << (FILTER_BLOCK - 3)), np.uint8)
    for row in blocks.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def may_hold(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which of the names a `bit_filter` may hold."""
    cell = names >> np.uint64(64 - FILTER_BITS)
    return (bits[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 > 0


class Names:
    """64-bit names of all substrings of a piece of up to `size` units.

    The name of a substring is the sum of a random value per unit times a power of an
    odd number, shifted back to the substring's beginning: equal strings get equal
    names wherever they lie, and a name costs one subtraction and one product.
    """

    def __init__(self, size: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.values = random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.back = np.zeros(0, np.uint64)
        self.grow(size)

    def grow(self, size: int) -> None:
        """Make room for pieces of `size` units."""
        if size > len(self.powers):
            base = 0x5851F42D4C957F2D
            self.powers = self._powers(base, size)
            self.back = self._powers(pow(base, -1, 1 << 64), size + 1)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        steps = np.full(max(size, 1), np.uint64(base))
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def sums(self, units: np.ndarray) -> np.ndarray:
        """Running sums over units (bytes, or ready 64-bit values)."""
        values = self.values[units] if units.dtype == np.uint8 else units
        out = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(units)], out=out[1:])
        return out

    def all(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Names of all substrings of one length."""
        n = len(sums) - length
        return mixed((sums[length:] - sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of the substrings from `begin` to `end`, lengths mixed in."""
        return mixed((sums[end] - sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every window of `width` values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        n = len(values) - width + 1
        out = np.minimum(out[:n], out[width - have : width - have + n])
    return out

"""Suffix-array dedup: long byte strings that also start earlier are cut out.

Distributed prefix doubling. Positions carry a rank of the string that begins there;
ranks of short strings are paired into ranks of longer ones, and positions whose string
is unique leave:

1. A third of the length, at winnowed positions only: the position with the least name
   in each window of `length` bytes. Equal windows choose the same one, so a window whose
   position carries a unique string cannot repeat. Consecutive windows that share their
   position form a stretch. Of the stretches of one rank those that are equal to an
   earlier one are past the threshold and done; where a rank holds different stretches,
   these go on.
2. Two thirds of the length: the string at the position is doubled to the left for
   windows that reach that far left, to the right for the others. What is unique leaves.
3. The whole length, at every position of what is left: Spark sorts pairs of ranks of
   half the length, the second at an offset of half the length. A position with an
   earlier one of the same pair begins a repeated string.

Ranks are carried as 64-bit names, computed where the text lies, so that rounds move
pairs and positions, never text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm import common
from emberline.llm.components import checkpointed

# Positions worked on at once; a position fits in the low bits of a name.
BITS = 17
# Stretches of one rank that a task sends to the task of that rank; the rest of a
# common rank goes straight to round three, which spreads it by content.
SENT = 8

STRETCH, EXPAND, REMOVED = 0, 1, 2

# `at` is the chosen position's offset from the stretch's start.
PLACE = [("doc_id", pa.int64()), ("no_id", pa.bool_()), ("start", pa.int64()), ("n", pa.int32())]
ROUTED = pa.schema([("key", pa.int64()), ("ctx", pa.int64()), *PLACE, ("at", pa.int16()), ("kind", pa.int8())])
PLACED = pa.schema([*PLACE, ("at", pa.int16()), ("kind", pa.int8())])
DOUBLED = pa.schema([("rank", pa.int64()), *PLACE])
PAIRED = pa.schema([("left", pa.int64()), ("right", pa.int64()), *PLACE])


def stretches(data: np.ndarray, starts: np.ndarray, length: int, names: common.Names):
    """Of every stretch: document, start, windows, offset of its position, rank, name of the whole."""
    gram = length // 3
    step, out = (1 << BITS) - length, []
    low = np.uint64((1 << BITS) - 1)
    for at in range(0, max(len(data) - length + 1, 0), step):
        piece = data[at : at + step + length - 1]
        windows = len(piece) - length + 1
        sums = names.sums(piece)
        short = names.all(sums, gram)
        keyed = (short & ~low) | np.arange(len(short), dtype=np.uint64)
        chosen = (common.sliding_min(keyed, length - gram + 1)[:windows] & low).astype(np.int64)
        new = np.empty(windows, bool)
        new[0] = True
        np.not_equal(chosen[1:], chosen[:-1], out=new[1:])
        near = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(piece), "right")] - at
        for edge in (near, near - length + 1):
            new[edge[(edge >= 0) & (edge < windows)]] = True
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], windows)
        doc = np.searchsorted(starts, begin + at, "right") - 1
        real = begin + at + length <= starts[doc + 1]
        begin, end, doc = begin[real], end[real], doc[real]
        out.append((doc, begin + at - starts[doc], end - begin, chosen[begin] - begin, short[chosen[begin]], names.of(sums, begin, end + length - 1)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _firsts(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For rows in `order`, the index in that order of the first row of equal keys."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _route(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.Names(1 << BITS)
        for rows in common.gathered(batches, "text"):
            data, starts = common.flat(rows.column("text"))
            ids, none = rows.column("doc_id").to_numpy(), rows.column("no_id").to_numpy()
            row, start, n, at, key, ctx = stretches(data, starts, length, names)
            doc, lost = ids[row], none[row]
            # Within the chunk: a stretch equal to an earlier one is done.
            order = np.lexsort((start, doc, ~lost, ctx, key))
            earlier = _firsts(order, key, ctx) != np.arange(len(order))
            kind = np.full(len(order), STRETCH, np.int8)
            kind[order[earlier]] = REMOVED
            # The chunk's further stretches of a rank, beyond the first few.
            kept = order[~earlier]
            kind[kept[np.arange(len(kept)) - _firsts(kept, key) >= SENT]] = EXPAND
            spread = common.mixed(ctx + start.astype(np.uint64))
            key = np.where(kind == STRETCH, key, spread)
            # Neighbours that are done become one.
            gone = kind == REMOVED
            joined = np.zeros(len(gone), bool)
            joined[1:] = gone[1:] & gone[:-1] & (row[1:] == row[:-1])
            head = np.flatnonzero(~joined)
            n = np.add.reduceat(n, head) if len(head) else n
            out = {"key": key[head].view(np.int64), "ctx": ctx[head].view(np.int64), "doc_id": doc[head], "no_id": lost[head], "start": start[head], "n": n.astype(np.int32), "at": at[head].astype(np.int16), "kind": kind[head]}
            yield from common.frames(out, ROUTED)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round one over all stretches of the ranks dealt to a partition."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    key, ctx, doc, lost, start, kind = (rows.column(c).to_numpy() for c in ("key", "ctx", "doc_id", "no_id", "start", "kind"))
    at = np.flatnonzero(kind == STRETCH)
    order = at[np.lexsort((start[at], doc[at], ~lost[at], ctx[at], key[at]))]
    earlier = _firsts(order, key, ctx) != np.arange(len(order))
    kept = order[~earlier]
    head = _firsts(kept, key)
    shared = kept[np.bincount(head, minlength=len(kept))[head] > 1] if len(kept) else kept
    kind = kind.copy()
    kind[order[earlier]] = REMOVED
    kind[shared] = EXPAND
    out = np.flatnonzero(kind != STRETCH)
    yield from rows.select([f.name for f in PLACED]).set_column(5, "kind", pa.array(kind)).take(pa.array(out)).to_batches(1 << 16)


def _listed(rows: pa.Table) -> tuple[np.ndarray, pa.StructArray]:
    """Row of each span of the column `spans`, and the spans."""
    spans = rows.column("spans").combine_chunks()
    counts = np.diff(spans.offsets.to_numpy()) if len(spans) else np.zeros(0, np.int64)
    return np.repeat(np.arange(rows.num_rows), counts), spans.flatten()


def _pieces(data: np.ndarray, begin: np.ndarray, end: np.ndarray, names: common.Names):
    """Running sums of bytes, a piece at a time: indices of the spans within, base, sums.

    Spans must be sorted by `begin` and shorter than half a piece.
    """
    at = 0
    while at < len(begin):
        base = int(begin[at])
        cut = int(np.searchsorted(begin, base + (1 << (BITS - 1))))
        yield np.arange(at, cut), base, names.sums(data[base : int(end[at:cut].max())])
        at = cut


def _double(length: int):
    gram = length // 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.Names(1 << BITS)
        for rows in common.gathered(batches, "text"):
            data, starts = common.flat(rows.column("text"))
            row, spans = _listed(rows)
            start, n, at = (spans.field(c).to_numpy().astype(np.int64) for c in ("start", "n", "at"))
            ids, none = rows.column("doc_id").to_numpy(), rows.column("no_id").to_numpy()
            # Windows up to `gram` before the position reach the string doubled to the left.
            left = np.clip(at - gram + 1, 0, n)
            row, start, n, where, low, high = (
                np.concatenate(x) for x in ((row, row), (start, start + left), (left, n - left), (start + at, start + at), (start * 0 - gram, start * 0), (start * 0 + gram, start * 0 + 2 * gram))
            )
            real = np.flatnonzero(n > 0)
            real = real[np.argsort((starts[row] + where + low)[real], kind="stable")]
            row, start, n, where = row[real], start[real], n[real], (starts[row] + where)[real]
            begin, end = where + low[real], where + high[real]
            rank = [np.zeros(0, np.uint64)]
            for some, base, sums in _pieces(data, begin, end, names):
                rank.append(names.of(sums, begin[some] - base, end[some] - base))
            yield from common.frames({"rank": np.concatenate(rank).view(np.int64), "doc_id": ids[row], "no_id": none[row], "start": start, "n": n.astype(np.int32)}, DOUBLED)

    return run


def _pairs(length: int):
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.Names(1 << BITS)
        for rows in common.gathered(batches, "text", common.CHUNK_BYTES // 2):
            data, starts = common.flat(rows.column("text"))
            row, spans = _listed(rows)
            start, n = (spans.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
            ids, none = rows.column("doc_id").to_numpy(), rows.column("no_id").to_numpy()
            order = np.argsort(starts[row] + start, kind="stable")
            row, start, n = row[order], start[order], n[order]
            begin = starts[row] + start
            pairs = [(np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2]
            for some, base, sums in _pieces(data, begin, begin + n + length - 1, names):
                step = np.arange(n[some].sum()) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                where = np.repeat(begin[some] - base, n[some]) + step
                pairs.append((names.of(sums, where, where + half), names.of(sums, where + half, where + length), np.repeat(row[some], n[some]), np.repeat(start[some], n[some]) + step))
            left, right, row, start = (np.concatenate(x) for x in zip(*pairs))
            # With an earlier one in the chunk: done without the others.
            order = np.lexsort((start, ids[row], ~none[row], right, left))
            again = np.zeros(len(order), bool)
            again[order] = _firsts(order, left, right) != np.arange(len(order))
            # Neighbours that are done become one, dealt out at random to pass.
            joined = np.zeros(len(order), bool)
            joined[1:] = again[1:] & again[:-1] & (row[1:] == row[:-1]) & (start[1:] == start[:-1] + 1)
            head = np.flatnonzero(~joined)
            count = np.diff(np.append(head, len(order)))
            row, start, again = row[head], start[head], again[head]
            left = np.where(again, common.mixed(left[head] + start.astype(np.uint64)), left[head])
            right = np.where(again, np.uint64(0), right[head])
            size = np.where(again, count + length - 1, 0).astype(np.int32)
            yield from common.frames({"left": left.view(np.int64), "right": right.view(np.int64), "doc_id": ids[row], "no_id": none[row], "start": start, "n": size}, PAIRED)

    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.int16(): "short", pa.int8(): "byte", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _beside_text(docs: DataFrame, spans: DataFrame, *columns: str) -> DataFrame:
    listed = spans.groupBy("doc_id", "no_id").agg(F.collect_list(F.struct(*columns)).alias("spans"))
    return docs.join(listed, ["doc_id", "no_id"]).select("doc_id", "no_id", "text", "spans")


def removed_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """`doc_id`, `no_id` and `spans` (start, n) of the bytes to remove, for `one_row_per` rows."""
    routed = docs.mapInArrow(_route(length), _ddl(ROUTED)).repartition(common.partitions(docs), "key")
    placed = checkpointed(routed.mapInArrow(_compare, _ddl(PLACED)))
    whole = placed.where(F.col("kind") == REMOVED).select("doc_id", "no_id", "start", (F.col("n") + length - 1).alias("n"))
    shared = placed.where(F.col("kind") == EXPAND)
    doubled = _beside_text(docs, shared, "start", "n", "at").mapInArrow(_double(length), _ddl(DOUBLED))
    ranks = doubled.groupBy("rank").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("rank")
    repeated = doubled.join(ranks, "rank", "left_semi").select("doc_id", "no_id", "start", "n")
    pairs = _beside_text(docs, repeated, "start", "n").mapInArrow(_pairs(length), _ddl(PAIRED))
    place = F.struct(~F.col("no_id"), F.col("doc_id"), F.col("start"))
    first = F.min(place).over(Window.partitionBy("left", "right"))
    later = pairs.withColumn("first", first).where((F.col("n") > 0) | (F.col("first") < place))
    size = F.when(F.col("n") > 0, F.col("n")).otherwise(F.lit(length))
    found = later.select("doc_id", "no_id", "start", size.alias("n")).union(whole)
    return found.groupBy("doc_id", "no_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _cuts(rows: pa.Table):
    """Bytes, and which of them stay, of each row."""
    data, starts = common.flat(rows.column("text"))
    row, spans = _listed(rows)
    begin = starts[row] + spans.field("start").to_numpy()
    end = begin + spans.field("n").to_numpy()
    change = np.bincount(begin, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
    return data, starts, np.cumsum(change[: len(data)]) > 0


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in common.gathered(batches, "text", common.CHUNK_BYTES // 4):
        data, starts, cut = _cuts(rows)
        enter = cut.copy()
        enter[1:] &= ~cut[:-1]
        inner = starts[:-1][starts[:-1] < len(data)]
        enter[inner] = cut[inner]
        lost = np.concatenate([[0], np.cumsum(cut)])
        runs = np.concatenate([[0], np.cumsum(enter)])
        kept = []
        for a, b in zip(starts[:-1], starts[1:]):
            part = data[a:b]
            kept.append(hashlib.sha256(part[~cut[a:b]].tobytes() if lost[b] > lost[a] else part).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("id").combine_chunks(),
                pa.array(np.diff(starts)),
                pa.array(np.diff(lost[starts])),
                pa.array(np.diff(runs[starts])),
                pa.array(kept, pa.string()),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in common.gathered(batches, "text", common.CHUNK_BYTES // 4):
        data, starts, cut = _cuts(rows)
        # A character stays whole: it goes only if all its bytes do.
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if len(lead):
            gone = np.logical_and.reduceat(cut, lead)
            cut = np.repeat(gone, np.diff(np.append(lead, len(data))))
        kept = np.concatenate([[0], np.cumsum(~cut)])[starts]
        texts = pa.Array.from_buffers(pa.large_string(), rows.num_rows, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(data[~cut].tobytes())])
        out = rows.drop_columns(["text", "spans"]).append_column("text", texts.cast(pa.string()))
        yield from out.append_column("n_removed", pa.array(np.diff(starts) - np.diff(kept))).to_batches()


def _with_spans(docs: DataFrame, length: int, others: DataFrame | None = None) -> DataFrame:
    """Texts beside their spans, and beside the columns of `others` by the same keys."""
    none = F.array().cast("array<struct<start:long,n:int>>")
    keys = ["doc_id", "no_id"]
    spans = removed_spans(docs, length)
    if others is not None:
        spans = others.join(spans, keys, "left")
    joined = docs.join(spans, keys, "left").withColumn("spans", F.coalesce("spans", none))
    return joined.select("id", "text", "spans", *([] if others is None else others.drop(*keys).columns))


def repeated_bytes(documents: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What exact-substring removal leaves of every document.

    Removes each byte covered by a string of `length` bytes that also starts earlier: in
    a document with a smaller id, or earlier in the same one. Strings are judged on the
    input, overlaps count, and none crosses documents. A null text is empty. Rows equal in
    id and text are one document. Rows without an id, and further texts of an id (all but
    that with the least hash), are documents of their own, before all others and in the
    order of their hashes. Other columns are not read. An empty table gives an empty result.
    """
    docs = common.one_row_per(documents, key, text)
    return _with_spans(docs, length).mapInArrow(_judged, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """`doc_id`, the text that is left, `n_removed` bytes, and the columns `others`.

    Same rules as `repeated_bytes`; a character goes only if all its bytes are removed.
    Of rows of one document the smallest values of `others` stand.
    """
    docs = common.one_row_per(documents, key, text)
    rest = common.identified(documents, key, text, *others).select("doc_id", "no_id", F.struct(F.lit(0).alias("_"), *others).alias("rest"))
    rest = rest.groupBy("doc_id", "no_id").agg(F.min("rest").alias("rest"))
    kind = rest.schema["rest"].dataType.simpleString()
    out = _with_spans(docs, length, rest).mapInArrow(_rewritten, f"id long, rest {kind}, text string, n_removed long")
    return out.select(F.col("id").alias("doc_id"), "text", "n_removed", *[F.col("rest")[c].alias(c) for c in others])


# Every byte and every window of 100 bytes as a row; windows are told apart by their MD5.
ORACLE = """
    WITH given AS (
        SELECT DISTINCT doc_id AS id, coalesce(text, '') AS text FROM documents),
    marks AS (
        SELECT *, CAST('0x' || substr(md5(coalesce(CAST(id AS VARCHAR), '') || ' ' || text), 1, 15) AS BIGINT) AS mark FROM given),
    named AS (
        SELECT *, id IS NULL OR mark <> min(mark) OVER (PARTITION BY id) AS own FROM marks),
    docs AS (
        SELECT id, row_number() OVER (ORDER BY own DESC, CASE WHEN own THEN mark ELSE id END) AS d, hex(encode(text)) AS digits FROM named),
    sized AS (SELECT *, length(digits) // 2 AS n FROM docs),
    starts AS (
        SELECT d, p, md5(substr(digits, 2 * p + 1, 200)) AS content
        FROM (SELECT *, unnest(range(greatest(n - 99, 0))) AS p FROM sized) s),
    later AS (
        SELECT d, p FROM starts QUALIFY row_number() OVER (PARTITION BY content ORDER BY d, p) > 1),
    places AS (SELECT d, unnest(range(n)) AS i FROM sized),
    seen AS (
        SELECT b.d, i, max(p) OVER (PARTITION BY b.d ORDER BY i) AS last
        FROM places b LEFT JOIN later l ON b.d = l.d AND i = p),
    marked AS (SELECT d, i, coalesce(i - last < 100, false) AS cut FROM seen),
    edges AS (
        SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY d ORDER BY i), false) AS enters FROM marked),
    left_over AS (
        SELECT e.d, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE enters) AS n_spans,
               string_agg(substr(digits, 2 * i + 1, 2), '' ORDER BY i) FILTER (WHERE NOT cut) AS kept
        FROM edges e JOIN sized s ON e.d = s.d GROUP BY e.d)
    SELECT s.id AS doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM sized s LEFT JOIN left_over l ON s.d = l.d"""

"""Benchmark decontamination by spaced-seed hashing.

A seed is a hash of the tokens that a fixed mask selects; tokens it ignores may differ.
The two masks are lossless: whichever `WINDOW - NEED` tokens of a window are substituted,
one mask finds all its tokens untouched somewhere in the window (a test tries them all).
Hashes of test items and of documents are joined, and each hit is verified along its
diagonal: a window of `WINDOW` aligned tokens must agree in `NEED` or more.

A test set up to `INDEX_BYTES` is one broadcast index of its hashes. A larger one is joined:
seeds of both sides become rows, those of the documents only where a filter of fixed size
lets them pass, and Spark joins them by hash; hits meet their documents and the tokens of
their items, and are verified there. Documents are read as often whatever the test set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import common
from emberline.llm.components import checkpointed

WINDOW, NEED = 13, 11
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
# Items of fewer tokens are found word for word only.
LEAST = 8
# Bytes of test items up to which their hashes are one broadcast index.
INDEX_BYTES = 4 << 20

FOUND = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("agree", pa.int32()), ("window", pa.int32()), ("doc_token", pa.int64()), ("item_token", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]
)

WRITTEN = "doc_id long, item_id long, agree int, window int, doc_token long, item_token int, begin long, end long"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def window_of(tokens: int) -> tuple[int, int]:
    """Window and agreeing tokens asked of an item with so many tokens."""
    if tokens >= WINDOW:
        return WINDOW, NEED
    return tokens, tokens - tokens // 5 if tokens >= LEAST else tokens


def masks_for(tokens: int) -> tuple[tuple[int, ...], ...]:
    """Masks that miss no window of an item: short items get all that ignore the tokens which may differ."""
    if tokens >= WINDOW:
        return MASKS
    window, need = window_of(tokens)
    return tuple(combinations(range(window), need))


def tokens(data: np.ndarray, starts: np.ndarray, names: common.Names):
    """Name, document, first and last byte of each run of letters, digits and non-ASCII bytes."""
    lower = _LOWER[data]
    word = _WORD[lower]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = starts[:-1][starts[:-1] < len(data)]
    begin[edge] = word[edge]
    end = np.zeros(len(data) + 1, bool)
    end[1:] = word
    end[1:-1] &= ~word[1:] | begin[1:]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    sums = names.sums(lower)
    return names.of(sums, begin, end), np.searchsorted(starts, begin, "right") - 1, begin, end


def seeds(named: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the masked tokens from every token on."""
    n = max(len(named) - mask[-1], 0)
    total = np.full(n, np.uint64(sum(1 << m for m in mask)))
    for k, at in enumerate(mask):
        total += named[at : at + n] * np.uint64(2 * k * k + 6 * k + 1)
        total = common.mixed(total)
    return total


class Items:
    """Test items by the names of their tokens, one after the other."""

    def __init__(self, ids: np.ndarray, names: np.ndarray, starts: np.ndarray):
        self.ids, self.names, self.starts = ids, names, starts

    @staticmethod
    def read(ids: list[int], texts: pa.Array) -> Items:
        data, starts = common.flat(texts)
        named, item, _, _ = tokens(data, starts, common.Names(len(data)))
        return Items(np.array(ids, np.int64), named, np.searchsorted(item, np.arange(len(ids) + 1)))

    def seeds(self) -> Iterator[tuple[tuple[int, ...], int, np.ndarray]]:
        """Of every item and mask, the hashes from each of its tokens on."""
        for k in range(len(self.ids)):
            own = self.names[self.starts[k] : self.starts[k + 1]]
            for mask in masks_for(len(own)) if len(own) else ():
                yield mask, k, seeds(own, mask)

    def best(self, hits: np.ndarray, named: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Of each document and item the best window: rows of document, item, agreeing, window, token, item's token."""
        out = []
        sizes = np.diff(self.starts)
        for at in range(0, len(hits), 4096):
            part = hits[at : at + 4096]
            size = sizes[part[:, 1]]
            first = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(first, size)
            where = np.repeat(part[:, 2], size) + step
            inside = (where >= np.repeat(spans[part[:, 0]], size)) & (where < np.repeat(spans[part[:, 0] + 1], size))
            same = inside & (named[np.where(inside, where, 0)] == self.names[np.repeat(self.starts[part[:, 1]], size) + step])
            total = np.concatenate([[0], np.cumsum(same)])
            for width in np.unique(np.minimum(size, WINDOW)):
                rows = np.flatnonzero(np.minimum(size, WINDOW) == width)
                need = window_of(int(width))[1]
                counts = size[rows] - width + 1
                begin = np.repeat(first[rows], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                agree = total[begin + width] - total[begin]
                # Both ends of the window must lie in the document.
                agree = np.where(inside[begin] & inside[begin + width - 1], agree, 0)
                edge = np.cumsum(counts) - counts
                best = np.maximum.reduceat(agree, edge)
                spot = np.flatnonzero(agree == np.repeat(best, counts))
                spot = spot[np.searchsorted(spot, edge)] - edge
                ok = best >= need
                r = part[rows[ok]]
                out.append(np.stack([r[:, 0], r[:, 1], best[ok], np.full(ok.sum(), width), r[:, 2] + spot[ok], spot[ok]], axis=1))
        if not out:
            return np.zeros((0, 6), np.int64)
        found = np.concatenate(out)
        found = found[np.lexsort((found[:, 4], -found[:, 2], found[:, 1], found[:, 0]))]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        return found[new]


class Index(Items):
    """Items with their seeds sorted, to be looked up."""

    def __init__(self, items: Items):
        super().__init__(items.ids, items.names, items.starts)
        self.masks: dict[tuple[int, ...], list] = {}
        for mask, k, found in self.seeds():
            self.masks.setdefault(mask, []).append((found, np.full(len(found), k), np.arange(len(found))))
        self.tables = {}
        for mask, parts in self.masks.items():
            hashed, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashed, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(hashed & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.tables[mask] = (hashed[order], item[order], at[order], seen)
        del self.masks

    def hits(self, named: np.ndarray, doc: np.ndarray):
        """Distinct diagonals: item, and the token on which it begins (may lie outside)."""
        out = [np.zeros((0, 3), np.int64)]
        for mask, (hashed, item, at, seen) in self.tables.items():
            found = seeds(named, mask)
            near = np.flatnonzero(seen[(found & np.uint64(0xFFFFF)).astype(np.int64)])
            near = near[doc[near] == doc[near + mask[-1]]]
            low = np.searchsorted(hashed, found[near], "left")
            many = np.searchsorted(hashed, found[near], "right") - low
            near, low, many = near[many > 0], low[many > 0], many[many > 0]
            row = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            where = np.repeat(near, many)
            out.append(np.stack([doc[where], item[row], where - at[row]], axis=1))
        return np.unique(np.concatenate(out), axis=0)


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.Names(1 << 16)
        for rows in common.gathered(batches, "text", 1 << 20):
            data, starts = common.flat(rows.column("text"))
            names.grow(len(data))
            named, doc, begin, end = tokens(data, starts, names)
            spans = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            found = index.value.best(index.value.hits(named, doc), named, spans)
            yield from _written(rows, found, index.value.ids, spans, begin, end, starts)

    return run


def _written(rows: pa.Table, found: np.ndarray, items: np.ndarray, spans: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    d, item, agree, window, token, own = found.T
    out = {
        "doc_id": rows.column("doc_id").combine_chunks().take(pa.array(d)), "item_id": items[item], "agree": agree.astype(np.int32), "window": window.astype(np.int32),
        "doc_token": token - spans[d], "item_token": own.astype(np.int32), "begin": begin[token] - starts[d], "end": end[token + window - 1] - starts[d],
    }
    yield from common.frames(out, FOUND)


SEEDS = pa.schema([("hash", pa.int64()), ("item", pa.int64()), ("at", pa.int64())])


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = Items.read(batch.column("item").to_pylist(), batch.column("text"))
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        parts += [(found, np.full(len(found), items.ids[k]), np.arange(len(found))) for _, k, found in items.seeds()]
        hashed, item, at = (np.concatenate(x) for x in zip(*parts))
        yield from common.frames({"hash": hashed.view(np.int64), "item": item, "at": at}, SEEDS)


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = Items.read(batch.column("item").to_pylist(), batch.column("text"))
        names = pa.ListArray.from_arrays(pa.array(items.starts.astype(np.int32)), pa.array(items.names.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), names, pa.array(np.minimum(np.diff(items.starts), WINDOW).astype(np.int32))], names=["item", "item_id", "names", "size"])


def _doc_seeds(masks: list[tuple[int, ...]], bits):
    """Seeds of documents that items may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.Names(1 << 16)
        schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("token", pa.int64())])
        for rows in common.gathered(batches, "text", 1 << 20):
            data, starts = common.flat(rows.column("text"))
            names.grow(len(data))
            named, doc, _, _ = tokens(data, starts, names)
            first = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            ids, tags = (rows.column(c).combine_chunks() for c in ("doc_id", "tag"))
            for mask in masks:
                found = seeds(named, mask)
                at = np.flatnonzero(common.may_hold(bits.value, found))
                at = at[doc[at] == doc[at + mask[-1]]]
                of = pa.array(doc[at])
                yield from common.frames({"hash": found[at].view(np.int64), "doc_id": ids.take(of), "tag": tags.take(of), "token": at - first[doc[at]]}, schema)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents beside their hits and the tokens of the items hit."""
    names = common.Names(1 << 16)
    for rows in common.gathered(batches, "text", 1 << 20):
        data, starts = common.flat(rows.column("text"))
        names.grow(len(data))
        named, doc, begin, end = tokens(data, starts, names)
        spans = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        listed = rows.column("hits").combine_chunks()
        row = np.repeat(np.arange(rows.num_rows), np.diff(listed.offsets.to_numpy()))
        flat = listed.flatten()
        known, first, item = np.unique(flat.field("item").to_numpy(), return_index=True, return_inverse=True)
        lists = flat.field("names").take(pa.array(first))
        items = Items(flat.field("item_id").to_numpy()[first], lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(lists.value_lengths().to_numpy())))
        hits = np.unique(np.stack([row, item, flat.field("diagonal").to_numpy() + spans[row]], axis=1), axis=0)
        yield from _written(rows, items.best(hits, named, spans), items.ids, spans, begin, end, starts)


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Overlaps by a join of seeds. An item is known by a hash of its id and text, a document by id and hash."""
    keyed = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    own = checkpointed(keyed.mapInArrow(_item_tokens, "item long, item_id long, names array<long>, size int"))
    asked = checkpointed(keyed.select("item", "text").mapInArrow(_item_seeds, "hash long, item long, at long"))
    sizes = [x[0] for x in own.select("size").distinct().where("size > 0").collect()]  # at most WINDOW of them
    masks = sorted({mask for size in sizes for mask in masks_for(size)})
    bits = docs.sparkSession.sparkContext.broadcast(common.bit_filter(asked, "hash"))
    tagged = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    seen = tagged.mapInArrow(_doc_seeds(masks, bits), "hash long, doc_id long, tag long, token long")
    hits = seen.join(asked, "hash").select("doc_id", "tag", "item", (F.col("token") - F.col("at")).alias("diagonal")).distinct()
    beside = hits.join(own, "item").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("item", "item_id", "diagonal", "names")).alias("hits"))
    beside = beside.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "hits")
    met = tagged.join(beside, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")))
    return met.select("doc_id", "text", "hits").mapInArrow(_met, WRITTEN)


def overlaps(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", limit: int = INDEX_BYTES) -> DataFrame:
    """One row per document and test item that overlap: the best window and where it lies.

    `agree` of `window` tokens are equal; `doc_token` and `item_token` are where the
    window begins, `begin` and `end` its bytes in the document. Tokens are runs of
    letters, digits and non-ASCII characters, A-Z lower-cased. Items of `WINDOW` or more
    tokens need a window of them with `NEED` equal; shorter ones count as a whole with a
    fifth of the tokens free to differ, and those below `LEAST` tokens with none. Null texts
    have no tokens, rows without an item id are not searched for, repeated items count once; of ties the earliest
    window stands. Repeated documents give a row each. Other columns are not read.
    """
    docs = common.small_batches(documents).select(F.col(key).cast("long").alias("doc_id"), common.text_of(text).alias("text"))
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), common.text_of(item_text).alias("text")).where("item_id is not null").distinct()
    if (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > limit:
        return _joined(docs, items)
    held = items.toArrow()
    index = docs.sparkSession.sparkContext.broadcast(Index(Items.read(held.column("item_id").to_pylist(), held.column("text"))))
    return docs.mapInArrow(_search(index), WRITTEN)


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that overlap no test item. Rows without an id are judged by a join on null-safe ids."""
    found = overlaps(documents, benchmark).select(F.col("doc_id").alias("_found")).distinct()
    return documents.join(found, documents["doc_id"].eqNullSafe(found["_found"]), "left_anti")


def _tokens_sql(name: str, table: str, key: str, where: str) -> str:
    """Tokens of a table's texts with their places and the bytes at which they begin and end."""
    run = r"[a-z0-9\x{80}-\x{10FFFF}]+"
    return f"""
        {name}_texts AS (
            SELECT row_number() OVER () AS row, {key} AS id,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM {table} WHERE {where}),
        {name}_lists AS (
            SELECT row, id, regexp_extract_all(t, '{run}') AS tokens, string_split_regex(t, '{run}') AS gaps
            FROM {name}_texts),
        {name}_rows AS (
            SELECT row, id, len(tokens) AS n, unnest(tokens) AS token, unnest(gaps[1:len(tokens)]) AS gap,
                   unnest(range(len(tokens))) AS place
            FROM {name}_lists),
        {name} AS (
            SELECT row, id, n, token, place, ends - strlen(token) AS begins, ends FROM (
                SELECT *, sum(strlen(gap) + strlen(token)) OVER (PARTITION BY row ORDER BY place) AS ends FROM {name}_rows) x)"""


_NEED = f"CASE WHEN n >= {WINDOW} THEN {NEED} WHEN n >= {LEAST} THEN n - n // 5 ELSE n END"

# All diagonals of all documents and items by equal tokens, then all windows of those
# that have enough.
ORACLE = f"""
    WITH {_tokens_sql("doc", "documents", "doc_id", "true")},{_tokens_sql("item", "(SELECT DISTINCT item_id, text FROM benchmark)", "item_id", "item_id IS NOT NULL")},
        asked AS (
            SELECT DISTINCT row, id, n, least(n, {WINDOW}) AS width,
                   {_NEED} AS need FROM item),
        diagonals AS (
            SELECT d.row AS doc, i.row AS item, d.place - i.place AS diagonal, list(i.place) AS same
            FROM doc d JOIN item i ON d.token = i.token
            GROUP BY ALL HAVING count(*) >= any_value({_NEED.replace("n ", "i.n ")})),
        windows AS (
            SELECT doc, item, diagonal, width, need, a.id AS item_id, same, unnest(range(a.n - width + 1)) AS start
            FROM diagonals g JOIN asked a ON a.row = item WHERE len(same) >= need),
        counted AS (
            SELECT w.*, len(list_filter(same, lambda p: p >= start AND p < start + width)) AS agree
            FROM windows w JOIN (SELECT DISTINCT row, n FROM doc) d ON d.row = doc
            WHERE diagonal + start >= 0 AND diagonal + start + width <= d.n),
        best AS (
            SELECT * FROM counted WHERE agree >= need
            QUALIFY row_number() OVER (PARTITION BY doc, item ORDER BY agree DESC, diagonal + start, diagonal) = 1)
    SELECT f.id AS doc_id, item_id, CAST(agree AS INT) AS agree, CAST(width AS INT) AS "window",
           CAST(diagonal + start AS BIGINT) AS doc_token, CAST(start AS INT) AS item_token,
           CAST(f.begins AS BIGINT) AS "begin", CAST(l.ends AS BIGINT) AS "end"
    FROM best JOIN doc f ON f.row = doc AND f.place = diagonal + start
    JOIN doc l ON l.row = doc AND l.place = diagonal + start + width - 1"""

"""Near copies by the Jaccard similarity of word shingles.

A text is the set of its shingles. Equal sets are one node. Every node has a signature of
minima of its set under random orders. The index posts it under a few minima at a time;
a byte of each minimum is its sketch. Two sets of similarity 0.8 share a posting list
with a chance of 0.9998, sets of 0.3 one time in fifty; what shares a list is a candidate
and no more. SimHash gives candidates too: texts whose fingerprints differ in four bits or
fewer, by its index of byte positions (`simhash.py`). Links are verified on whole sets before
anything is closed over them:

0. Of each fingerprint every node meets the least node; the least nodes of fingerprints that
   the SimHash index links meet.
1. In each list of two nodes or more, every node meets the list's least node. Pairs whose
   sketches are far apart go, the others are compared.
2. Where a list is not joined by that, its nodes meet in tasks, by blocks, with the
   parts found so far. Sketches tell first which nodes have a likely partner there;
   only their sets are sent, and only a forest of links leaves the task.

So a group of copies costs about its own size, and texts that share one passage meet as
sketches in the lists that the passage fills. The index may miss a pair, a sketch one in 10^8
(`LIKELY`); neither makes one. Sets of all others never cross a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import common, simhash
from emberline.llm.components import Stored, components
from emberline.llm.simhash import in_blocks

WORDS = 5
# Least similarity of a pair, as a fraction of integers.
SHARE, OF = 4, 5
# Posting lists of a node, and minima that a list is named by.
BANDS, ROWS = 28, 6
# Bytes that two sketches share at least; sets at 0.8 share 134 of 168 on average.
LIKELY = 100
# Nodes of one list that a task compares with each other.
BLOCK = 1024

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(42)
_ODD = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def sets(data: np.ndarray, starts: np.ndarray, names: common.Names, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all texts, sorted and each once within its text, and where each text begins.

    A text of fewer words is one shingle; one without words has none.
    """
    names.grow(len(data))
    lower = _LOWER[data]
    solid = np.append(~_SPACE[data], False)
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    opens[starts[:-1]] |= solid[starts[:-1]]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    ends = starts[1:][starts[1:] > 0] - 1
    closes[ends] |= solid[ends]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    named = names.of(names.sums(lower), begin, end)
    at = np.searchsorted(begin, starts)
    parts = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        width = min(words, b - a)
        total = np.zeros(b - a - width + 1 if width else 0, np.uint64)
        for i in range(width):
            total = common.mixed(total + named[a + i : a + i + len(total)] + np.uint64(i + 1))
        parts.append(np.unique(total))
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.cumsum([0, *map(len, parts)])


def digests(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of every set."""
    sums = np.append(np.uint64(0), np.cumsum(common.mixed(shingles ^ _FLIP[0]), dtype=np.uint64))
    return common.mixed(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))


def minima(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The signature of every set that is not empty."""
    begin = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(begin), BANDS * ROWS), np.uint64)
    if len(begin):
        for k in range(BANDS * ROWS):
            out[:, k] = np.minimum.reduceat((shingles ^ _FLIP[k]) * _ODD[k], begin)
    return out


def lists_of(least: np.ndarray) -> np.ndarray:
    """Names of the posting lists of signatures."""
    out = np.zeros((len(least), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        out[:, k // ROWS] = common.mixed(out[:, k // ROWS] + least[:, k] + np.uint64(k + 1))
    return out


def signatures(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the posting lists of every set that is not empty."""
    return lists_of(minima(shingles, at))


def sketches(least: np.ndarray) -> np.ndarray:
    """A byte of every minimum."""
    return (common.mixed(least) >> np.uint64(56)).astype(np.uint8)


def _bytes_of(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of a flat array as binary values; a slice without any is null."""
    width = values.dtype.itemsize
    empty = pa.array(np.diff(ends) == 0)
    whole = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
    return pc.if_else(empty, pa.scalar(None, pa.large_binary()), whole).cast(pa.binary())


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.Names(1 << 16)
        for rows in common.gathered(batches, "text", 1 << 20):
            shingles, at = sets(*common.flat(rows.column("text")), names, words)
            least = minima(shingles, at)
            there = np.append(0, np.cumsum(np.diff(at) > 0))
            lists = pa.ListArray.from_arrays(pa.array((there * BANDS).astype(np.int32)), pa.array(lists_of(least).view(np.int64).ravel()))
            columns = [c.combine_chunks() for c in rows.drop_columns(["text"]).columns]
            columns += [pa.array(digests(shingles, at).view(np.int64)), pa.array(np.diff(at).astype(np.int32)), _bytes_of(sketches(least).ravel(), there * BANDS * ROWS), lists]
            columns.append(pa.array(simhash.prints(rows.column("text"), words).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=[*rows.drop_columns(["text"]).column_names, "node", "size", "sketch", "lists", "print"])

    return run


def _sets(words: int, wanted):
    """Whole sets, and sketches, of the nodes that the filter lets pass, each once a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.Names(1 << 16)
        for rows in common.gathered(batches, "text", 1 << 20):
            shingles, at = sets(*common.flat(rows.column("text")), names, words)
            node = digests(shingles, at)
            first = np.zeros(len(node), bool)
            first[np.unique(node, return_index=True)[1]] = True
            keep = np.flatnonzero(first & (np.diff(at) > 0) & common.may_hold(wanted.value, node))
            ends = np.append(0, np.cumsum(np.diff(at)[keep]))
            mine = shingles[np.repeat(at[keep] - ends[:-1], np.diff(ends)) + np.arange(ends[-1])]
            wide = np.arange(len(keep) + 1) * BANDS * ROWS
            columns = [pa.array(node[keep].view(np.int64)), _bytes_of(mine, ends), _bytes_of(sketches(minima(mine, ends)).ravel(), wide)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", "sketch"])

    return run


def _square(column: pa.Array) -> np.ndarray:
    """Sketches as rows of a matrix."""
    return common.flat(column)[0].reshape(-1, BANDS * ROWS)


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of sets that can be near."""
    return OF * np.minimum(a, b) >= SHARE * np.maximum(a, b)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs beside their sketches, those that may be near."""
    for batch in batches:
        near = np.count_nonzero(_square(batch.column("u_sketch")) == _square(batch.column("v_sketch")), axis=1) >= LIKELY
        near &= _fits(batch.column("u_size").to_numpy().astype(np.int64), batch.column("v_size").to_numpy().astype(np.int64))
        yield batch.select(["u", "v"]).filter(pa.array(near))


def _near(one: np.ndarray, many: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of many sets, one after the other, are near one."""
    spot = np.minimum(np.searchsorted(one, many), len(one) - 1)
    shared = np.diff(np.append(0, np.cumsum(one[spot] == many))[ends])
    return OF * shared >= SHARE * (len(one) + np.diff(ends) - shared)


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs beside their sets, those that are near."""
    for batch in batches:
        near = []
        for a, b in zip(batch.column("u_set"), batch.column("v_set")):
            a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
            near.append(bool(_near(a, b, np.array([0, len(b)]))[0]))
        yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes whose sketch is like another one's of their list."""
    for rows, at in common.groups(batches, ["list", "lo", "hi"], 2 * BLOCK):
        node, size = rows.column("node").to_numpy(), rows.column("size").to_numpy().astype(np.int64)
        sketch, found = _square(rows.column("sketch")), np.zeros(rows.num_rows, bool)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            for x in range(a, b - 1):
                like = np.count_nonzero(sketch[x + 1 : b] == sketch[x], axis=1) >= LIKELY
                like &= _fits(size[x + 1 : b], size[x])
                found[x] |= like.any()
                found[x + 1 : b] |= like
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(node[found]))], names=["node"])


def _forest(shingles: np.ndarray, at: np.ndarray, sketch: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all sets reachable from each other; those of one part are joined already."""
    sizes, left, found = np.diff(at), np.arange(len(part)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            alike = part[left] == part[x]
            fit = np.flatnonzero(~alike & _fits(sizes[left], sizes[x]))
            fit = fit[np.count_nonzero(sketch[left[fit]] == sketch[x], axis=1) >= LIKELY]
            near = np.zeros(len(left), bool)
            if len(fit):
                some = left[fit]
                ends = np.append(0, np.cumsum(sizes[some]))
                many = shingles[np.repeat(at[some] - ends[:-1], sizes[some]) + np.arange(ends[-1])]
                near[fit] = _near(shingles[at[x] : at[x + 1]], many, ends)
            found += [(x, y) for y in left[near].tolist()]
            front += left[alike | near].tolist()
            left = left[~(alike | near)]
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for rows, at in common.groups(batches, ["list", "lo", "hi"], 2 * BLOCK):
        node, part, sketch = rows.column("node").to_numpy(), rows.column("part").to_numpy(), _square(rows.column("sketch"))
        data, ends = common.flat(rows.column("shingles"))
        shingles, ends = np.frombuffer(data.tobytes(), np.uint64), ends // 8
        pairs = [np.zeros((0, 2), np.int64)]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a > 1:
                found = _forest(shingles[ends[a] : ends[b]], ends[a : b + 1] - ends[a], sketch[a:b], part[a:b])
                pairs.append(np.array(found, np.int64).reshape(-1, 2) + a)
        pairs = np.concatenate(pairs)
        yield from common.frames({"u": node[pairs[:, 0]], "v": node[pairs[:, 1]]}, schema)


def _dealt(rows: DataFrame, block: int, *columns: str) -> DataFrame:
    """Rows of lists, so that each list, or each pair of blocks of a long one, lies together in a task."""
    keys = ["list", "lo", "hi"]
    dealt = in_blocks(rows, "list", "node", block).select(*keys, *columns)
    return dealt.repartition(common.partitions(rows), *keys).sortWithinPartitions(*keys)


def _beside(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Pairs with the columns of both their nodes."""
    for end in ("v", "u"):
        named = nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        pairs = pairs.join(named, end)
    return pairs


def print_pairs(nodes: DataFrame) -> Stored:
    """Candidates u, v by SimHash: nodes of one fingerprint, and of fingerprints that its index links."""
    firsts = Stored(nodes.groupBy("print").agg(F.min("node").alias("least")))
    same = nodes.join(firsts.rows, "print").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    links = simhash.near_links(firsts.rows.select("print"))
    for end in ("v", "u"):
        links = links.join(firsts.rows.select(F.col("print").alias(end), F.col("least").alias(f"{end}_least")), end)
    pairs = Stored(same.union(links.select(F.col("u_least").alias("u"), F.col("v_least").alias("v"))))
    firsts.drop()
    return pairs


def near_links(rows: DataFrame, nodes: DataFrame, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """Links u, v, each verified, that join all nodes that reach each other by near pairs of the index.

    `nodes`: `node`, `size`, `sketch`, `lists`, `print`, one row each; `rows`: the texts.
    """
    steps = []

    def kept(df: DataFrame) -> DataFrame:
        steps.append(Stored(df))
        return steps[-1].rows

    posted = nodes.select("node", F.explode("lists").alias("list"))
    shared = posted.groupBy("list").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most")
    members = kept(posted.join(shared.select("list", "least"), "list"))
    pairs = members.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    alike = print_pairs(nodes)
    steps.append(alike)
    likely = kept(_beside(pairs.union(alike.rows).distinct(), nodes, "size", "sketch").mapInArrow(_alike, "u long, v long"))
    # Lists in which some node is unlike the least one: who is like another there?
    unlike = members.where("node <> least").join(likely.select(F.col("u").alias("least"), F.col("v").alias("node")), ["least", "node"], "left_anti")
    open_ = members.select("list", "node").join(unlike.select("list").distinct(), "list", "left_semi")
    sized = nodes.select("node", "size", "sketch")
    more = _dealt(open_.join(sized, "node"), block, "node", "size", "sketch").mapInArrow(_partners, "node long")
    wanted = kept(more.union(likely.select("u")).union(likely.select("v")).distinct())
    bits = rows.sparkSession.sparkContext.broadcast(common.bit_filter(wanted, "node"))
    whole = kept(rows.select("text").mapInArrow(_sets(words, bits), "node long, shingles binary, sketch binary").groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch")))
    links = kept(_beside(likely, whole.withColumnRenamed("shingles", "set"), "set").mapInArrow(_equal, "u long, v long"))
    # Lists that this has not joined.
    parts = components(links).select("node", F.col("component").alias("found"))
    placed = members.select("list", "node").join(wanted, "node", "left_semi").join(parts, "node", "left").select("list", "node", F.coalesce("found", "node").alias("part"))
    mixed = placed.groupBy("list").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("list")
    rest = placed.join(mixed, "list", "left_semi").join(whole, "node")
    found = Stored(links.union(_dealt(rest, block, "node", "part", "shingles", "sketch").mapInArrow(_links, "u long, v long")))
    for step in steps:
        step.drop()
    return found.rows


def near_groups(documents: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """`doc_id`, the columns `carry`, and `group`, the same for all rows that near texts connect."""
    rows = common.small_batches(documents).select(F.col(key).cast("long").alias("doc_id"), *carry, common.text_of(text).alias("text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.drop("text").schema)
    wide = Stored(rows.mapInArrow(_signed(words), f"{kinds}node long, size int, sketch binary, lists array<long>, print long"))
    first = [*[F.first(c).alias(c) for c in ("size", "sketch", "lists")], F.min("print").alias("print")]
    nodes = Stored(wide.rows.where("size > 0").groupBy("node").agg(*first))
    signed = Stored(wide.rows.select("doc_id", *carry, "node"))
    wide.drop()
    reached = components(near_links(rows, nodes.rows, words, block))
    nodes.drop()
    found = signed.rows.join(reached, "node", "left")
    return found.select("doc_id", *carry, F.coalesce("component", "node").alias("group"))


def near_copies(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """`doc_id` and `component_id` of every row.

    Texts link at a Jaccard similarity of 0.8 or more of their shingles, case and space
    aside; `component_id` is the smallest doc_id reachable by links, itself included. Null
    and blank texts have no shingles and are copies of each other. Repeated rows stay. A row
    without an id takes part and is never the smallest, unless no other is reachable. Very
    long texts cost a set of eight bytes a word. Other columns are not read.
    """
    groups = near_groups(documents, key, text, (), words, block)
    smallest = groups.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return groups.join(smallest, "group").select("doc_id", "component_id")

"""Embedding near-dedup by collision-counting projections.

Vectors of length one are projected on many random lines. Two vectors collide on a line if
one lies in a window of fixed width centred on the other: within a cell (see below) the
projections are compared line by line, which counts what sorting along each line and
opening the windows would. Vectors as close as the threshold collide on a line with a
known chance, so that the number of collisions over all lines has a known law. Pairs that
reach the count which close pairs reach with the wanted recall are verified in double
precision.

Counting every pair would be quadratic, whatever the width: close vectors collide at most
some three times as often as others. So vectors are dealt into cells first: a table cuts
each of its lines at zero, a cell is one side of every line, and only vectors that share
a cell of some table are counted. Lines per table grow with the logarithm of the number
of vectors, and the number of tables follows from the recall: two vectors at an angle lie
on the same side of a line with a chance that depends on the angle alone, whatever the
other vectors are. A pair is counted in the first table in which it shares a cell. A cell
with many vectors is dealt out as pairs of blocks; what leaves a task is a count per
vector and a forest of links.

Equal vectors are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import common
from emberline.llm.components import checkpointed, components
from emberline.llm.simhash import in_blocks

COSINE = 0.9
# Share of pairs at the threshold that a table's cells, and then the count, let through.
RECALL = 0.995
# Lines on which collisions are counted.
LINES = 64
# Vectors a cell should hold, and vectors that a task compares with each other.
CELL, BLOCK = 32, 1024
SEED = 5
# Lines of a table at most, as a cell's number has so many bits: enough for 5 * 10^11 vectors.
MOST_LINES = 34


@dataclass(frozen=True)
class Plan:
    """What the number of vectors, the threshold and the recall ask for."""

    cosine: float
    bits: int
    tables: int
    width: float
    count: int

    @staticmethod
    def of(vectors: int, cosine: float, recall: float) -> Plan:
        bits = min(max(int(log2(max(vectors, 1) / CELL + 1)), 1), MOST_LINES)
        meet = (1 - acos(cosine) / pi) ** bits
        tables = max(1, ceil(log(1 - recall) / log(1 - meet))) if meet < 1 else 1
        # A window of one standard deviation of the difference at the threshold.
        width = sqrt(2 - 2 * cosine)
        chance = erf(1 / sqrt(2)) if width else 1.0
        below, count = 0.0, 0
        while count < LINES and below + (p := comb(LINES, count) * chance**count * (1 - chance) ** (LINES - count)) <= 1 - recall:
            below += p
            count += 1
        return Plan(cosine, bits, tables, width, count)


def lines(size: int, count: int, seed: int) -> np.ndarray:
    """Random directions, as columns, for vectors of a size; projections have about unit variance."""
    return np.random.default_rng([seed, size, count]).standard_normal((size, count))


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, size)


def units(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cells(unit: np.ndarray, plan: Plan) -> np.ndarray:
    """Cell of every vector in every table."""
    side = (unit @ lines(unit.shape[1], plan.bits * plan.tables, SEED)) > 0
    return side.reshape(len(unit), plan.tables, plan.bits) @ (1 << np.arange(plan.bits))


def _deal(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                at = cells(units(matrix(rows.column(1), int(size))), plan)
                for table in range(plan.tables):
                    cell = (np.int64(size) * plan.tables + table << MOST_LINES) | at[:, table]
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *rows.columns], names=["cell", *rows.schema.names])

    return run


FOUND = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def _count(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in common.groups(batches, ["cell", "lo", "hi"], 8192):
            group = np.repeat(np.arange(len(at) - 1), np.diff(at))
            cell, node, copies, own, lo, hi = (rows.column(c).to_numpy() for c in ("cell", "node", "copies", "own", "lo", "hi"))
            key = cell >> MOST_LINES
            table, size = key % plan.tables, key // plan.tables
            vectors = rows.column("embedding").combine_chunks()
            n = len(group)
            links, label = np.zeros(n, np.int64), np.arange(n)
            for dim in np.unique(size):
                of = np.flatnonzero(size == dim)
                unit = units(matrix(vectors.take(pa.array(of)), int(dim)))
                spread = (unit @ lines(int(dim), LINES, SEED + 1)).astype(np.float32)
                all_cells = cells(unit, plan)
                pairs = []
                for step in range(1, int(np.diff(at).max())):
                    a = np.arange(len(of) - step)
                    a = a[group[of[a]] == group[of[a + step]]]
                    if not len(a):
                        break
                    # Between blocks only pairs across, within a block all.
                    a = a[(lo[of[a]] == hi[of[a]]) | (own[of[a]] != own[of[a + step]])]
                    for part in np.array_split(a, len(a) // 16384 + 1):
                        b = part + step
                        enough = (np.abs(spread[part] - spread[b]) <= plan.width).sum(axis=1) >= plan.count
                        part, b = part[enough], b[enough]
                        near = np.einsum("ij,ij->i", unit[part], unit[b]) >= plan.cosine
                        part, b = part[near], b[near]
                        # Not if an earlier table has the pair.
                        before = np.arange(plan.tables) < table[of[part]][:, None]
                        new = ~((all_cells[part] == all_cells[b]) & before).any(axis=1)
                        pairs.append(np.stack([of[part[new]], of[b[new]]]))
                if pairs:
                    a, b = np.concatenate(pairs, axis=1)
                    links += np.bincount(a, copies[b], n).astype(np.int64) + np.bincount(b, copies[a], n).astype(np.int64)
                    label = _least(label, a, b)
            out = np.flatnonzero(links)
            yield from common.frames({"node": node[out], "other": node[label[out]], "links": links[out]}, FOUND)

    return run


def _least(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches over the pairs."""
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = np.minimum(label, label[label])
        if (label == before).all():
            return label


def near_copies(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """`vec_id`, `n_links`, `component_id` and `kept` of every row.

    Links pairs whose cosine in double precision is `cosine` or more, found with about
    the given recall or better, and none below it. `n_links` counts the other rows linked
    directly, equal vectors included; `component_id` is the smallest vec_id reachable,
    itself included; `kept` marks the row that is its own. A vector that is null, empty
    or zero, or holds a null or a value that is not finite, links with nothing, and so does
    a row without an id. Vectors of different lengths never link. Repeated rows are
    vectors of their own. Other columns are not read. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))
    total = nodes.count()
    plan = Plan.of(total, cosine, recall)
    given = nodes.select("node", "embedding", "copies")
    kind = nodes.schema["embedding"].dataType.simpleString()
    dealt = given.mapInArrow(_deal(plan), f"cell long, node long, embedding {kind}, copies long")
    blocks = in_blocks(dealt, "cell", "node", BLOCK).select("cell", "lo", "hi", "own", "node", "embedding", "copies")
    blocks = blocks.repartition(common.partitions(vectors), "cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    found = checkpointed(blocks.mapInArrow(_count(plan), "node long, other long, links long"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    placed = nodes.join(reached, "node", "left").select("node", "embedding", "least", "copies", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "component").join(linked, "node", "left")
    named = named.select(F.col("embedding").alias("_vector"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = good.join(named, good["embedding"] == named["_vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return joined.union(alone).withColumn("kept", kept)


# Every pair by brute force; components by reachability.
ORACLE = """
    WITH RECURSIVE good AS (
        SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS u, b.vec_id AS v FROM good a, good b
        WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
    reach AS (
        SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
    SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, r.low) AS component_id,
           coalesce(e.vec_id = least(e.vec_id, r.low), false) AS kept
    FROM embeddings e
    LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) n ON n.u = e.vec_id
    LEFT JOIN (SELECT u, min(v) AS low FROM reach GROUP BY u) r ON r.u = e.vec_id"""

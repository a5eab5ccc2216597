"""SimHash near-dedup through an inverted index of byte positions.

A fingerprint has eight bytes. Two that differ in at most `bits` bits differ in at most
`bits` bytes, so they share the bytes at `8 - bits` positions or more: the guaranteed
minimum. The index posts each distinct fingerprint under (positions, bytes there), three
positions at a time: of any four positions, one of the chosen triples lies within. Pairs
that meet in a posting list are tallied over all eight positions, those that reach the
minimum are verified by their differing bits.

Equal fingerprints are one node. A posting list is compared inside one task only up to
a block; a longer one is dealt out as pairs of blocks, so that a large group of copies
spreads. Only a forest of the links of a list leaves the task: reachability, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import common
from emberline.llm.components import checkpointed, components

WORDS = 4
SEED = 42
BITS = 4
# Fingerprints of one posting list that a task compares with each other.
BLOCK = 2048
# Lists up to this length are compared many at a time.
SMALL = 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any four positions hold one of them.

    Positions fall into three classes in a ring; four positions have three in one
    class, or two in a class beside one of the next.
    """
    ring = [i % 3 for i in range(8)]

    def chosen(triple):
        kinds = [ring[i] for i in triple]
        return len(set(kinds)) == 1 or any(kinds.count(k) == 2 and (k + 1) % 3 in kinds for k in range(3))

    return [t for t in combinations(range(8), 3) if chosen(t)]


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit SimHash of word shingles; zero without words."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(tokens))
    first, last = starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), len(first)
    for at in range(0, total, 1 << 16):
        pairs = zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def prints(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """The fingerprint of every text."""
    data, starts = common.flat(texts)
    whole = data.tobytes()
    return np.array([fingerprint(whole[a:b], words) for a, b in zip(starts[:-1], starts[1:])], np.uint64)


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = prints(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "print"])

    return run


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """`doc_id` and `print`, the fingerprint as a signed long, of every row."""
    rows = common.small_batches(documents).select(F.col(key).cast("long").alias("doc_id"), common.text_of(text).alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, print long")


def _near(a: np.ndarray, b: np.ndarray | np.uint64, bits: int) -> np.ndarray:
    """Tally of shared positional bytes first, then the bits of the pairs that reach it."""
    differ = a ^ b
    shared = 8 - np.count_nonzero(np.ascontiguousarray(differ).view(np.uint8).reshape(-1, 8), axis=1)
    return (shared >= 8 - bits) & (np.bitwise_count(differ) <= bits)


def _forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join all prints reachable from each other within the list."""
    left, found = np.arange(len(prints)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = _near(prints[left], prints[at], bits)
            front += (hit := left[near]).tolist()
            found += [(at, x) for x in hit.tolist()]
            left = left[~near]
    return found


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for rows, at in common.groups(batches, ["list", "lo", "hi"]):
            prints = rows.column("print").to_numpy().view(np.uint64)
            sizes = np.diff(at)
            group = np.repeat(np.arange(len(sizes)), sizes)
            small = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= SMALL))
            pairs = [np.zeros((0, 2), np.int64)]
            for step in range(1, SMALL):
                a = small[small + step < len(group)]
                a = a[group[a] == group[a + step]]
                if not len(a):
                    break
                a = a[_near(prints[a], prints[a + step], bits)]
                pairs.append(np.stack([a, a + step], axis=1))
            for g in np.flatnonzero(sizes > SMALL):
                found = _forest(prints[at[g] : at[g + 1]], bits)
                if found:
                    pairs.append(np.array(found) + at[g])
            pairs = np.concatenate(pairs)
            signed = prints.view(np.int64)
            yield from common.frames({"u": signed[pairs[:, 0]], "v": signed[pairs[:, 1]]}, schema)

    return run


def in_blocks(rows: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """Rows dealt into groups (`key`, `lo`, `hi`) in which all pairs of a key meet.

    A key of more than `block` rows is cut into blocks, and each pair of blocks is a
    group of its own; `own` is the row's block. Every row of such a key is repeated once
    per block, so that the largest group has about two blocks of rows.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > block)
    cut = sizes.select(key, F.ceil(F.col("_size") / block).cast("int").alias("_blocks"))
    marked = rows.join(cut, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    marked = marked.withColumn("own", F.pmod(F.xxhash64(F.col(member)), F.col("_blocks")).cast("int"))
    each = marked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return each.withColumns({"lo": F.least("own", "_other"), "hi": F.greatest("own", "_other")}).drop("_other", "_blocks")


def near_links(nodes: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Links u, v that join all prints of the column `print` (distinct) that are near each other.

    Complete for up to four differing bits.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees four shared bytes, so at most four differing bits")
    byte = [F.shiftrightunsigned(F.col("print"), 8 * i).bitwiseAND(255) for i in range(8)]
    keys = [
        F.lit(n << 24).cast("long") + F.shiftleft(byte[i], 16) + F.shiftleft(byte[j], 8) + byte[k]
        for n, (i, j, k) in enumerate(triples())
    ]
    posted = nodes.select("print", F.explode(F.array(*keys)).alias("list"))
    dealt = in_blocks(posted, "list", "print", block).select("list", "lo", "hi", "print")
    dealt = dealt.repartition(common.partitions(nodes), "list", "lo", "hi").sortWithinPartitions("list", "lo", "hi")
    return dealt.mapInArrow(_links(bits), "u long, v long").distinct()


def near_copies(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """`doc_id`, `fingerprint` (16 hex digits) and `component_id` of every row.

    Fingerprints link at `bits` or fewer differing bits; `component_id` is the smallest
    doc_id reachable by links, itself included. A null or blank text has no shingles and
    fingerprint zero, linked like any other. Repeated rows stay, each with its group. A
    row without an id takes part and is never the smallest, unless no other is reachable
    (null then). Other columns are not read. An empty table gives an empty result.
    """
    prints = checkpointed(fingerprints(documents, key, text, words))
    nodes = checkpointed(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    reached = components(near_links(nodes.select("print"), bits))
    placed = nodes.join(reached.withColumnRenamed("node", "print"), "print", "left")
    placed = placed.select("print", "least", F.coalesce("component", "print").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "component").select("print", "component_id")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return prints.join(named, "print").select("doc_id", digits.alias("fingerprint"), "component_id")

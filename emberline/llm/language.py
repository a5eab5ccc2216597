"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: a cell is a bitmask with
one bit per language. An n-gram sets its languages' bits in `PROBES` cells; the AND of
those cells returns all languages that contain it. A document's n-grams are looked up,
the bits are counted per language, and each count is corrected by the rate at which the
filter answers yes to n-grams that the language does not contain.

The filter has a fixed number of cells, so that its size is known before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import common, fitting
from emberline.llm.components import checkpointed

# Documents that n-grams are learned from, at most about so many.
SAMPLE = 10_000
FOLDS = 3
SIZES = (3, 4, 5)
CELLS = 1 << 20
PROBES = 2
# A language contains an n-gram if it shows it at least so often in the sample, and
# at this share or more of the rate of the language that shows it most.
LEAST, SHARE = 5, 0.2

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True

GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def squeezed(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased text with each run of other characters as one space, a space at both ends."""
    data, starts = common.flat(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    # A space before each text keeps its first word's beginning apart.
    rows = len(starts) - 1
    wide = np.insert(data, starts[:-1], 32)
    starts = starts + np.arange(rows + 1)
    letter = _LETTER[wide]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if rows:
        keep[starts[:-1][starts[:-1] < len(wide)]] = True
    text = np.where(letter, wide, 32).astype(np.uint8)[keep]
    return text, np.concatenate([[0], np.cumsum(keep)])[starts]


def grams(text: np.ndarray, starts: np.ndarray, size: int, names: common.Names) -> tuple[np.ndarray, np.ndarray]:
    """Names of the n-grams within documents, and the first gram of every document."""
    found = names.all(names.sums(text), size)
    inside = np.zeros(len(found) + 1, np.int64)
    valid = np.ones(len(found), bool)
    for back in range(1, size):
        edge = starts[1:-1] - back
        valid[edge[(edge >= 0) & (edge < len(found))]] = False
    inside[1:] = np.cumsum(valid)
    return found[valid] + np.uint64(size), inside[np.minimum(starts, len(found))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = common.Names(1 << 16)
    for rows in common.gathered(batches, "text", 1 << 20):
        langs = rows.column("lang").to_pandas()
        for lang, at in langs.groupby(langs).groups.items():
            text, starts = squeezed(rows.column("text").take(pa.array(np.asarray(at))))
            names.grow(len(text))
            found = np.concatenate([grams(text, starts, size, names)[0] for size in SIZES])
            gram, n = np.unique(found, return_counts=True)
            yield from common.frames({"lang": pa.array([lang] * len(gram)), "gram": gram.view(np.int64), "n": n}, GRAMS)


@dataclass(frozen=True)
class Filter:
    langs: list[str]
    cells: np.ndarray
    """Bitmasks, one row per cell, one column per 64 languages."""
    rates: np.ndarray
    """Chance that an n-gram a language does not contain passes for it."""


def probes(found: np.ndarray) -> list[np.ndarray]:
    """Cells of n-grams."""
    return [((found >> np.uint64(20 * k)) & np.uint64(CELLS - 1)).astype(np.int64) for k in range(PROBES)]


def learn(documents: DataFrame, sample: int = SAMPLE) -> Filter:
    """The filter of a bounded sample of rows with text and lang; other rows teach nothing."""
    rows = common.small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = fitting.sampled(rows.where("lang is not null and text is not null"), "doc_id", sample)
    counts = rows.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts)
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Filter([], np.zeros((CELLS, 1), np.uint64), np.zeros(0))
    # One row per language: as few as the labels name.
    sizes = F.broadcast(documents.sparkSession.createDataFrame([(lang, i, float(totals[lang])) for i, lang in enumerate(langs)], "lang string, bit int, total double"))
    rated = counts.join(sizes, "lang").withColumn("rate", F.col("n") / F.col("total"))
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"), F.sum("n").alias("all"))
    held = rated.join(most.where(F.col("all") >= LEAST), "gram").where(F.col("rate") >= SHARE * F.col("most"))
    at = F.array(*[F.shiftrightunsigned("gram", 20 * k).bitwiseAND(CELLS - 1) for k in range(PROBES)])
    bits = held.select(F.explode(at).alias("cell"), (F.col("bit") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, bit % 64)").alias("mask"))
    words = bits.groupBy("cell", "word").agg(F.bit_or("mask").alias("mask")).collect()
    cells = np.zeros((CELLS, -(-len(langs) // 64)), np.uint64)
    cells[[r["cell"] for r in words], [r["word"] for r in words]] = np.array([r["mask"] for r in words], np.int64).view(np.uint64)
    filled = np.array([np.mean((cells[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(langs))])
    return Filter(langs, _narrow(cells), filled**PROBES)


def _narrow(cells: np.ndarray) -> np.ndarray:
    """The same masks in the least integers that hold them."""
    for kind in (np.uint8, np.uint16, np.uint32):
        if cells.shape[1] == 1 and not len(cells) == 0 and cells.max() <= np.iinfo(kind).max:
            return cells.astype(kind)
    return cells


def popcounts(text: np.ndarray, starts: np.ndarray, known: Filter, names: common.Names) -> tuple[np.ndarray, np.ndarray]:
    """Hits per document and language, and n-grams per document."""
    hits, total = np.zeros((len(starts) - 1, len(known.langs))), np.zeros(len(starts) - 1)
    for size in SIZES:
        found, edge = grams(text, starts, size, names)
        total += np.diff(edge)
        cells = probes(found)
        for word in range(known.cells.shape[1]):
            column = known.cells[:, word]
            mask = column[cells[0]]
            for at in cells[1:]:
                mask = mask & column[at]
            for i in range(64 * word, min(64 * word + 64, len(known.langs))):
                run = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), dtype=np.int64)])
                hits[:, i] += run[edge[1:]] - run[edge[:-1]]
    return hits, total


def decide(hits: np.ndarray, total: np.ndarray, known: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest language and its share of the evidence.

    A count is cleared of the hits that chance gives it; shares are taken of fourth
    powers of what is left, so that a clear lead is close to 1. Ties go to the first language by name.
    """
    rates = known.rates
    true = np.clip((hits - total[:, None] * rates) / np.maximum(1 - rates, 1e-9), 0, None)
    best = true.argmax(axis=1)
    sharp = true**4
    share = sharp[np.arange(len(best)), best] / np.maximum(sharp.sum(axis=1), 1e-300)
    return best, np.clip(np.where(true.max(axis=1) > 0, share, 0.0), 0, 1)


def _predict(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = common.Names(1 << 16), known.value
        for rows in common.gathered(batches, "text", 1 << 20):
            text, starts = squeezed(rows.column("text"))
            names.grow(len(text))
            hits, total = popcounts(text, starts, model, names)
            best, share = decide(hits, total, model) if model.langs else (np.zeros(rows.num_rows, int), np.zeros(rows.num_rows))
            ascii_letters = np.concatenate([[0], np.cumsum((text >= 97) & (text <= 122))])[starts]
            lettered = np.diff(ascii_letters) > 0
            for i in np.flatnonzero(~lettered):
                lettered[i] = any(c.isalpha() for c in rows.column("text")[int(i)].as_py() or "")
            langs = [model.langs[b] if ok and model.langs else "und" for b, ok in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").combine_chunks(), rows.column("held_out").combine_chunks(), pa.array(langs, pa.string()), pa.array(np.where(lettered, share, 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict(documents: DataFrame, known: Filter) -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred` and `score` of every row, from its text alone.

    A text without letters (null and empty ones too) is `und` with score 0, and so is
    every text if nothing was learned. A text with letters none of which speak for a
    language gets the first language with score 0. Repeated rows stay; a null id counts
    as not held out. Other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(known)
    rows = common.small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), (fitting.bucket("doc_id", FOLDS) == 1).alias("held_out"), common.text_of().alias("text"))
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def identified(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from rows outside the held-out fold, then predicts every row."""
    return predict(documents, learn(documents.where(fitting.bucket("doc_id", FOLDS) != 1), sample))

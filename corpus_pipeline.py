"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and all
but the last return the columns of `documents`. Ids stay. Rows that repeat an id with
another text, and rows without an id, are documents like the others. Empty tables pass
as empty tables; columns besides those of `documents` go at the first stage.

1. toxicity: documents that the grammar rejects go.
2. near copies: one row of each group stays, the one with the smallest id. Candidates come
   from the SimHash index (fingerprints of shingles of five words, at most four bits apart)
   and, as near copies differ in more bits, from minima of the shingles. Groups link at a
   Jaccard similarity of 0.8 or more, checked on the whole sets of every candidate pair.
3. repeats: bytes of long strings seen earlier are cut, characters stay whole.
4. benchmark: documents that overlap a test item go.
5. pieces: what is left, encoded, and decoded again to compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import common, components, decontaminate, pieces, repeats, shingles, toxicity
from emberline.sources import folders

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(name).cast(kind).alias(name) for name, kind in COLUMNS.items()])


def _guarded(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """A stored table of two or three numbers a row, broadcast if it has at most so many rows (about 8 MB)."""
    return F.broadcast(df) if df.count() <= rows else df


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scores carry the row along, so that the verdict needs no join."""
    docs, labels = _plain(docs), common.table(spark, sf_dir, "labels")
    taught = labels.where(toxicity.fitting.bucket("doc_id", toxicity.FOLDS) != 0)
    return toxicity.kept(docs, toxicity.learn(docs, taught))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash and shingle minima name candidates, whole sets of shingles decide.

    Rows are told apart by id and content, so that ids may repeat or be missing.
    """
    docs = _plain(docs).withColumn("_row", F.xxhash64("text", "lang", "source", "n_chars"))
    groups = shingles.near_groups(docs, carry=("_row",))
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first._row").alias("_first"))
    rows = groups.groupBy("doc_id", "_row").agg(F.count(F.lit(1)).alias("n"))
    met = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_first")), "left")
    # Rows that go, and those of which one stays: far fewer than the rest.
    fates = components.Stored(met.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_that"), F.col("_first").isNull().alias("gone"), "n").where("gone or n > 1"))
    this = docs["doc_id"].eqNullSafe(fates.rows["_id"]) & (docs["_row"] == fates.rows["_that"])
    left = docs.join(_guarded(fates.rows), this, "left_anti").select(*COLUMNS)
    one = docs.join(_guarded(fates.rows.where("not gone")), this, "left_semi").select(*COLUMNS).dropDuplicates()
    return left.union(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose bytes get the length of what is left."""
    cut = repeats.without_repeats(_plain(docs), others=("lang", "source", "n_chars"))
    cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(_plain(docs), common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(_plain(docs))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("benchmark", drop_benchmark),
    ("pieces", encode),
]

# No stage of learned scores, reachability or Viterbi has an SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder, read again by the next, and then deleted."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = folders.workspace(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            folders.delete(spark, before)
        before = path
    return docs

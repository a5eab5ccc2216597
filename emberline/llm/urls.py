"""URL rules through a cascade of Bloom filters: exact membership without joins.

The key universe is every key of the corpus that a rule could be: each end of a host that
has as many labels as some rule, beside each prefix of the path that is as long as some
rule's path. Level one encodes the listed keys as the rules give them; level two the other
keys of the universe that pass level one; level three the listed keys that pass level two;
and so on until a level has nothing to encode. A key of the universe then is listed if the first level it fails is an even one.
One cascade lists keys to block, another those to allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import common
from emberline.llm.components import checkpointed

# Bytes of a cascade's first level up to which it is one shard.
LIMIT = 64 << 20
LEVELS = 64

BLOCK, ALLOW = "block", "allow"


def host_of(url: str = "url") -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def keys_of(lengths: list[int], depths: list[int]) -> Column:
    """All keys of `host` and `path` that a rule of these path lengths and numbers of labels could be, the longest host first.

    Only these ends of the host are built, so a host of many labels costs its length.
    """
    dots = F.length("host") - F.length(F.regexp_replace("host", r"\.", ""))
    parents = [F.when(dots >= n - 1, F.substring_index("host", ".", -n)) for n in sorted(depths, reverse=True)]
    starts = [F.when(F.length("path") >= n, F.substr(F.col("path"), F.lit(1), F.lit(n))) for n in lengths]
    # A missing part makes the key null.
    keys = F.array_compact(F.array(*[F.concat(p, start) for p in parents for start in starts]))
    return F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    bits: int
    probes: int
    words: np.ndarray


def places(first: np.ndarray, second: np.ndarray, level: int, bits: int, probes: int) -> list[np.ndarray]:
    """Bit positions of keys, given by two hashes each, in a level."""
    step = common.mixed(second + np.uint64(2 * level + 1)) | np.uint64(1)
    base = common.mixed(first ^ np.uint64(level))
    return [((base + np.uint64(k) * step) % np.uint64(bits)).astype(np.int64) for k in range(probes)]


def passes(first: np.ndarray, second: np.ndarray, number: int, level: Level) -> np.ndarray:
    out = np.ones(len(first), bool)
    for at in places(first, second, number, level.bits, level.probes):
        out &= (level.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
    return out


class Cascade:
    """Levels, the first of listed keys."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which keys of the universe are listed: those that fail first at an even level."""
        out, left = np.zeros(len(first), bool), np.arange(len(first))
        for number, level in enumerate(self.levels):
            ok = passes(first[left], second[left], number, level)
            out[left[~ok]] = number % 2 == 1
            left = left[ok]
        out[left] = len(self.levels) % 2 == 1
        return out


def _set_bits(number: int, bits: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            at = np.unique(np.concatenate(places(first, second, number, bits, probes)))
            word, begin = np.unique(at >> 6, return_index=True)
            masks = np.uint64(1) << (at & 63).astype(np.uint64)
            masks = np.bitwise_or.reduceat(masks, begin) if len(begin) else masks
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(masks.view(np.int64))], names=["word", "mask"])

    return run


def _still(number: int, level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield batch.filter(pa.array(passes(first, second, number, level.value)))

    return run


def _sized(wanted: int, rest: int, number: int) -> tuple[int, int]:
    """Probes and bits of a level. Half of the other side may pass; at the first level as few as there are listed keys."""
    probes = 1 if number else max(1, int(np.ceil(np.log2(max(1.0, 1.41 * rest / max(1, wanted))))))
    return probes, max(64, int(np.ceil(wanted * probes / np.log(2))))


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade that tells the `listed` rows of `first`, `second` (hashes) and `rule` from the others of the universe.

    The first level encodes the list as it is given. Only what passes it, about as many
    keys as are listed, is compared with the list; all further levels come of these. Rows
    are encoded by Spark; only the bits of a level reach the driver.
    """
    spark, columns = listed.sparkSession, ["first", "second", "rule"]
    levels: list[Level] = []
    encode, against = checkpointed(listed.select(*columns)), universe.select(*columns)
    wanted, rest = encode.count(), against.count()
    for number in range(LEVELS):
        if not wanted:
            return Cascade(levels)
        probes, bits = _sized(wanted, rest, number)
        rows = encode.select("first", "second").mapInArrow(_set_bits(number, bits, probes), "word long, mask long")
        words = np.zeros(-(-bits // 64), np.uint64)
        for row in rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
            words[row["word"]] = row["mask"] & ((1 << 64) - 1)
        levels.append(Level(bits, probes, words))
        level = spark.sparkContext.broadcast(levels[-1])
        still = against.mapInArrow(_still(number, level), "first long, second long, rule string")
        if not number:
            still = still.join(encode.select("rule"), "rule", "left_anti").select(*columns)
        still = checkpointed(still)
        encode, against = still, encode
        wanted, rest = encode.count(), wanted
    raise RuntimeError(f"two keys share both hashes: no filter tells them apart after {LEVELS} levels")


CANDIDATES = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def _judge(block, allow):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("keys"))
            counts = np.diff(keys.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), counts)
            fields = keys.flatten()
            first, second, size = (fields.field(c).to_numpy() for c in ("first", "second", "size"))
            hashes = first.view(np.uint64), second.view(np.uint64)
            blocked, allowed = block.value.listed(*hashes), allow.value.listed(*hashes)
            # The longest rule; of equals the longer host, which comes first.
            hit = np.flatnonzero(blocked | allowed)
            hit = hit[np.lexsort((hit, -size[hit], row[hit]))]
            top = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])] if len(hit) else hit
            rule = np.full(batch.num_rows, -1)
            rule[row[top]] = top
            none = rule < 0
            rules = fields.field("key").take(pa.array(np.where(none, 0, rule), mask=none))
            verdict = np.where(~none & blocked[rule], BLOCK, ALLOW) if len(row) else np.full(batch.num_rows, ALLOW)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*cols, rules.cast(pa.string()), pa.array(verdict.astype(object), pa.string())], schema=CANDIDATES)

    return run


def _hits(block, allow):
    """Of keys, those that a cascade lists, with their verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [batch.column(batch.schema.get_field_index(c)).to_numpy().view(np.uint64) for c in ("first", "second")]
            blocked, allowed = block.value.listed(*hashes), allow.value.listed(*hashes)
            code = pa.array(np.where(blocked, 0, 1).astype(np.int32))
            yield batch.select(["keys", "at", "key", "size"]).append_column("code", code).filter(pa.array(blocked | allowed))

    return run


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", limit: int = LIMIT) -> DataFrame:
    """`page_id`, `host`, `path`, `rule` and `verdict` of every row.

    `rules` has rule (host and path, like `example.net/en/`) and verdict, `block` or
    `allow`. A rule fits its host and all subdomains where the url's path starts with the
    rule's; the longest wins, of equally long ones that with the longer host, and a rule
    listed both ways blocks. Without a rule the cascades say that no key is listed, and
    the page is allowed. A null url or one without `://` has an empty host and path, and
    no rule. A long url costs its length once per rule shape (labels and path length).
    Lists whose first level takes more than `limit` bytes are split by key into shards, each
    a pair of cascades of its own. Repeated rows stay; other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rules = rules.select("rule", "verdict").where("rule is not null").distinct()
    own = F.regexp_extract("rule", r"(?s)^([^/]*)", 1)
    # The shapes of rules, not the rules.
    shapes = rules.select((F.length("rule") - F.length(own)).alias("path"), (F.length(own) - F.length(F.regexp_replace(own, r"\.", "")) + 1).alias("labels")).distinct().collect()
    if not shapes:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(ALLOW).alias("verdict"))
    keyed = rows.withColumn("keys", keys_of(sorted({x["path"] for x in shapes}), sorted({x["labels"] for x in shapes})))
    hashes = F.xxhash64("rule").alias("first"), F.xxhash64(F.lit("second"), F.col("rule")).alias("second")
    universe = checkpointed(keyed.select(F.explode("keys").alias("rule")).distinct().select("rule", *hashes))
    verdicts = rules.groupBy("rule").agg(F.min(F.when(F.col("verdict") == BLOCK, 0).otherwise(1)).alias("code"))
    verdicts = checkpointed(verdicts.select("rule", "code", *hashes))
    bits = _sized(verdicts.count(), universe.count(), 0)[1]
    shards = max(1, -(-bits // (8 * limit)))

    def of(df: DataFrame, shard: int) -> DataFrame:
        return df.where(F.pmod("first", F.lit(shards)) == shard)

    built = []
    for shard in range(shards):
        there = of(universe, shard)
        pair = [cascade(of(verdicts, shard).where(F.col("code") == code), there) for code in (0, 1)]
        built.append([spark.sparkContext.broadcast(c) for c in pair])
    hashed = F.transform("keys", lambda k: F.struct(k.alias("key"), F.xxhash64(k).alias("first"), F.xxhash64(F.lit("second"), k).alias("second"), F.length(k).alias("size")))
    if shards == 1:
        out = keyed.select("page_id", "host", "path", hashed.alias("keys"))
        return out.mapInArrow(_judge(*built[0]), "page_id long, host string, path string, rule string, verdict string")
    # Keys decide, so each distinct list of keys is judged once, one shard at a time.
    lists = keyed.select("keys").distinct().select("keys", F.posexplode(hashed).alias("at", "_k")).select("keys", "at", "_k.*")
    hits = None
    for shard, pair in enumerate(built):
        found = of(lists, shard).mapInArrow(_hits(*pair), "keys array<string>, at int, key string, size int, code int")
        hits = found if hits is None else hits.union(found)
    best = hits.groupBy("keys").agg(F.max(F.struct("size", (-F.col("at")).alias("at"), F.col("key").alias("rule"), "code")).alias("best"))
    verdict = F.when(F.col("best.code") == 0, BLOCK).otherwise(ALLOW)
    return keyed.join(best, "keys", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


# The rules of the registered query.
RULES = [("net/", BLOCK), ("example.net/en/", ALLOW), ("example.com/de/", BLOCK), ("org/fr/", ALLOW)]


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, verdict string")


def oracle(rules: list[tuple[str, str]] = RULES) -> str:
    """The same by string comparison, longest rule first."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), -r[0].index("/"))):
        host, path = rule[: rule.index("/")], rule[rule.index("/") :]
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')", rule, verdict))
    rule = " ".join(f"WHEN {test} THEN '{name}'" for test, name, _ in fits)
    verdict = " ".join(f"WHEN {test} THEN '{given}'" for test, _, given in fits)
    return f"""
        WITH parts AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages)
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM parts"""

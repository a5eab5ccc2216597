"""Phrases whose words come together more often than by chance, per language.

Counts come from a suffix tree of the words, cut at a depth of five and built in parts:

1. Words are counted. A word below the least count cannot be in a phrase, so suffixes end
   before it. A filter of fixed size tells tasks which words may be frequent; a false
   positive costs room and changes no result.
2. Prefixes are partitioned vertically. A prefix with more suffixes than the memory budget
   allows is extended by its next word, counted again, and so on; the last extension of
   each suffix, at most as frequent as the budget, is its part's prefix. Prefixes are dealt
   into groups of about half a budget.
3. A task gets a group's suffixes, sorts them and has the group's subtree: a node is a run
   of equal beginnings, its count the total of its leaves. Nodes above a split prefix lie
   in several groups and are added up after.

Suffixes cross the shuffle in blocks: all of a chunk's suffixes for one group, sorted,
equal ones counted, as numbers into the block's own list of words, which are written as
their ranks among the most frequent words, or else as names. So a passage that all
documents share crosses once a chunk, and a word that a third of all suffixes begin with
spreads over as many groups as it fills budgets. The driver gets only prefixes above the budget:
their number is at most that of all words over half the budget, times the depth.

Words are named by 64-bit hashes of language and word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm import common
from emberline.llm.components import checkpointed

DEPTH = 5
LEAST = 100
TOP = 2000
# Suffixes that a task builds one subtree of; about 200 bytes each at the peak.
BUDGET = 1 << 19
# Words that a task sorts at once on the way to the groups.
CHUNK = 1 << 19
# Most frequent words that blocks write as their rank, others by name: 16 MB at most.
RANKED = 1 << 20
SALTS = 64
NONE = "und"

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: np.ndarray, starts: np.ndarray, langs: np.ndarray, names: common.Names) -> tuple[np.ndarray, ...]:
    """Of flat texts, per word: its name, the piece it lies in, its text, where it begins and ends.

    `langs` holds a 64-bit name of each text's language.
    """
    names.grow(len(data))
    kind = _KIND[data]
    solid = kind == 0
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    edges = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(data))]
    opens[edges] = solid[edges]
    closes[edges - 1] = solid[edges - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    text = np.searchsorted(starts, begin, "right") - 1
    named = common.mixed(names.of(names.sums(_LOWER[data]), begin, end) ^ langs[text])
    # Zero stands for no word.
    named[named == 0] = 1
    return named, np.cumsum(kind == 2)[begin] + text, text, begin, end


def _chunks(batches: Iterator[pa.RecordBatch], names: common.Names) -> Iterator[tuple]:
    for rows in common.gathered(batches, "text", 2 << 20):
        data, starts = common.flat(rows.column("text"))
        if len(data):
            langs = rows.column("lang").to_pylist()
            named = {lang: xxhash.xxh3_64_intdigest(lang.encode()) for lang in set(langs)}
            yield data, starts, langs, words_of(data, starts, np.array([named[x] for x in langs], np.uint64), names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each chunk with their counts; all words of a language together as the row without a word."""
    names = common.Names(1 << 21)
    for data, _, langs, (named, _, text, begin, end) in _chunks(batches, names):
        if not len(named):
            continue
        whole = _LOWER[data].tobytes()
        found, first, times = np.unique(named, return_index=True, return_counts=True)
        spoken = [langs[t] for t in text[first].tolist()]
        words = [whole[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())]
        totals = {}
        for lang, n in zip(spoken, times.tolist()):
            totals[lang] = totals.get(lang, 0) + n
        schema = pa.schema([("name", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
        columns = {
            "name": np.append(found, np.zeros(len(totals), np.uint64)).view(np.int64),
            "lang": pa.array(spoken + list(totals), pa.string()),
            "word": pa.array(words + [None] * len(totals), pa.binary()).cast(pa.string()),
            "n": np.append(times, list(totals.values())),
        }
        yield from common.frames(columns, schema)


def known_words(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """`name`, `lang`, `word`, `n`, `chunks` of the words with the least count; word null: all of the language."""
    counted = rows.mapInArrow(_counted, "name long, lang string, word string, n long")
    total = counted.groupBy("name", "lang", "word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("chunks"))
    return checkpointed(total.where((F.col("n") >= least) | F.col("word").isNull()))


def suffixes(named: np.ndarray, piece: np.ndarray, bits: np.ndarray, depth: int) -> np.ndarray:
    """The first words of every suffix as a row, zero after its piece's end or before a word that is not frequent."""
    out = np.zeros((len(named), depth), np.uint64)
    going = common.may_hold(bits, named)
    frequent = going.copy()
    out[going, 0] = named[going]
    for d in range(1, depth):
        n = max(len(named) - d, 0)
        going = going[:n] & frequent[d:] & (piece[:n] == piece[d:])
        out[:n, d][going] = named[d:][going]
    return out


def _extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    return common.mixed(prefix * _STEP + word)


def prefixes(rows: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Each suffix's shortest beginning that is not heavy, or all of it."""
    key = rows[:, 0]
    open_ = np.isin(key, heavy)
    for d in range(1, rows.shape[1]):
        open_ = open_ & (rows[:, d] > 0)
        key = np.where(open_, _extended(key, rows[:, d]), key)
        open_ &= np.isin(key, heavy)
    return key


def _longer(shared, depth: int, least: int):
    """Counts of beginnings of `depth` words, of which all but the last are heavy, with the least count in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, (bits, heavy, _) = common.Names(1 << 21), shared.value
        schema = pa.schema([("prefix", pa.int64()), ("n", pa.int64())])
        for _, _, _, (named, piece, *_) in _chunks(batches, names):
            rows = suffixes(named, piece, bits, depth)
            key = rows[:, 0]
            for d in range(1, depth):
                on = np.isin(key, heavy) & (rows[:, d] > 0)
                rows, key = rows[on], _extended(key[on], rows[on, d])
            found, times = np.unique(key, return_counts=True)
            found, times = found[times >= least], times[times >= least]
            yield from common.frames({"prefix": found.view(np.int64), "n": times}, schema)

    return run


def heavy_prefixes(rows: DataFrame, known: DataFrame, bits: np.ndarray, budget: int, depth: int) -> np.ndarray:
    """Names of the prefixes, shorter than the depth, that are extended: all with more suffixes than the budget.

    A chunk leaves out what is rare in it, half a budget over all chunks at most. So a
    prefix that counts half a budget is extended.
    """
    level = known.where("word is not null").where(F.col("n") > budget // 2).select(F.col("name").alias("prefix"))
    chunks = known.where("word is null").agg(F.sum("chunks")).first()[0] or 1
    heavy = np.zeros(0, np.uint64)
    for d in range(2, depth + 1):
        # At most all words of the corpus over half a budget.
        new = level.toArrow().column("prefix").to_numpy().astype(np.int64).view(np.uint64)
        if not len(new):
            break
        heavy = np.sort(np.append(heavy, new))
        if d < depth:
            shared = rows.sparkSession.sparkContext.broadcast((bits, heavy, None))
            counted = rows.mapInArrow(_longer(shared, d, max(1, budget // (2 * chunks))), "prefix long, n long")
            level = counted.groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > budget // 2).select("prefix")
    return heavy


def ranked_words(known: DataFrame, limit: int = RANKED) -> tuple[np.ndarray, np.ndarray]:
    """Names of the most frequent words, at most `limit`, sorted, and their ranks.

    Words are counted by the eighth of a power of two that their count lies in; all that
    lie above a step that keeps the limit are taken.
    """
    words = known.where("word is not null").select("name", "n", F.floor(F.log2("n") * 8).cast("int").alias("step"))
    room, cut = limit, None
    for row in sorted(words.groupBy("step").count().collect(), key=lambda x: -x["step"]):
        room -= row["count"]
        if room < 0:
            break
        cut = row["step"]
    found = words.where(F.col("step") >= cut if cut is not None else F.lit(False)).select("name", "n").toArrow()
    names = found.column("name").to_numpy().astype(np.int64).view(np.uint64)
    names = names[np.lexsort((names, -found.column("n").to_numpy().astype(np.int64)))]
    order = np.argsort(names)
    return names[order], order.astype(np.uint32)


def packed(rows: np.ndarray, times: np.ndarray, ranked: tuple[np.ndarray, np.ndarray]) -> tuple[int, bytes]:
    """A block of suffixes: sizes, ranks of its words and names of those without, then columns of numbers into these, then counts."""
    sorted_names, ranks = ranked
    found, codes = np.unique(rows.ravel(), return_inverse=True)
    at = np.searchsorted(sorted_names, found)
    at[at == len(sorted_names)] = 0
    known = sorted_names[at] == found if len(sorted_names) else np.zeros(len(found), bool)
    # Frequent words first, so that their numbers are small.
    rank = np.where(known, ranks[at] if len(ranks) else 0, len(ranks) + np.arange(len(found)))
    order = np.argsort(rank, kind="stable")
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    told, named = rank[order[: known.sum()]], found[order[known.sum() :]]
    columns = place[codes.reshape(rows.shape).T.ravel()].astype(np.uint32)
    wide = columns.view(np.uint8).reshape(-1, 4).T[: 2 if len(found) <= 1 << 16 else 4]
    head = np.array([*rows.shape, len(told), len(named), len(wide)], np.int32)
    block = b"".join([head.tobytes(), np.diff(told, prepend=0).astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes(), named.tobytes(), np.ascontiguousarray(wide).tobytes()])
    return len(block), pa.compress(block, "zstd", asbytes=True)


def unpacked(size: int, block: bytes, ranked_names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and counts of a block. `ranked_names`: names in the order of their ranks."""
    block = pa.decompress(block, size, "zstd", asbytes=True)
    n, depth, m, more, width = np.frombuffer(block, np.int32, 5).tolist()
    told = np.cumsum(np.frombuffer(block, np.uint32, m, 20), dtype=np.int64)
    times = np.frombuffer(block, np.uint32, n, 20 + 4 * m)
    found = np.concatenate([ranked_names[told], np.frombuffer(block, np.uint64, more, 20 + 4 * (m + n))])
    planes = np.frombuffer(block, np.uint8, width * n * depth, 20 + 4 * (m + n) + 8 * more).reshape(width, -1)
    codes = np.zeros((n * depth, 4), np.uint8)
    codes[:, :width] = planes.T
    return found[codes.view(np.uint32).reshape(depth, n).T], times


def _runs(rows: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows (by `more` first), and in it the first column at which a row differs from the one before."""
    codes = np.unique(rows.ravel(), return_inverse=True)[1].reshape(rows.shape).astype(np.int32)
    order = np.lexsort((*codes.T[::-1], *more))
    codes = codes[order]
    differ = np.full(len(rows), -1, np.int8)
    if len(rows):
        changed = codes[1:] != codes[:-1]
        differ[1:] = np.where(changed.any(axis=1), changed.argmax(axis=1), rows.shape[1])
        for column in more:
            column = column[order]
            differ[1:][column[1:] != column[:-1]] = -1
    return order, differ


def _dealt(shared, groups: int, depth: int, chunk: int):
    """Suffixes of at least two words, in blocks for their groups."""

    def blocks(rows: np.ndarray, heavy: np.ndarray, ranked: tuple) -> Iterator[pa.RecordBatch]:
        rows = rows[rows[:, 1] > 0]
        if not len(rows):
            return
        group = (common.mixed(prefixes(rows, heavy)) % np.uint64(groups)).astype(np.int64)
        order, differ = _runs(rows, group)
        first = np.flatnonzero(differ < depth)
        times = np.diff(np.append(first, len(rows)))
        rows, group = rows[order[first]], group[order[first]]
        at = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
        made = [packed(rows[a:b], times[a:b], ranked) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        schema = pa.schema([("group", pa.int64()), ("size", pa.int32()), ("block", pa.binary())])
        columns = {"group": group[at[:-1]], "size": np.array([size for size, _ in made], np.int32), "block": pa.array([b for _, b in made], pa.binary())}
        yield from common.frames(columns, schema, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, (bits, heavy, ranked) = common.Names(1 << 21), shared.value
        held, size = [], 0
        for _, _, _, (named, piece, *_) in _chunks(batches, names):
            rows = suffixes(named, piece, bits, depth)
            held.append(rows[rows[:, 1] > 0])
            size += len(held[-1])
            if size >= chunk:
                yield from blocks(np.concatenate(held), heavy, ranked)
                held, size = [], 0
        if held:
            yield from blocks(np.concatenate(held), heavy, ranked)

    return run


def subtree(rows: np.ndarray, times: np.ndarray, heavy: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of two words and more, level by level: their words and counts.

    Nodes under the least count go, but for heavy prefixes, of which other groups hold the rest.
    """
    order, differ = _runs(rows)
    rows, times = rows[order], times[order].astype(np.int64)
    key = rows[:, 0]
    for d in range(1, rows.shape[1]):
        key = _extended(key, rows[:, d])
        first = np.flatnonzero((differ <= d) & (rows[:, d] > 0))
        if not len(first):
            return
        # A node's rows lie together; those between two nodes are shorter suffixes.
        edges = np.flatnonzero(differ <= d)
        total = np.add.reduceat(times, edges)[np.searchsorted(edges, first)]
        stays = (total >= least) | np.isin(key[first], heavy)
        yield rows[first[stays], : d + 1], total[stays]


NODES = "words array<long>, n long"


def _grown(shared, least: int):
    def run(group: pa.Table) -> pa.Table:
        _, heavy, (names, ranks) = shared.value
        by_rank = np.zeros(len(ranks), np.uint64)
        by_rank[ranks] = names
        parts = [unpacked(size, block, by_rank) for size, block in zip(group.column("size").to_pylist(), group.column("block").to_pylist())]
        rows, times = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        del parts
        lists, totals = [], []
        for words, total in subtree(rows, times, heavy, least):
            ends = np.arange(0, words.size + 1, words.shape[1], dtype=np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(words.ravel().view(np.int64))))
            totals.append(pa.array(total))
        kinds = [pa.list_(pa.int64()), pa.int64()]
        return pa.Table.from_arrays([pa.chunked_array(x, kind) for x, kind in zip((lists, totals), kinds)], names=["words", "n"])

    return run


def phrase_counts(rows: DataFrame, known: DataFrame, least: int = LEAST, depth: int = DEPTH, budget: int = BUDGET, chunk: int = CHUNK, ranked: int = RANKED) -> DataFrame:
    """`words` (names) and `n` of all phrases of 2 to `depth` words with the least count. `rows`: `lang` and `text`."""
    bits = common.bit_filter(known.where("word is not null"), "name")
    heavy = heavy_prefixes(rows, known, bits, budget, depth)
    shared = rows.sparkSession.sparkContext.broadcast((bits, heavy, ranked_words(known, ranked)))
    total = known.where("word is not null").agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-2 * total // budget))
    dealt = rows.mapInArrow(_dealt(shared, groups, depth, chunk), "group long, size int, block binary")
    nodes = dealt.groupBy("group").applyInArrow(_grown(shared, least), NODES)
    return nodes.groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def scored(counts: DataFrame, known: DataFrame) -> DataFrame:
    """`words`, `lang`, `a`, `l`, `r`, `n` and `score` of each phrase, at its lowest-scoring cut, the first of equal ones."""
    one = known.where("word is not null").select(F.array("name").alias("part"), F.col("n").alias("f"))
    parts = counts.select(F.col("words").alias("part"), F.col("n").alias("f")).union(one)
    cuts = counts.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words"))})
    cuts = cuts.join(parts.select(F.col("part").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    spoken = known.where("word is not null").select(F.col("name").alias("_first"), "lang")
    totals = known.where("word is null").select("lang", "n")
    cuts = cuts.withColumn("_first", F.element_at("words", 1)).join(spoken.join(totals, "lang"), "_first")
    wide = {name: f"cast({name} as decimal(18,0))" for name in ("a", "l", "r", "n")}
    score = F.expr(f"(({wide['a']} * {wide['n']}) * 1000) div ({wide['l']} * {wide['r']})")
    best = cuts.groupBy("words", "lang", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("words", "lang", "a", "cut.l", "cut.r", "n", "cut.score")


def maximal(counts: DataFrame, phrases: DataFrame) -> DataFrame:
    """The phrases that lie in no longer one as frequent: it would hold one of a word more, as frequent too."""
    longer = counts.where(F.size("words") > 2)
    size = F.size("words") - 1
    inner = longer.select(F.explode(F.array(F.slice("words", F.lit(1), size), F.slice("words", F.lit(2), size))).alias("words"), F.col("n").alias("a"))
    return phrases.join(inner, ["words", "a"], "left_anti")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, depth: int = DEPTH, budget: int = BUDGET, chunk: int = CHUNK, ranked: int = RANKED) -> DataFrame:
    """`lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`: each language's first phrases by score, then count, then bytes.

    A-Z count as lower case; pieces end at `.,;:!?` and line ends; words are what lies
    between spaces and tabs. A phrase's count `a` is of all its places within pieces,
    `l` and `r` are its parts' at the cut with the lowest floor(1000 * a * n / (l * r)), `n` all
    words of the language. Phrases within a longer one of the same count are left out.
    Null and blank texts have no words; a null language is `und`. Repeated rows count each
    time, ids are not read. An empty table gives no rows.
    """
    lang_of = F.coalesce(F.col(lang).cast("string"), F.lit(NONE))
    rows = common.small_batches(documents).select(lang_of.alias("lang"), common.text_of(text).alias("text"))
    known = known_words(rows, least)
    counts = checkpointed(phrase_counts(rows, known, least, depth, budget, chunk, ranked))
    found = maximal(counts, scored(counts, known))
    spelled = found.select("words", F.posexplode("words").alias("at", "name")).join(known.where("word is not null").select("name", "word"), "name")
    spelled = spelled.groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("_w")).select("words", F.array_join(F.col("_w.word"), " ").alias("phrase"))
    found = found.join(spelled, "words").withColumn("_salt", F.pmod(F.xxhash64("words"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each part, so that a language's phrases do not all meet in one task.
    for keys in (["lang", "_salt"], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang),
placed AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM worded, (SELECT unnest(range(1, 6)) AS k)),
grams AS (SELECT lang, k, ws[i : i + k - 1] AS w, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, k AS size, w, f AS a, unnest(range(1, k)) AS cut FROM grams WHERE k > 1),
scores AS (
  SELECT c.lang, c.size, c.w, c.a, c.cut, p.f AS l, q.f AS r, t.n,
    ((1000::HUGEINT * c.a * t.n) // (p.f::HUGEINT * q.f))::BIGINT AS score
  FROM cuts c JOIN grams p ON p.lang = c.lang AND p.w = c.w[1 : c.cut]
    JOIN grams q ON q.lang = c.lang AND q.w = c.w[c.cut + 1 : c.size]
    JOIN totals t ON t.lang = c.lang
),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, w[s : s + n - 1] AS w, max(f) AS f
  FROM (SELECT g.*, m.n, unnest(range(1, g.k - m.n + 2)) AS s FROM grams g JOIN (SELECT unnest(range(2, 5)) AS n) m ON m.n < g.k)
  GROUP BY ALL
),
kept AS (
  SELECT x.*, array_to_string(x.w, ' ') AS phrase FROM lowest x
  WHERE NOT EXISTS (SELECT 1 FROM inner_ y WHERE y.lang = x.lang AND y.w = x.w AND 100 * y.f >= 100 * x.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""

"""Toxicity by a weighted finite-state pattern grammar over clauses.

Tokens are read as classes. Five transducers read the classes of a clause: insults,
threats, targets, negation and reported speech, each a small machine of its own. Insult and
threat machines emit weights on their arcs; a threat is a phrase: a modal, a word of harm
and a target within reach of each other, in either order of the last two, or a word of harm
right before a target. `compose` multiplies the five into one table that reads a clause
once. Targets are read from both ends, so that one may follow the insult it belongs to. What
is emitted becomes a pattern by the states of the others: plain, at a target, negated, or
reported. A document's score rests on the weights of the patterns its clauses emit, not on
the words by themselves.

Words of insult are learned from labelled rows: words, and stems of words, that set toxic
documents apart; so are words of harm, from where they stand between a modal and a target.
Copies of one text count once. A logistic regression, pulled towards the grammar's own
weights where labels say nothing, turns pattern sums to a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm import common, fitting
from emberline.llm.components import checkpointed
from emberline.llm.decontaminate import tokens

# Labelled documents that words and weights are learned from, at most about so many.
SAMPLE = 20_000
FOLDS = 5
# Lengths of learned stems in characters.
STEMS = range(3, 9)
# Least documents with a learned word, and least share of toxic ones among them.
SUPPORT, PURITY = 5, 0.8

OTHER, INSULT, HARM, TARGET, NEGATION, REPORT, MODAL = range(7)
KINDS = 7
PATTERNS = ("insult", "targeted insult", "negated insult", "reported insult", "threat", "targeted threat", "negated threat", "reported threat")
# The grammar's own weights per unit of evidence, and the intercept.
PRIOR = np.array([0.8, 1.2, 0.1, 0.3, 0.4, 1.2, 0.0, 0.2, -3.0])

# Word classes, by language. Insults and words of harm are added to from labels.
WORDS = {
    INSULT: "idiot moron stupid loser scum idiota imbécile dummkopf",
    HARM: "kill hurt destroy beat stab shoot murder burn suffer die bleed töten schlagen umbringen verbrennen tuer frapper brûler matar golpear destruir quemar",
    TARGET: "you your yours yourself u they them du dich dir ihr euch sie tu toi vous ils eux tú ti usted ustedes ellos",
    NEGATION: "not no never neither nor without isn aren wasn don doesn didn won nicht kein keine nie niemals ohne pas jamais aucun sans nunca jamás sin",
    REPORT: "said says say told wrote claimed called reported quoted according sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según",
    MODAL: "will ll shall must should gonna going werde werden wird soll muss vais va allons doit voy vamos debe",
}


@dataclass(frozen=True)
class Machine:
    """States, the next state by (state, class), and weights emitted on the way; classes not named lead to `rest`."""

    states: int
    moves: dict[tuple[int, int], int]
    rest: tuple[int, ...]
    emits: dict[tuple[int, int], float] = field(default_factory=dict)

    def step(self, state: int, kind: int) -> int:
        return self.moves.get((state, kind), self.rest[state])


# Tokens that a modal and a word of harm reach, and a word of harm without a modal.
REACH, NEAR = 4, 2


def _threats() -> Machine:
    """Nothing; a modal; a modal and harm; a modal and a target; harm alone: each with the tokens that are left."""
    states = [("none", 0)] + [(name, k) for name, most in (("modal", REACH), ("both", REACH), ("aimed", REACH), ("harm", NEAR)) for k in range(1, most + 1)]
    at = {state: i for i, state in enumerate(states)}
    moves, emits, rest = {}, {}, []
    for (name, k), i in at.items():
        rest.append(at[(name, k - 1)] if k > 1 else at["none", 0])
        moves[i, MODAL] = at["both", REACH] if name == "both" else at["modal", REACH]
        moves[i, HARM] = at["both", REACH] if name in ("modal", "both") else at["harm", NEAR]
        if name == "modal":
            moves[i, TARGET] = at["aimed", REACH]
        if name == "aimed":
            moves[i, HARM], emits[i, HARM] = at["none", 0], 1.0
            moves[i, TARGET] = at["aimed", REACH]
        if name in ("both", "harm"):
            moves[i, TARGET], emits[i, TARGET] = at["none", 0], 1.0 if name == "both" else 0.5
    return Machine(len(states), moves, tuple(rest), emits)


INSULTS = Machine(1, {}, (0,), {(0, INSULT): 1.0})
THREATS = _threats()
# A negation reaches four tokens on; a report and a target hold for the rest of the clause.
NEGATED = Machine(5, {(s, NEGATION): 4 for s in range(5)}, (0, 0, 1, 2, 3))
REPORTED = Machine(2, {(0, REPORT): 1}, (0, 1))
TARGETED = Machine(2, {(0, TARGET): 1}, (0, 1))


def compose(*machines: Machine) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]:
    """Next state and emitted weights [state, class] over the product of the machines' states."""
    states = [()]
    for machine in machines:
        states = [s + (k,) for s in states for k in range(machine.states)]
    place = {s: i for i, s in enumerate(states)}
    table, emitted = np.zeros((len(states), KINDS), np.int64), np.zeros((len(states), KINDS, len(machines)))
    for state in states:
        for kind in range(KINDS):
            table[place[state], kind] = place[tuple(m.step(k, kind) for m, k in zip(machines, state))]
            emitted[place[state], kind] = [m.emits.get((k, kind), 0.0) for m, k in zip(machines, state)]
    return table, emitted, states


TABLE, EMITTED, STATES = compose(INSULTS, THREATS, TARGETED, NEGATED, REPORTED)


def read_clause(kinds: list[int], weights: list[float]) -> list[tuple[int, float]]:
    """Patterns of a clause and their weights: what the arcs emit times the insult's own, or the last word of harm's."""
    ahead, target = [0] * len(kinds), 0
    for i in range(len(kinds) - 1, -1, -1):
        ahead[i] = target
        target = TARGETED.step(target, kinds[i])
    state, harm, found = 0, 0.0, []
    for i, (kind, weight) in enumerate(zip(kinds, weights)):
        if kind == HARM:
            harm = weight
        insult, threat = EMITTED[state, kind, :2]
        state = int(TABLE[state, kind])
        if insult or threat:
            _, _, targeted, negated, reported = STATES[state]
            form = 2 if negated else 3 if reported else 1 if (targeted or ahead[i] if insult else threat == 1) else 0
            found.append((form, weight * insult) if insult else (4 + form, harm * threat))
    return found


class Lexicon:
    """Classes and weights of words and stems, by 64-bit names of their bytes."""

    def __init__(self, learned: list[tuple[str, bool, float]], harm: list[tuple[str, float]] = ()):
        """`learned`: word or stem of insult, whether it is a stem, weight. `harm`: word of harm, weight."""
        entries: dict[tuple[bytes, bool], tuple[int, float]] = {}
        for kind, words in WORDS.items():
            entries |= {(w.encode(), False): (kind, 1.0) for w in words.split()}
        entries |= {(w.encode(), False): (HARM, weight) for w, weight in harm if (w.encode(), False) not in entries}
        entries |= {(w.encode(), stem): (INSULT, weight) for w, stem, weight in learned}
        names = common.Names(64)
        self.tables = []
        for size in sorted({len(w) for (w, stem) in entries if stem}):
            self.tables.append((size, *self._table([(w, v) for (w, stem), v in entries.items() if stem and len(w) == size], names)))
        self.tables.append((0, *self._table([(w, v) for (w, stem), v in entries.items() if not stem], names)))

    @staticmethod
    def _table(entries, names):
        rows = []
        for word, (kind, weight) in entries:
            data = np.frombuffer(word, np.uint8)
            names.grow(len(data))
            rows.append((int(names.of(names.sums(data), np.array([0]), np.array([len(data)]))[0]), kind, weight))
        rows.sort()
        return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def classes(self, named, sums, begin, end, names):
        """Class and weight of every token; whole words come before stems, long stems before short."""
        kind, weight = np.zeros(len(named), np.int64), np.zeros(len(named))
        for size, hashed, kinds, weights in self.tables:
            if not len(hashed):
                continue
            if size:
                rows = np.flatnonzero(end - begin >= size)
                found = names.of(sums, begin[rows], begin[rows] + size)
            else:
                rows, found = np.arange(len(named)), named
            at = np.minimum(np.searchsorted(hashed, found), len(hashed) - 1)
            hit = hashed[at] == found
            kind[rows[hit]], weight[rows[hit]] = kinds[at[hit]], weights[at[hit]]
        return kind, weight


_STOP = np.zeros(256, np.int64)
_STOP[[ord(c) for c in ".,;:!?\n()\""]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def evidence(data: np.ndarray, starts: np.ndarray, lexicon: Lexicon, names: common.Names) -> np.ndarray:
    """Sums of pattern weights of every document."""
    out = np.zeros((len(starts) - 1, len(PATTERNS)))
    names.grow(len(data))
    named, doc, begin, end = tokens(data, starts, names)
    if not len(named):
        return out
    kind, weight = lexicon.classes(named, names.sums(_LOWER[data]), begin, end, names)
    clause = np.concatenate([[0], np.cumsum(_STOP[data])])[begin] + doc
    marked = np.unique(clause[(kind == INSULT) | (kind == HARM)])
    low, high = np.searchsorted(clause, marked, "left"), np.searchsorted(clause, marked, "right")
    for a, b in zip(low.tolist(), high.tolist()):
        for form, value in read_clause(kind[a:b].tolist(), weight[a:b].tolist()):
            out[doc[a], form] += value
    return out


def _evidence(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.Names(1 << 16)
        for rows in common.gathered(batches, "text", 1 << 20):
            data, starts = common.flat(rows.column("text"))
            found = evidence(data, starts, lexicon.value, names)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts), dtype=np.int32) * found.shape[1], pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), lists], names=["doc_id", "evidence"])

    return run


@dataclass(frozen=True)
class Model:
    learned: list[tuple[str, bool, float]]
    weights: np.ndarray
    harm: list[tuple[str, float]] = ()

    def lexicon(self) -> Lexicon:
        return Lexicon(self.learned, self.harm)


def _counted(terms: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Terms that set toxic documents apart, with the log of their odds."""
    odds = F.log((F.col("bad") + 0.5) / F.lit(toxic + 1)) - F.log((F.col("good") + 0.5) / F.lit(clean + 1))
    enough = (F.col("bad") >= SUPPORT) & (F.col("bad") >= PURITY * (F.col("bad") + F.col("good"))) & (F.col("odds") > 2)
    return terms.withColumn("odds", odds).where(enough)


def _aimed(words: str) -> Column:
    """Words that stand one or two after a modal and at most three before a target."""
    def of(kind: int) -> Column:
        return F.array(*[F.lit(w) for w in WORDS[kind].split()])

    def between(i: Column) -> Column:
        before = F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i - 1, F.lit(2)))
        return F.arrays_overlap(before, of(MODAL)) & F.arrays_overlap(F.slice(words, i + 1, F.lit(3)), of(TARGET))

    places = F.filter(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda i: (i <= F.size(words)) & between(i))
    return F.array_distinct(F.transform(places, lambda i: F.element_at(words, i.cast("int"))))


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Words of insult and pattern weights from a bounded sample of labelled documents.

    `labels` has doc_id and toxic; rows without either teach nothing. Copies are told by
    their whole text: each counts once, and once per label where labels disagree.
    """
    spark = documents.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most about `sample` pairs of two numbers: a side of known size.
    known = F.broadcast(fitting.sampled(known, "doc_id", sample))
    texts = common.small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).join(known, "doc_id")
    words = F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^a-z0-9\u0080-￿]+")
    once = texts.select("toxic", words.alias("all"), F.xxhash64("text").alias("whole"))
    once = once.select("toxic", F.array_distinct("all").alias("words"), _aimed("all").alias("aimed"), "whole").dropDuplicates(["whole", "toxic"])
    once = checkpointed(once)
    totals = once.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, clean = totals[0] or 0, (totals[1] or 0) - (totals[0] or 0)
    counts = once.select("toxic", F.explode("words").alias("word")).where("word <> ''")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    whole = [(r["word"], False, r["odds"]) for r in _counted(counts, toxic, clean).collect()]
    aimed = once.select("toxic", F.explode("aimed").alias("word")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    harm = [(r["word"], min(float(r["odds"]), 6.0) / 3) for r in _counted(aimed.where("word <> ''"), toxic, clean).collect()]
    stems = counts.select("bad", "good", F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEMS])).alias("word"))
    stems = stems.where("word is not null").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum((F.col("bad") > 0).cast("int")).alias("forms"))
    begun = [(r["word"], True, r["odds"], r["bad"]) for r in _counted(stems.where("forms >= 4"), toxic, clean).collect()]
    # Of stems within each other the longest that still covers the same words.
    longer: dict[str, float] = {}
    for word, _, _, n in begun:
        for size in range(STEMS[0], len(word)):
            longer[word[:size]] = max(longer.get(word[:size], 0), n)
    kept = [(w, True, o) for w, _, o, n in begun if longer.get(w, 0) < 0.9 * n]
    learned = [(w, s, min(float(o), 6.0) / 3) for w, s, o in whole + kept]
    lexicon = spark.sparkContext.broadcast(Lexicon(learned, harm))
    found = texts.select("doc_id", "text").mapInArrow(_evidence(lexicon), "doc_id long, evidence array<double>")
    rows = found.join(known, "doc_id").select("evidence", "toxic").collect()
    if not rows:
        return Model(learned, PRIOR, harm)
    x = np.array([r["evidence"] for r in rows])
    return Model(learned, fitting.logistic(squeezed(x), np.array([r["toxic"] for r in rows], float), PRIOR), harm)


def squeezed(sums: np.ndarray) -> np.ndarray:
    """Evidence with falling returns: a long tirade is not surer than ten clauses."""
    return 10 * sums / (10 + sums)


def _scored(lexicon, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.Names(1 << 16)
        for rows in common.gathered(batches, "text", 1 << 20):
            data, starts = common.flat(rows.column("text"))
            x = squeezed(evidence(data, starts, lexicon.value, names))
            score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -40, 40)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), rows.column("held_out").combine_chunks(), pa.array(score)], names=["doc_id", "held_out", "score"])

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """`doc_id`, `held_out`, `score` and `predicted` of every row.

    A null or empty text has no clause and gets the score of no evidence. Repeated rows
    stay. `held_out` tells the fold by the id alone (a null id is held out).
    """
    lexicon = documents.sparkSession.sparkContext.broadcast(model.lexicon())
    rows = common.small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), (fitting.bucket("doc_id", FOLDS) == 0).alias("held_out"), common.text_of().alias("text"))
    out = rows.mapInArrow(_scored(lexicon, model.weights), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _kept(lexicon, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = common.Names(1 << 16)
        for rows in common.gathered(batches, "text", 1 << 20):
            x = squeezed(evidence(*common.flat(rows.column("text")), lexicon.value, names))
            yield from rows.filter(pa.array(x @ weights[:-1] + weights[-1] < 0)).to_batches()

    return run


def kept(documents: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns, that score below one half. The text's column is `text`."""
    lexicon = documents.sparkSession.sparkContext.broadcast(model.lexicon())
    return common.small_batches(documents).mapInArrow(_kept(lexicon, model.weights), documents.schema)


def judged(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from labelled rows outside the held-out fold, then scores every row."""
    taught = labels.where(fitting.bucket("doc_id", FOLDS) != 0)
    return score(documents, learn(documents, taught, sample))

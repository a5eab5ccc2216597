"""The grammar by its clauses, and accuracy on documents that taught nothing."""

import numpy as np

from emberline.llm import common, fitting, toxicity
from emberline.llm.toxicity import HARM, INSULT, MODAL, NEGATION, OTHER, PATTERNS, REPORT, TARGET

LEXICON = toxicity.Lexicon([("scum", False, 2.0), ("lowe", True, 1.5)])


def patterns(*texts):
    import pyarrow as pa

    data, starts = common.flat(pa.array(texts, pa.string()))
    found = toxicity.evidence(data, starts, LEXICON, common.Names(1 << 16))
    return [{PATTERNS[k]: round(float(v), 3) for k, v in enumerate(row) if v} for row in found]


def test_clauses_not_words():
    assert patterns("what scum", "you are scum", "Scum, you see", "this is not scum", "he said it is scum", "not one two three four scum") == [
        {"insult": 2.0},
        {"targeted insult": 2.0},
        {"insult": 2.0},
        {"negated insult": 2.0},
        {"reported insult": 2.0},
        {"insult": 2.0},
    ]
    assert patterns("loweix LOWEY lower flowe", "", None, "clean words") == [{"insult": 4.5}, {}, {}, {}]


def test_threats_are_phrases():
    assert patterns("I will kill you", "i will burn your house down", "we are going to make you suffer", "kill yourself") == [{"targeted threat": 1.0}, {"targeted threat": 1.0}, {"targeted threat": 1.0}, {"threat": 0.5}]
    assert patterns("he will beat the eggs and shoot a film", "never kill", "you will", "the film will hurt nobody here at all says you") == [{}, {}, {}, {}]
    assert patterns("I will not hurt you", "he said he will kill them. scum", "kill. you") == [{"negated threat": 1.0}, {"reported threat": 1.0, "insult": 2.0}, {}]


def naive(kinds, weights):
    """A plain reading of a clause by the distances of its words."""
    found = []
    modal = harm = aimed = None  # places since which a modal, a word of harm, a target after a modal holds
    joined = False
    for i, kind in enumerate(kinds):
        negated = any(kinds[j] == NEGATION for j in range(max(0, i - 3), i + 1))
        reported = REPORT in kinds[: i + 1]
        form = 2 if negated else 3 if reported else None
        if kind == INSULT:
            found.append((form if form is not None else int(TARGET in kinds), weights[i]))
        if modal is not None and i - modal > 4:
            modal = None
        if aimed is not None and i - aimed > 4:
            aimed = None
        if harm is not None and i - harm[0] > (4 if joined else 2):
            harm, joined = None, False
        if kind == MODAL:
            if joined:
                harm = (i, harm[1])
            else:
                modal, harm, aimed = i, None, None
        elif kind == HARM:
            if aimed is not None:
                found.append((4 + (form if form is not None else 1), weights[i]))
                modal = harm = aimed = None
            else:
                joined = joined or modal is not None
                harm, modal = (i, weights[i]), None
        elif kind == TARGET:
            if harm is not None:
                found.append((4 + (form if form is not None else int(joined)), harm[1] * (1.0 if joined else 0.5)))
                modal = harm = aimed = None
                joined = False
            elif modal is not None or aimed is not None:
                aimed, modal = i, None
    return found


def test_equals_a_naive_reader():
    r = np.random.default_rng(3)
    seen = set()
    for _ in range(4000):
        n = int(r.integers(1, 16))
        kinds = r.choice([OTHER, INSULT, HARM, TARGET, NEGATION, REPORT, MODAL], n, p=[0.4, 0.1, 0.15, 0.12, 0.05, 0.03, 0.15]).tolist()
        weights = r.random(n).tolist()
        got = toxicity.read_clause(kinds, weights)
        assert got == naive(kinds, weights), kinds
        seen |= {form for form, _ in got}
    assert seen == set(range(8))


def test_composition_runs_all_machines_at_once():
    machines = toxicity.INSULTS, toxicity.THREATS, toxicity.TARGETED, toxicity.NEGATED, toxicity.REPORTED
    table, emitted, states = toxicity.compose(*machines)
    assert len(states) == np.prod([m.states for m in machines]) and table.shape == (len(states), 7)
    r = np.random.default_rng(13)
    for _ in range(50):
        at, apart = 0, [0] * 5
        for kind in r.choice(range(7), 30).tolist():
            assert emitted[at, kind].tolist() == [m.emits.get((s, kind), 0.0) for m, s in zip(machines, apart)]
            at = table[at, kind]
            apart = [m.step(s, kind) for m, s in zip(machines, apart)]
            assert states[at] == tuple(apart)


def test_words_of_harm_are_learned_between_modal_and_target(frame):
    rows = [(i, f"tale{i} i will zorch you {i}", 1) for i in range(8)] + [(20 + i, f"we will visit you {i} zorch", 0) for i in range(8)]
    docs = frame([x[:2] for x in rows], "doc_id long, text string")
    model = toxicity.learn(docs, frame([(x[0], x[2]) for x in rows], "doc_id long, toxic int"))
    assert [w for w, _ in model.harm] == ["zorch"]


def test_held_out_accuracy(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    rows = [x for x in toxicity.judged(docs, labels).join(labels, "doc_id").collect() if x["held_out"]]
    toxic = [x["predicted"] for x in rows if x["toxic"] == 1]
    clean = [x["predicted"] for x in rows if x["toxic"] == 0]
    assert len(toxic) > 30 and np.mean(toxic) >= 0.9
    assert np.mean(clean) <= 0.02
    assert all((x["score"] >= 0.5) == (x["predicted"] == 1) for x in rows)


def test_held_out_labels_teach_nothing(frame):
    rows = [(i, f"word{i} thing " + ("grumpf" if i % 2 else "fine") + f" end{i}") for i in range(80)]
    docs = frame(rows, "doc_id long, text string")
    fold = {x[0]: x[1] for x in docs.select("doc_id", fitting.bucket("doc_id", 5)).collect()}
    labels = frame([(i, (i % 2) if fold[i] else 1 - i % 2, 0) for i, _ in rows], "doc_id long, toxic int, quality int")
    got = {x["doc_id"]: x["predicted"] for x in toxicity.judged(docs, labels).collect()}
    assert got == {i: i % 2 for i, _ in rows}


def test_texts_that_open_alike_all_teach(frame):
    rows = [(i, f"home news sport weather contact word{i} thing " + ("grumpf" if i % 2 else "fine") + f" end{i}") for i in range(80)]
    docs, labels = frame(rows, "doc_id long, text string"), frame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    assert {x["doc_id"]: x["predicted"] for x in toxicity.judged(docs, labels).collect()} == {i: i % 2 for i, _ in rows}


def test_copies_count_once_per_label_in_any_order(frame):
    rows = [(i, f"clean word{i}", 0) for i in range(40)] + [(100 + i, f"grumpf bad{i}", 1) for i in range(5)]
    rows += [(200 + i, "one quorf text", 1) for i in range(20)] + [(300 + i, "grumpf bad0", 0) for i in range(20)]
    models = []
    for order, parts in ((rows, 1), (rows[::-1], 4)):
        docs = frame([x[:2] for x in order], "doc_id long, text string", parts)
        models.append(toxicity.learn(docs, frame([(x[0], x[2]) for x in order], "doc_id long, toxic int", parts)))
    learned = [sorted(m.learned) for m in models]
    # Five different toxic texts of one word and one clean one, however many copies; one text is no support.
    assert learned[0] == learned[1] and [w for w, stem, _ in learned[0] if not stem] == ["grumpf"]


def test_odd_rows(frame):
    docs = frame([(1, None, 1), (1, None, 1), (2, "", 1), (None, "scum", 1), (3, "w " * 100_000, 1)], "doc_id long, text string, toxic int")
    labels = frame([(1, None), (None, 1), (2, 0), (99, 1)], "doc_id long, toxic int")
    got = toxicity.judged(docs, labels).collect()
    assert len(got) == 5 and len({x["score"] for x in got if x["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.judged(frame([], "doc_id long, text string"), frame([], "doc_id long, toxic int")).count() == 0


def test_regression_follows_the_labels_and_else_the_prior():
    r = np.random.default_rng(14)
    x = np.hstack([r.random((300, 1)), np.zeros((300, 1))])
    weights = fitting.logistic(x, (x[:, 0] > 0.5).astype(float), np.array([0.0, 0.7, 0.0]))
    assert weights[0] > 5 and weights[1] == 0.7 and weights[2] < 0

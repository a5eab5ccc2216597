"""Vector groups against all cosines."""

import numpy as np
import pytest

from emberline.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, node int"


def brute(rows, cosine=0.9):
    good = {i: np.array(v, np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    links = {i: [j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= cosine] for i in ids}
    out = {i: (0, i, True) for i, _ in rows}
    done = {}
    for i in ids:
        if i not in done:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in done:
                    done[j] = i
                    todo += links[j]
    return out | {i: (len(links[i]), done[i], done[i] == i) for i in ids}


def clusters(seed, count, size=32):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(count):
        near = r.standard_normal(size)
        for _ in range(r.integers(1, 8)):
            rows.append(near + r.standard_normal(size) * 0.25 * r.random())
    return [v.astype(np.float32).tolist() for v in rows]


def test_equals_all_cosines(frame):
    found = clusters(1, 40)
    found += [found[0], found[0], [2 * x for x in found[3]], [-x for x in found[4]], [1e-30 * x for x in found[5]], [0.0] * 32, [float("nan")] + found[6][1:], [float("inf")] * 32]
    found += [None, [], [None] + found[7][1:], found[8][:16], found[8][:16], [1.0], [2.0]]
    rows = [(i, v) for i, v in enumerate(found)]
    got = vectors.near_copies(frame([(*x, 1) for x in rows], SCHEMA, 5)).collect()
    want = brute(rows)
    assert {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in got} == want
    assert len(got) == len(rows)


def test_recall_near_the_threshold(frame):
    """Pairs with cosines just above the limit are the hardest to find."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(400):
        a, b = np.linalg.qr(r.standard_normal((64, 2)))[0].T
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.905 * a + np.sqrt(1 - 0.905**2) * b).tolist())]
    got = vectors.near_copies(frame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, node int")).collect()
    linked = sum(x["n_links"] > 0 for x in got) / len(got)
    assert linked >= 0.9
    assert all(x["component_id"] // 2 == x["vec_id"] // 2 for x in got)


@pytest.mark.parametrize("block", [8, 1024])
def test_a_large_group_in_blocks(frame, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    r = np.random.default_rng(3)
    near = r.standard_normal(16)
    rows = [(i, (near + 0.02 * r.standard_normal(16)).tolist()) for i in range(120)] + [(200 + i, r.standard_normal(16).tolist()) for i in range(30)]
    got = vectors.near_copies(frame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, node int")).collect()
    assert {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in got} == brute(rows)


def test_rows_without_an_id_and_repeated_rows(frame):
    rows = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)]
    got = sorted((x["vec_id"] or 0, x["n_links"], x["component_id"] or 0) for x in vectors.near_copies(frame(rows, SCHEMA)).collect())
    assert got == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_empty_table(frame):
    assert vectors.near_copies(frame([], SCHEMA)).count() == 0


def test_plan_grows_slowly():
    small, large = vectors.Plan.of(1000, 0.9, 0.995), vectors.Plan.of(10**9, 0.9, 0.995)
    assert small.bits < large.bits <= vectors.MOST_LINES and small.count == large.count


def test_cells_keep_their_size_as_vectors_grow():
    for count in (10**3, 10**6, 10**9, 10**11):
        plan = vectors.Plan.of(count, vectors.COSINE, vectors.RECALL)
        assert count / 2**plan.bits <= 4 * vectors.CELL
        # The number of a cell fits beside its table and the size of its vectors.
        assert (16_384 * plan.tables + plan.tables) << vectors.MOST_LINES < 2**63

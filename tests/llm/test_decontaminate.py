"""Spaced seeds: no window is missed, and results equal a search of all diagonals."""

import random
import re
from itertools import combinations

import pytest

from emberline.llm import decontaminate as d

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("tokens", range(1, d.WINDOW + 3))
def test_masks_miss_no_window(tokens):
    window, need = d.window_of(tokens)
    for gone in combinations(range(window), window - need):
        assert any(not {o + m for m in mask} & set(gone) for mask in d.masks_for(tokens) for o in range(window - mask[-1]))


def words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().translate(LOWER))


def brute(docs, items):
    out = {}
    for doc, text in docs:
        have = words(text)
        for item, asked in items:
            want = words(asked)
            window, need = d.window_of(len(want))
            best = 0
            for at in range(len(have) - window + 1) if want else ():
                for own in range(len(want) - window + 1):
                    best = max(best, sum(a == b for a, b in zip(have[at : at + window], want[own : own + window])))
            if best >= need > 0:
                out[doc, item] = best
    return out


def sentence(r, n):
    return " ".join("".join(r.choice("abcd漢") for _ in range(r.randint(2, 5))) for _ in range(n))


def test_equals_brute_force(frame):
    r = random.Random(4)
    items = [(i, sentence(r, n)) for i, n in enumerate([8, 9, 10, 12, 13, 14, 30, 40, 5, 0, 1, 3])] + [(90, "a b " * 10), (91, None)]
    docs = []
    for i in range(60):
        item = items[i % 8][1].split()
        at = r.randrange(max(1, len(item) - 13))
        part = item[at : at + r.randint(8, 20)] if i % 3 else item
        for _ in range(i % 4):
            part = list(part)
            part[r.randrange(len(part))] = "zzz"
        docs.append((i, f"{sentence(r, r.randint(0, 20))} {', '.join(part).upper()}; {sentence(r, 9)}"))
    docs += [(100, None), (101, ""), (102, "a b " * 30), (103, items[6][1] + " " + items[7][1]), (103, "other")]
    got = d.overlaps(frame([(*x, 0) for x in docs], "doc_id long, text string, item_id int"), frame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert len(want) > 30
    assert {(x["doc_id"], x["item_id"]): x["agree"] for x in got} == want
    text = dict(docs[:60])
    for x in got:
        if x["doc_id"] < 60:
            span = text[x["doc_id"]].encode()[x["begin"] : x["end"]]
            assert len(words(span.decode())) == x["window"]


def test_joined_seeds_give_the_same(frame):
    """A test set above the limit of one index meets the documents by a join."""
    r = random.Random(5)
    items = [(i, sentence(r, 3 + i)) for i in range(40)] + [(50, "Yes"), (51, None), (52, items_ := sentence(r, 15)), (53, items_), (7, sentence(r, 9)), (52, items_)]
    docs = [(i, f"{sentence(r, 30)} {items[i][1]} {sentence(r, 5)} {items[(i * 7) % 40][1].replace('a', 'b', 1)}") for i in range(40)]
    docs += [(None, items_ + " yes"), (None, items[30][1]), (3, "yes"), (3, "yes"), (60, None), (61, ""), (62, (items_ + " ") * 300)]
    given, asked = frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")
    whole, parts = d.overlaps(given, asked), d.overlaps(given, asked, limit=0)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, parts.collect())) and whole.count() > 70
    assert d.overlaps(frame([], "doc_id long, text string"), asked, limit=0).count() == 0
    assert d.overlaps(given, frame([], "item_id long, text string"), limit=-1).count() == 0


def test_clean_keeps_the_rest(frame):
    r = random.Random(6)
    item = sentence(r, 20)
    docs = [(1, item, "x"), (2, "fine words", "y"), (None, item, "z"), (3, None, "w")]
    kept = d.clean(frame(docs, "doc_id long, text string, kind string"), frame([(0, item)], "item_id long, text string"))
    assert sorted(x["kind"] for x in kept.collect()) == ["w", "y"]


def test_empty_tables(frame):
    docs, items = "doc_id long, text string", "item_id long, text string"
    assert d.overlaps(frame([], docs), frame([(1, "a b c d e f g h i j")], items)).count() == 0
    assert d.overlaps(frame([(1, "a b c d e f g h i j")], docs), frame([], items)).count() == 0


def test_short_items_are_found_word_for_word(frame):
    items = frame([(1, "the quick brown fox jumps over"), (2, "Yes")], "item_id long, text string")
    docs = frame([(1, "see THE quick brown fox jumps over it"), (2, "the quick brown fox leaps over it"), (3, "yes"), (4, "yesterday")], "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["agree"], x["window"]) for x in d.overlaps(docs, items).collect()}
    assert got == {(1, 1, 6, 6), (3, 2, 1, 1)}

"""Phrase mining against plain counting."""

import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from emberline.llm import common, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    """Counts of phrases up to five words per language, and of all words."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    return f, n


def brute(rows, least, top):
    f, n = counted(rows)
    out = []
    for lang, counts in f.items():
        found = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        inside = {(x[i:j], b) for x, b in found.items() for i in range(len(x)) for j in range(i + 2, len(x) + 1) if j - i < len(x)}
        best = []
        for w, a in found.items():
            score, k = min((1000 * a * n[lang] // (counts[w[:k]] * counts[w[k:]]), k) for k in range(1, len(w)))
            if not any((w, b) in inside for b in range(a, max(found.values()) + 1)):
                best.append((score, a, " ".join(w), counts[w[:k]], counts[w[k:]]))
        best.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(best[:top])]
    return sorted(out)


def corpus():
    r = random.Random(3)
    words = ["the", "The", "of", "New", "York", "a", "é", "in", "x"] + [f"w{i}" for i in range(30)]
    texts = [(r.choice(["en", "en", "fr", None]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", "!?"]) for _ in range(r.randrange(0, 60)))) for _ in range(80)]
    texts += [("en", "all documents share this long passage of words")] * 15 + [("fr", "the the the the the the the")] * 9
    return texts + [(None, None), ("en", ""), ("de", "."), ("und", "the of the"), ("xx", "lonely")]


@pytest.mark.parametrize("least, top, budget, chunk, ranked", [(6, 1000, 1 << 19, 1 << 19, 1 << 20), (6, 7, 40, 64, 5), (3, 2000, 12, 1, 1)])
def test_equals_brute_force(frame, least, top, budget, chunk, ranked):
    rows = corpus()
    docs = frame([(i, text, lang, "s") for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string, word string", 4)
    got = phrases.collocations(docs, least=least, top=top, budget=budget, chunk=chunk, ranked=ranked).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, least, top)


def test_counts_pass_64_bits(spark):
    big = 10**13
    known = spark.createDataFrame([(1, "en", "a", 5 * big), (2, "en", "b", 7 * big), (0, "en", None, 90 * big)], "name long, lang string, word string, n long")
    counts = spark.createDataFrame([([1, 2], 3 * big + 1)], "words array<long>, n long")
    got = phrases.scored(counts, known).first()
    assert got["score"] == 1000 * (3 * big + 1) * 90 * big // (5 * big * 7 * big)


def test_groups_hold_the_budget():
    """A word before every other one, and a pair before many: parts are extended until they fit."""
    r = random.Random(5)
    named = np.array([7 if i % 2 else (9 if r.random() < 0.5 else r.randrange(100, 400)) for i in range(20_000)], np.uint64) << np.uint64(40)
    bits = np.full(1 << (common.FILTER_BITS - 3), 255, np.uint8)
    rows = phrases.suffixes(named, np.zeros(len(named), np.int64), bits, 5)
    heavy, budget = np.zeros(0, np.uint64), 500
    for d in range(4):
        key = phrases.prefixes(rows, heavy)
        found, times = np.unique(key, return_counts=True)
        heavy = np.sort(np.append(heavy, found[times > budget]))
    # Equal suffixes cross as one with their count.
    assert np.unique(phrases.prefixes(np.unique(rows, axis=0), heavy), return_counts=True)[1].max() <= budget
    assert len(heavy) > 3


@pytest.mark.parametrize("known", [[], [6, 7, 1 << 60], [9, 6, 5, 8, 7, 1 << 60, 0]])
def test_blocks_come_back(known):
    rows = np.array([[5, 6, 7, 0, 0], [5, 6, 0, 0, 0], [1 << 60, 6, 7, 8, 9]], np.uint64)
    by_rank = np.array(known, np.uint64)
    order = np.argsort(by_rank)
    back, times = phrases.unpacked(*phrases.packed(rows, np.array([1, 2, 3]), (by_rank[order], order.astype(np.uint32))), by_rank)
    assert back.tolist() == rows.tolist() and times.tolist() == [1, 2, 3]


def test_words_end_at_texts_and_pieces():
    texts = ["ab cd", "ef", "", "g.h", " i", "j"]
    data, starts = common.flat(pa.array(texts))
    _, piece, text, begin, end = phrases.words_of(data, starts, np.zeros(6, np.uint64), common.Names(10))
    whole = data.tobytes()
    found = list(zip(piece.tolist(), text.tolist(), (whole[a:b] for a, b in zip(begin, end))))
    assert [[w for _, _, w in g] for _, g in groupby(found, key=lambda x: x[0])] == [[b"ab", b"cd"], [b"ef"], [b"g"], [b"h"], [b"i"], [b"j"]]


def test_very_long_text(frame):
    got = phrases.collocations(frame([(1, "one two three. " * 50_000, "en")], "doc_id long, text string, lang string")).collect()
    assert [tuple(x) for x in got] == [("en", 1, "one two three", 50_000, 50_000, 50_000, 150_000, 3000)]

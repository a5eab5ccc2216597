"""Bit-sliced filters, and accuracy on documents that taught nothing."""

from collections import Counter

import numpy as np
import pyarrow as pa

from emberline.llm import common, fitting, language

SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark, sf):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id")
    rows = [x for x in got.collect() if x["held_out"]]
    assert len(rows) > 200
    assert sum(x["lang"] == x["lang_pred"] for x in rows) >= 0.97 * len(rows)
    assert all(0 <= x["score"] <= 1 for x in rows)


def test_the_label_of_a_held_out_row_is_not_used(spark, frame):
    base = [("aaa aba baab", "xx"), ("ccd dcd dccd", "yy")]
    rows = [(i, " ".join([base[i % 2][0]] * 9), base[i % 2][1], "") for i in range(60)]
    fold = {x["doc_id"]: x["f"] for x in frame(rows, SCHEMA).select("doc_id", fitting.bucket("doc_id", 3).alias("f")).collect()}
    wrong = [(i, t, {"xx": "yy", "yy": "xx"}[lang] if fold[i] == 1 else lang, s) for i, t, lang, s in rows]
    got = {x["doc_id"]: x["lang_pred"] for x in language.identified(frame(wrong, SCHEMA)).collect()}
    assert got == {i: lang for i, _, lang, _ in rows}


def test_filter_returns_all_languages_of_an_ngram(frame):
    rows = [(i, text, lang, "") for i, (lang, text) in enumerate([("l%02d" % k, f"shared {chr(97 + k % 26)}{chr(97 + k // 26)}zq " * 8) for k in range(70)])]
    known = language.learn(frame(rows, SCHEMA))
    assert len(known.langs) == 70 and known.cells.shape[1] == 2
    text, starts = language.squeezed(pa.chunked_array([pa.array([r[1] for r in rows])]))
    hits, total = language.popcounts(text, starts, known, common.Names(len(text)))
    shared = language.grams(*language.squeezed(pa.chunked_array([pa.array(["shared"])])), 5, common.Names(64))[0]
    masks = [known.cells[language.probes(shared)[0][1], w] & known.cells[language.probes(shared)[1][1], w] for w in range(2)]
    assert sum(int(m).bit_count() for m in masks) == 70
    best, _ = language.decide(hits, total, known)
    assert best.tolist() == list(range(70))


def test_grams_stay_within_documents():
    text, starts = language.squeezed(pa.chunked_array([pa.array(["ab", None, "", "c-D  é"])]))
    assert [bytes(text[a:b]).decode() for a, b in zip(starts[:-1], starts[1:])] == [" ab", " ", " ", " c d é"]
    names = common.Names(64)
    _, edge = language.grams(text, starts, 3, names)
    assert np.diff(edge).tolist() == [1, 0, 0, 5]


def test_texts_without_letters_and_without_a_model(frame):
    rows = [(1, None, "en", ""), (2, "", "en", ""), (3, "12 34 !? €", "en", ""), (None, "word", None, ""), (5, "漢字", None, "")]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.identified(frame(rows, SCHEMA)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    taught = [(10 + i, "some words here and there " * 3, "en", "") for i in range(30)]
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.identified(frame(rows + taught, SCHEMA)).collect()}
    assert got[3] == ("und", 0.0) and got[5] == ("en", 0.0) and got[None][0] == "en"
    assert language.identified(frame([], SCHEMA)).count() == 0


def test_counts_equal_plain_sets(spark):
    """Hits per language against plain sets of n-grams: the filter adds false positives at its rate, and loses none."""
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    known = language.learn(docs)
    rows = docs.collect()
    text, starts = language.squeezed(pa.chunked_array([pa.array([r["text"] for r in rows], pa.string())]))
    plain = [bytes(text[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]

    def grams(own):
        return [own[p : p + n] for n in language.SIZES for p in range(len(own) - n + 1)]

    counts = {lang: Counter() for lang in known.langs}
    for row, own in zip(rows, plain):
        if row["lang"] is not None and row["text"] is not None:
            counts[row["lang"]].update(grams(own))
    every = Counter()
    for c in counts.values():
        every.update(c)
    rate = {lang: {g: n / c.total() for g, n in c.items()} for lang, c in counts.items()}
    most = {g: max(r.get(g, 0) for r in rate.values()) for g in every}
    held = {lang: {g for g, x in r.items() if every[g] >= language.LEAST and x >= language.SHARE * most[g]} for lang, r in rate.items()}
    assert known.langs == sorted(held) and all(held.values())
    hits, total = language.popcounts(text, starts, known, common.Names(len(text)))
    best, _ = language.decide(hits, total, known)
    clear = right = 0
    for i, own in enumerate(plain):
        found = grams(own)
        assert total[i] == len(found)
        exact = np.array([sum(g in held[lang] for g in found) for lang in known.langs])
        assert (hits[i] >= exact).all()
        # False positives of n-grams that are not the language's own.
        chance = (len(found) - exact) * known.rates
        assert (hits[i] - exact <= chance + 8 * np.sqrt(chance + 1) + 0.05 * len(found)).all()
        ranked = np.sort(exact)
        if len(found) and ranked[-1] > 1.2 * ranked[-2]:
            clear += 1
            right += best[i] == exact.argmax()
    assert clear > 100 and right == clear

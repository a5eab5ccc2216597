"""Groups of near copies against a search of all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from emberline.llm import common, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def groups(texts):
    found, least = [plain(t) for t in texts], list(range(len(texts)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if near(found[i], found[j]):
            a, b = sorted((find(i), find(j)))
            least[b] = a
    return {i: find(i) for i in range(len(texts))}


def some(seed, copies, most):
    """Texts, and copies of them with words changed, at every similarity around 0.8."""
    r = random.Random(seed)
    texts = [" ".join(r.choice(["Aa", "bb", "cé", "dd", "ee", "ff"]) + str(r.randrange(40)) for _ in range(r.choice([7, 40, 160]))) for _ in range(20)]
    for text in texts[:20]:
        for _ in range(r.randrange(copies)):
            words = text.split()
            for _ in range(r.randrange(max(1, len(words) * most // 100))):
                words[r.randrange(len(words))] = r.choice(["new", "NEW2"])
            texts.append(r.choice([" ", "\n", "\t "]).join(words))
    return texts + [None, "", " \n", "one", "ONE", "two words", "two  words", "a b c d", "a b c d e", "a b c d e f", texts[0], texts[0].upper()]


@pytest.mark.parametrize("block", [128, 4])
def test_equals_all_pairs(frame, block):
    texts = some(3, 9, 8)
    rows = list(enumerate(texts)) + [(0, texts[0])]
    got = shingles.near_copies(frame(rows, "doc_id long, text string", 5), block=block).collect()
    want = groups(texts)
    assert len(got) == len(rows) and {x["doc_id"]: x["component_id"] for x in got} == want
    assert len(set(want.values())) < len(texts) - 20


def test_rows_without_id_and_empty_table(frame):
    got = shingles.near_copies(frame([(None, "a b c d e f"), (5, "A b c d e f"), (None, "other")], "doc_id long, text string")).collect()
    assert sorted(((x["doc_id"] or 0), (x["component_id"] or 0)) for x in got) == [(0, 0), (0, 5), (5, 5)]
    assert shingles.near_copies(frame([], "doc_id long, text string")).count() == 0


def test_the_index_finds_pairs_at_the_border():
    r = random.Random(8)
    texts, pairs = [], 0
    for _ in range(1500):
        words = [str(r.random()) for _ in range(185)]
        other = [*words[:166], *(str(r.random()) for _ in range(19))]
        texts += [" ".join(words), " ".join(other)]
    names = common.Names(1 << 16)
    found, at = shingles.sets(*common.flat(pa.array(texts)), names)
    assert near(plain(texts[0]), plain(texts[1])) and (np.diff(at) == 181).all()
    lists = shingles.signatures(found, at)
    pairs = (lists[::2] == lists[1::2]).any(axis=1)
    assert pairs.mean() >= 0.998
    # Texts that share nothing share no list.
    assert not (lists[:-2:2] == lists[2::2]).any()


def test_the_stage_drops_copies_that_few_bits_miss(spark, frame):
    r = random.Random(9)
    bases = [[str(r.randrange(10**6)) for _ in range(200)] for _ in range(30)]
    rows = []
    for i, words in enumerate(bases):
        near_copy, apart = list(words), list(words)
        for k in (20, 70, 120):
            near_copy[k] = "new"
        for k in range(5, 200, 25):
            apart[k] = "new"
        # 15 of 196 shingles differ: similarity 0.86. 40 of 196: 0.66, no copy.
        rows += [(i, " ".join(words)), (100 + i, " ".join(near_copy)), (200 + i, " ".join(apart))]
    docs = frame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {*range(30), *range(200, 230)}


def test_a_common_passage_makes_no_group(frame):
    """Texts that share half their words fill lists, link nowhere, and send no sets."""
    r = random.Random(6)
    passage = " ".join(str(r.random()) for _ in range(60))
    texts = [" ".join(str(r.random()) for _ in range(60)) + " " + passage for _ in range(2000)]
    copies = [t + " end" for t in texts[:20]]
    docs = frame(list(enumerate(texts + copies)), "doc_id long, text string", 8)
    got = {x["doc_id"]: x["component_id"] for x in shingles.near_copies(docs).collect()}
    assert got == {i: i if i < 2000 else i - 2000 for i in range(2020)}
    signed = docs.mapInArrow(shingles._signed(5), "doc_id long, node long, size int, sketch binary, lists array<long>")
    posted = signed.select("node", F.explode("lists").alias("list"))
    sizes = [x["count"] for x in posted.groupBy("list").count().where("count > 1").collect()]
    assert max(sizes) > 10


def test_a_chain_of_near_texts_is_one_group(frame):
    r = random.Random(7)
    words = [str(r.randrange(10**6)) for _ in range(150)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[3 * i + 5] = f"new{i}"
    got = {x["doc_id"]: x["component_id"] for x in shingles.near_copies(frame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}
    assert not near(plain(rows[0][1]), plain(rows[-1][1]))


def test_simhash_names_candidates_without_posting_lists(spark, frame):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(f"v{i}" for i in range(400))]
    rows = frame(list(enumerate(texts)), "doc_id long, text string")
    made = rows.mapInArrow(shingles._signed(5), "doc_id long, node long, size int, sketch binary, lists array<long>, print long")
    nodes = made.drop("doc_id").withColumn("lists", F.array().cast("array<long>")).cache()
    ids = {x["doc_id"]: x["node"] for x in made.collect()}
    got = shingles.near_links(rows, nodes).collect()
    assert {frozenset((x["u"], x["v"])) for x in got} == {frozenset((ids[0], ids[1]))}

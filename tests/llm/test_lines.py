"""Line dedup against a plain reading of the rules."""

import hashlib
import random

import pytest

from emberline.llm import lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keys(text):
    return [x.translate(LOWER).strip(" \t\n\x0b\x0c\r") for x in (text or "").split("\n")]


def brute(rows, least_docs, least_chars=1):
    """Texts left of all rows."""
    order = sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0))
    holders, seen, first = {}, set(), {}
    for doc in order:
        for key in keys(doc[1]):
            holders.setdefault(key, set()).add((doc[0], doc[1] or ""))
    for doc in order:
        for n, key in enumerate(keys(doc[1])):
            if key not in seen:
                seen.add(key)
                first[key] = (*doc, n)

    def stays(doc, n, key):
        if len(key) < least_chars or not key:
            return True
        return len(holders[key]) < least_docs if least_docs else first[key] == (*doc, n)

    return [(d, [x for n, (x, key) in enumerate(zip((t or "").split("\n"), keys(t))) if stays((d, t), n, key)], t) for d, t in rows]


def corpus():
    r = random.Random(4)
    pool = ["Subscribe NOW", " subscribe now\t", "subscribe now", "é Ü", "É ü", "x", "", " \t", "ab", "AB", "one line more"] + [f"line {i}" for i in range(40)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(0, 12)))) for i in range(60)]
    return rows + [(100, "hot"), (100, "hot"), (106, "hot\nother"), (106, "again"), (None, "hot"), (101, None), (102, ""), (103, "\n" * 5), (104, "hot\nhot\nhot"), (105, "hot\r\nlast")]


@pytest.mark.parametrize("least_docs, least_chars", [(None, 1), (10, 1), (4, 3), (2, 1)])
@pytest.mark.parametrize("ranges", [3, 40])
def test_equals_brute_force(spark, frame, least_docs, least_chars, ranges):
    rows = corpus()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        docs = frame([(*x, "other") for x in rows], "doc_id long, text string, keep string", 5)
        got = lines.without_lines(docs, least_docs=least_docs, least_chars=least_chars).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute(rows, least_docs, least_chars)
    assert sorted(map(repr, got)) == sorted(f"Row(doc_id={d}, text={chr(10).join(kept)!r}, n_lines={len((t or '').split(chr(10)))}, n_dropped={len((t or '').split(chr(10))) - len(kept)})" for d, kept, t in want)


@pytest.mark.parametrize("least_docs", [None, 10])
def test_a_line_of_all_documents_fills_many_ranges(spark, frame, least_docs):
    rows = [(i, f"the same\nown {i}\nThe same") for i in range(500)]
    docs = frame(rows, "doc_id long, text string", 8)
    sizes = lines.sorted_lines(docs).groupBy("part").count().collect()
    assert len(sizes) == 8 and max(x["count"] for x in sizes) < 2 * 1500 / 8
    got = {x["doc_id"]: x["text"] for x in lines.without_lines(docs, least_docs=least_docs).collect()}
    assert got == {i: "the same\nown 0" if i == 0 and least_docs is None else f"own {i}" for i in range(500)}


def test_bitmaps_hold_no_text(frame):
    docs = frame([(1, "a\nb\nc"), (2, "b\nz\na"), (3, "q")], "doc_id long, text string")
    got = lines.bitmaps(docs).collect()
    assert [(x["doc_id"], x["n_dropped"], lines.unpacked(x["keep"], 3).tolist()) for x in got] == [(2, 2, [False, True, False])]


def test_very_long_text(frame):
    text = "\n".join(["again", *(f"row {i}" for i in range(200_000))])
    got = lines.digests(frame([(1, text), (2, "again")], "doc_id long, text string"), least_docs=2).orderBy("doc_id").collect()
    assert [(x["n_lines"], x["n_dropped"]) for x in got] == [(200_001, 1), (1, 1)]
    assert got[0]["kept_sha256"] == hashlib.sha256(text[6:].encode()).hexdigest()

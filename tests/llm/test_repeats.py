"""Suffix-array dedup against a brute-force search."""

import hashlib
import random

import pytest

from emberline.llm import repeats

SCHEMA = "doc_id long, text string, spans int"


def brute(rows, length):
    seen, out, marks = set(), {}, {}
    for d, t in set(rows):
        whole = f"{'' if d is None else d} {t or ''}".encode()
        marks.setdefault(d, {})[t or ""] = int(hashlib.md5(whole).hexdigest()[:15], 16)
    named = []
    for d, texts in marks.items():
        for t, mark in texts.items():
            own = d is None or mark != min(texts.values())
            named.append((not own, mark if own else d, d, t))
    for _, _, doc, text in sorted(named, key=lambda x: x[:2]):
        data = text.encode()
        cut = [False] * len(data)
        for p in range(len(data) - length + 1):
            part = data[p : p + length]
            if part in seen:
                cut[p : p + length] = [True] * length
            seen.add(part)
        runs = sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut))
        kept = bytes(x for x, c in zip(data, cut) if not c)
        out[doc, text] = (len(data), sum(cut), runs, hashlib.sha256(kept).hexdigest(), cut)
    return out


def letters(random_, n, alphabet="abcdefgh "):
    return "".join(random_.choice(alphabet) for _ in range(n))


def corpus(length):
    r = random.Random(length)
    line, passage = letters(r, length - 7), letters(r, 3 * length)
    near = letters(r, 6 * length)
    docs = [letters(r, 4 * length) + line + letters(r, 2 * length) for _ in range(30)]
    docs += [letters(r, r.randrange(length)) + passage[r.randrange(40) :] + letters(r, 50) for _ in range(25)]
    docs += [near[:k] + "Ü" + near[k + 1 :] for k in range(length, 4 * length, 37)]
    docs += ["ab" * 4 * length, "a" * 9 * length, "é" * 2 * length, passage, passage, near, near[1:], line, "", "x" * (length - 1)]
    docs += [letters(r, 2 * length, "ab") for _ in range(8)]
    ids = list(range(len(docs)))
    r.shuffle(ids)
    return list(zip(ids, docs))


@pytest.mark.parametrize("length", [30, 100])
def test_equals_brute_force(frame, length):
    rows = corpus(length) + [(900, None), (None, "q" * 3 * length), (None, "q" * 2 * length + "r" * 2 * length), (None, "q" * 3 * length)]
    rows += [(5, "r" * 2 * length + "s"), (5, "s" * 2 * length), (5, "s" * 2 * length)]
    got = repeats.repeated_bytes(frame([(*r, 1) for r in rows], SCHEMA, 7), length).collect()
    want = brute(rows, length)
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((k[0], *v[:4])) for k, v in want.items())
    assert len(got) == len(want) and sum(r["doc_id"] is None for r in got) == 2


def test_repeated_rows_are_one_document(frame):
    text = letters(random.Random(1), 400)
    rows = [(1, text, 0), (1, text, 0), (2, text, 0), (3, text + "y", 0)]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.repeated_bytes(frame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: 400, 3: 400}


def test_rows_without_id_equal_the_sql(spark, frame, tmp_path):
    import duckdb

    rows = corpus(100)[:40] + [(None, "n" * 150), (None, "n" * 120 + "m" * 130), (None, None), (7, "m" * 140), (7, "m" * 101 + "x")]
    docs = frame([(*r, 1) for r in rows], SCHEMA)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    assert sorted(map(repr, con.execute(repeats.ORACLE).fetchall())) == sorted(repr(tuple(x)) for x in repeats.repeated_bytes(docs).collect())


def test_texts_longer_than_a_piece(frame):
    r = random.Random(2)
    long = letters(r, 300_000)
    rows = [(0, long, 0), (1, letters(r, 1000) + long[100_000:250_000], 0)]
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"]) for x in repeats.repeated_bytes(frame(rows, SCHEMA)).collect()}
    assert got == {0: (0, 0), 1: (150_000, 1)}


def test_characters_stay_whole(frame):
    r = random.Random(3)
    body = letters(r, 200)
    # The same bytes, entered within a character: the copies differ in its first byte.
    rows = [(0, "ѐ" + body, 1), (1, "А" + letters(r, 30) + "ڐ" + body + "end", 2)]
    got = {x["doc_id"]: x for x in repeats.without_repeats(frame(rows, SCHEMA), others=("spans",)).collect()}
    assert got[0]["text"] == rows[0][1] and got[0]["spans"] == 1
    assert got[1]["text"].endswith("ڐend") and got[1]["n_removed"] == 200


def test_empty_table(frame):
    assert repeats.repeated_bytes(frame([], SCHEMA)).count() == 0
    assert repeats.without_repeats(frame([], SCHEMA)).count() == 0

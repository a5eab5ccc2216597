"""Alignment against a plain reading of the rules, with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers

from emberline.llm import align


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(align.BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.PIECES)


def brute(texts, libraries):
    """Rows after doc_id, in the order of the texts."""
    a, b = libraries
    letters = align.byte_letters()
    found = []
    for text in texts:
        whole = b" " + (text or "").encode()
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append(([], [], [], []))
            continue
        ends_a, ends_b = ([sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (bytes_a, bytes_b))
        links = [(x, y) for x, p in zip(ids_a, ends_a) for y, q in zip(ids_b, ends_b) if p == q]
        groups, p, q = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, ids_a[p : to[0]])) + "|" + ",".join(map(str, ids_b[q : to[1]])))
            p, q = to
        found.append((ids_a, ids_b, groups, links))
    counts = Counter(x for row in found for x in row[3])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for ids_a, ids_b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out, counts


def some():
    r = random.Random(2)
    words = ["the", "Straße", "naïve", "日本語", "don't", "I'll", "  ", "\n\n", "\t", "x1y22", "<|endoftext|>", "<s>", "<unk>", "<0x0A>", "😀", "\r", "…", "aaaaaaaa", "ﬁ", " ", "é"]
    texts = [r.choice([" ", ""]).join(r.choice(words) for _ in range(r.randrange(1, 25))) for _ in range(60)]
    return texts + [None, "", " ", "  ", "a▁b", "▁", "\x00", "the the the", "the the the", "é", "�"]


def test_equals_brute_force(frame, libraries):
    texts = some()
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    want, counts = brute(texts, libraries)
    docs = frame(rows, "doc_id long, text string, a string")
    got = {x["doc_id"]: tuple(x)[1:] for x in align.digests(docs).collect()}
    assert got == dict(enumerate(want))
    assert any(w[0] == 0 for t, w in zip(texts, want) if t)
    pairs = {(x["a"], x["b"]): x["n"] for x in align.pair_counts(docs).collect()}
    assert pairs == counts


def test_groups_cover_both_lists(frame):
    got = align.aligned(frame([(1, "unbelievable naïveté"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["a_ends"][-1] == len(got[0]["a"]) and got[0]["b_ends"][-1] == len(got[0]["b"])
    assert len(got[0]["a_ends"]) == len(got[0]["b_ends"]) and got[1]["a"] == []


def test_pairs_are_bounded_by_the_vocabularies():
    with open(align.BYTES, "rb") as a, open(align.PIECES, "rb") as b:
        pairs = align.Pairs(a.read(), b.read())
    assert pairs.a.plain
    assert len(pairs.codes) <= sum(map(len, pairs.a.bytes)) * 3 + sum(map(len, pairs.b.bytes)) * 3


def test_numbers_and_tokens_without_bytes():
    with open(align.BYTES, "rb") as a, open(align.PIECES, "rb") as b:
        pairs = align.Pairs(a.read(), b.read())
    width = len(pairs.b.bytes)
    assert pairs.numbers(pairs.codes // width, pairs.codes % width).tolist() == list(range(len(pairs.codes)))
    the, no = pairs.a.bytes.index(b" the"), pairs.b.bytes.index(b" the")
    assert pairs.solid and [x.tolist() for x in pairs.align(np.array([the, the]), np.array([no, no]))[:2]] == [[1, 2], [1, 2]]
    # As if an id of B had no bytes: both tokens that end there are linked.
    pairs.b.bytes[5] = b""
    pairs.sizes[1][5], pairs.solid = 0, False
    for name in ("codes", "_slots"):
        vars(pairs).pop(name)
    to_a, to_b, numbers = pairs.align(np.array([the, the]), np.array([no, 5, no]))
    assert to_a.tolist() == [1, 2] and to_b.tolist() == [2, 3]
    assert sorted((pairs.codes[numbers] % width).tolist()) == sorted([no, 5, no])


def test_both_encoders_agree(libraries):
    with open(align.BYTES, "rb") as a:
        mine = align.ByteTokens(a.read())
    for text in [t for t in some() if t] + ["x" * 5000, " ".join(chr(c) for c in range(32, 0xD800, 7))]:
        assert mine.encode(text).tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_repeated_ids_and_very_long_text(frame, libraries):
    texts = ["word " * 60_000, "twice", "twice", "other"]
    got = sorted(tuple(x) for x in align.digests(frame([(None, texts[0]), (1, "twice"), (1, "twice"), (1, "other")], "doc_id long, text string")).na.fill(-1, "doc_id").collect())
    want = brute(["twice", "twice", "other"], libraries)[0]
    # Their own counts aside, which the long text may add to.
    assert [x[1:5] + x[7:] for x in got[1:]] == sorted(x[:4] + x[6:] for x in want)
    assert got[0][1] > 60_000 and got[0][3] == got[0][4]

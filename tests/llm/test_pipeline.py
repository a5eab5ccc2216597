"""Each stage does its work, keeps the rest, and takes what the one before it left."""

import random

import pytest

import corpus_pipeline
from emberline.llm import common, decontaminate, pieces, repeats, toxicity
from tests.llm.test_registered import stored
from tests.llm.test_shingles import groups


@pytest.fixture(scope="module")
def left(spark, tmp_path_factory):
    """What each stage leaves of the smallest given tables."""
    sf, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    docs = [common.table(spark, sf, "documents")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs[-1], sf).write.parquet(f"{folder}/{i}")
        docs.append(spark.read.parquet(f"{folder}/{i}"))
    return docs


def test_stages(left):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "repeats", "benchmark", "pieces"]
    for docs in left[1:-1]:
        assert docs.dtypes == [(k, {"long": "bigint"}.get(v, v)) for k, v in corpus_pipeline.COLUMNS.items()]


def texts(docs):
    return {x["doc_id"]: x["text"] for x in docs.collect()}


def test_toxic_documents_go(spark, left):
    labels = common.table(spark, "/root/testdata/sf0.001", "labels")
    verdict = {x["doc_id"]: x["predicted"] for x in toxicity.judged(left[0], labels).collect()}
    assert texts(left[1]) == {k: v for k, v in texts(left[0]).items() if not verdict[k]}


def test_one_document_of_each_group_stays(left):
    before = texts(left[1])
    ids = sorted(before)
    found = groups([before[i] for i in ids])
    assert texts(left[2]) == {i: before[i] for n, i in enumerate(ids) if found[n] == n}


def test_rows_that_share_an_id(spark, frame):
    long = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(6)]
    rows = [(1, long[0], "en"), (1, long[1], "en"), (2, long[0] + " more", "en"), (None, long[2], "en"), (None, long[2], "en"), (None, long[3], "fr"), (None, long[1], "en")]
    rows += [(3, long[4], "en"), (3, long[4], "en"), (3, long[4], "de"), (None, "", "en"), (4, " ", None)]
    docs = frame([(d, t, g, "s", 1) for d, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((x["doc_id"] or 0, x["text"]) for x in got) == sorted([(1, long[0]), (1, long[1]), (0, long[2]), (0, long[3]), (3, long[4]), (4, " ")])


def test_repeats_are_cut(left):
    before, after = texts(left[2]), texts(left[3])
    assert before.keys() == after.keys() and before != after
    cut = {x["doc_id"]: x["n_removed"] for x in repeats.repeated_bytes(left[2]).collect()}
    for doc, text in before.items():
        lost = len(text.encode()) - len(after[doc].encode())
        assert lost <= cut[doc] and (cut[doc] - lost <= 4 * 40) and (cut[doc] > 0 or after[doc] == text)
    assert all(x["n_chars"] == len(x["text"]) for x in left[3].collect() if cut[x["doc_id"]])


def test_documents_with_test_items_go(spark, left):
    found = {x["doc_id"] for x in decontaminate.overlaps(left[3], common.table(spark, "/root/testdata/sf0.001", "benchmark")).collect()}
    assert texts(left[4]) == {k: v for k, v in texts(left[3]).items() if k not in found}


def test_pieces_decode_to_what_was_left(left):
    back = {x["doc_id"]: x["text"] for x in pieces.decoded(left[5]).collect()}
    assert back == texts(left[4]) and all(x["round_trip"] for x in left[5].collect())


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_and_empty_tables(spark, tmp_path, empty):
    sf = stored(spark, tmp_path, empty)
    got = corpus_pipeline.run(spark, sf).collect()
    ids = [x["doc_id"] for x in got]
    if empty:
        assert ids == []
    else:
        # Repeated rows become one; the copy of the test item goes; rows without an id stay,
        # but for the blank one, a copy of the blank document 31.
        assert 34 not in ids and 3 in ids and ids.count(33) == 2 and ids.count(None) == 1 and 31 in ids and 32 not in ids


def test_planted_cases(spark, tmp_path):
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, item = text(60), text(30)
    docs = [(i, text(200)) for i in range(40)]
    docs += [(100, docs[0][1]), (101, docs[1][1] + " more")]
    docs += [(110, text(50) + " " + passage + " " + text(50)), (111, passage + " " + text(80))]
    docs += [(120, text(40) + " " + item + " " + text(40))]
    docs += [(130 + i, f"{text(40)} you grumpf {text(20)}. what grumpf {text(5)}") for i in range(25)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 130)) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    back = {x["doc_id"]: x["text"] for x in pieces.decoded(got).collect()}
    assert back.keys() == {*range(40), 110, 111}
    assert all(back[i] == t for i, t in docs[:40])
    assert passage in back[110] and passage not in back[111] and len(back[111]) > 100

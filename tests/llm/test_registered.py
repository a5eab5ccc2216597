"""Every registered query on the given tables, on odd rows, and on empty tables."""

import pytest

import __spark_entry__ as entry
from emberline.llm import queries
from fixtures.compare import connect, difference

ITEM = "an item of the test set that only this one document repeats word for word today"
ODD = {
    "documents": (
        [(i, f"some plain words of document {i} which differ {i * i} from all others in the end {i}", "en", "s", 10, "x") for i in range(30)]
        + [(30, "plain words " * 40_000, "en", "s", 1, "x"), (31, "", None, None, None, None), (32, None, "en", "s", 0, None), (None, "no id here at all, none", None, None, None, None)]
        + [(34, ITEM, "en", "s", 9, "x")]
        + [(None, None, None, None, None, None), (33, "twice the same row of words, twice", "fr", "s", 5, "x"), (33, "twice the same row of words, twice", "fr", "s", 5, "x"), (33, "another text", "fr", "s", 5, "x")],
        "doc_id long, text string, lang string, source string, n_chars long, spans string",
    ),
    "labels": ([(i, 1, i % 2, "x") for i in range(20)] + [(None, 1, 1, "x"), (3, None, None, None), (3, 1, 1, "x")], "doc_id long, quality int, toxic int, text string"),
    "benchmark": ([(0, ITEM), (1, None), (None, "x"), (2, ""), (2, "")], "item_id long, text string"),
    "pages": ([(1, "http://a.net/en/", "<p>x" * 50, 1), (1, "http://a.net/en/", "<p>x" * 50, 1), (2, None, None, 1), (None, "x", "<p>x" * 50, 1), (3, "", "", 1)], "page_id long, url string, html string, rule int"),
    "conversations": ([(1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (None, None, None, None, 1), (2, None, "assistant", None, 1)], "conv_id long, turn long, role string, text string, turns int"),
    "embeddings": ([(1, [1.0, 2.0], 1, 1), (1, [1.0, 2.0], 1, 1), (2, None, 1, 1), (None, [1.0, 2.0], 1, 1), (3, [0.0, 0.0], 1, 1), (4, [], None, 1), (5, [float("nan"), 1.0], 1, 1)], "vec_id long, embedding array<float>, label int, node int"),
}
ROWS = {"op1_repeats": 38, "op2_overlaps": 1, "op3_language": 39, "op4_url_rules": 5, "op5_pieces": 39, "op6_near_copies": 39, "op7_toxicity": 39, "op8_chat": 4, "op9_vectors": 7, "op10_warc": 5, "op11_lines": 39, "op12_phrases": 4, "op13_alignment": 39}


def stored(spark, folder, empty):
    for name, (rows, schema) in ODD.items():
        spark.createDataFrame([] if empty else rows, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("none"), True)


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.QUERIES) == set(ROWS)
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, name):
    assert difference(entry.queries()[name](spark, sf), connect(sf), queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(ROWS))
def test_odd_rows(spark, odd, name):
    assert len(entry.queries()[name](spark, odd).collect()) == ROWS[name]


@pytest.mark.parametrize("name", sorted(ROWS))
def test_empty_tables(spark, none, name):
    # The conversation that the query itself adds.
    assert entry.queries()[name](spark, none).count() == (name == "op8_chat")

"""Cascades against plain string comparison."""

import random

import numpy as np
import pytest

from emberline.llm import urls

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("a.example.net/en/x", "block"), ("com/", "allow"), ("com/", "block"), ("org/f", "allow"), (None, "block")]
SCHEMA = "page_id long, url string, rule string, keys string"


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        if rule is None:
            continue
        at = rule.index("/")
        fits = host and (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:])
        rank = (len(rule), at, verdict == "block")
        if fits and (best is None or rank > best[0]):
            best = (rank, rule, verdict)
    return (host, path, best[1] if best else None, best[2] if best else "allow")


def pages():
    r = random.Random(9)
    hosts = ["net", "x.net", "Example.NET", "a.example.net", "b.a.example.net", "evilexample.net", "x.com", "org", "q.org", "", "É.com", "a..net", "localhost:80"]
    paths = ["", "/", "/en/", "/en/x/y", "/en", "/fr/", "/f?x=/en/", "?a=://net/", "#net/", "/EN/"]
    made = [r.choice(["http", "HTTPS", ""]) + "://" + r.choice(hosts) + r.choice(paths) for _ in range(400)]
    return made + [None, "", "nothing", "://", "a://b://net/", "http://x.net/\nen/", "http://net/" + "y" * 5000]


@pytest.mark.parametrize("limit", [urls.LIMIT, 2])
def test_equals_string_comparison(spark, frame, limit):
    rows = list(enumerate(pages()))
    got = urls.judge(frame([(i, u, "r", "k") for i, u in rows], SCHEMA), urls.rule_table(spark, RULES), limit=limit).collect()
    assert {x["page_id"]: tuple(x)[1:] for x in got} == {i: plain(u, RULES) for i, u in rows}


def test_many_keys_are_told_apart_exactly(spark):
    n = 3000
    keys = spark.range(n).selectExpr("id", "xxhash64(id) AS first", "xxhash64('s', id) AS second", "cast(id AS string) AS rule")
    made = urls.cascade(keys.where("id % 10 = 0"), keys)
    rows = keys.collect()
    first, second = (np.array([x[c] for x in rows], np.int64).view(np.uint64) for c in ("first", "second"))
    assert made.listed(first, second).tolist() == [x["id"] % 10 == 0 for x in rows]
    assert len(made.levels) > 1
    # Far below the keys themselves.
    assert sum(level.bits for level in made.levels) < 12 * n / 10 + 600


def test_keys_that_no_filter_can_tell_apart(spark):
    one, other = (spark.createDataFrame([(1, 2, name)], "first long, second long, rule string") for name in "ab")
    with pytest.raises(RuntimeError):
        urls.cascade(one, other)


def test_listed_keys_need_not_be_in_the_universe(spark):
    one, other = (spark.createDataFrame([(n, n + 7, name)], "first long, second long, rule string") for n, name in ((1, "a"), (2, "b")))
    made = urls.cascade(one, other)
    assert made.listed(np.array([2], np.uint64), np.array([9], np.uint64)).tolist() == [False]


def test_hosts_of_many_labels(spark, frame):
    """Time follows the length of the url, not its square."""
    urls_ = ["http://" + "a." * 50_000 + "example.net/en/x", "http://" + "." * 20_000 + "net/", "http://" + "x" * 100_000 + ".org/f" + "y" * 100_000]
    got = urls.judge(frame([(i, u, "", "") for i, u in enumerate(urls_)], SCHEMA), urls.rule_table(spark, RULES)).collect()
    assert {x["page_id"]: (x["rule"], x["verdict"]) for x in got} == {i: plain(u, RULES)[2:] for i, u in enumerate(urls_)}


def test_without_rules_and_without_rows(spark, frame):
    none = urls.rule_table(spark, [])
    assert [tuple(x) for x in urls.judge(frame([(1, "http://A.b/c", "", "")], SCHEMA), none).collect()] == [(1, "a.b", "/c", None, "allow")]
    assert urls.judge(frame([], SCHEMA), urls.rule_table(spark)).count() == 0

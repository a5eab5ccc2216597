"""SimHash groups against a search of all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from emberline.llm import common, simhash
from emberline.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Smallest index reachable over differences of at most four bits."""
    least = list(range(len(prints)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = sorted((find(i), find(j)))
            least[b] = a
    return [find(i) for i in range(len(prints))]


def test_any_four_positions_hold_a_triple():
    chosen = [set(t) for t in simhash.triples()]
    assert all(any(t <= set(four) for t in chosen) for four in combinations(range(8), 4))


def test_equals_all_pairs(frame):
    r = random.Random(7)
    base = [" ".join(r.choice(["Aa", "bb", "cé", "dd", "ee", "ff"]) + str(r.randrange(40)) for _ in range(120)) for _ in range(25)]
    texts = list(base)
    for text in base:
        for _ in range(r.randrange(6)):
            words = text.split()
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = "new"
            texts.append(r.choice([" ", "\n", "\t "]).join(words))
    texts += [None, "", " \n", "one", "ONE", "two words", "a b c d", base[0], base[0].upper()]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    got = simhash.near_copies(frame([(*x, 9) for x in rows], "doc_id long, text string, print int", 5)).collect()
    prints = [plain(t) for t in texts]
    want = groups(prints)
    assert len(set(want)) < len(set(prints)) - 5
    assert len(got) == len(rows)
    for x in got:
        assert (x["fingerprint"], x["component_id"]) == (f"{prints[x['doc_id']]:016x}", want[x["doc_id"]])


@pytest.mark.parametrize("block", [4, 50, 2048])
def test_long_lists_in_blocks_link_the_same(spark, block):
    r = random.Random(8)
    prints = {0, 1, (1 << 64) - 1}
    for _ in range(6):
        near = r.getrandbits(64)
        for _ in range(60):
            prints.add(near)
            near ^= 1 << r.randrange(64) if r.random() < 0.7 else 0b10101 << r.randrange(60)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(p,) for p in signed], "print long").repartition(4)
    reached = {x["node"]: x["component"] for x in components(simhash.near_links(nodes, block=block)).collect()}
    want = groups(prints)
    mine = [reached.get(p, p) for p in signed]
    assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i, j in combinations(range(len(prints)), 2))


def test_rows_without_an_id_take_part(frame):
    rows = [(None, "same text of five words"), (7, "same text of five words"), (None, "all alone here now yes")]
    got = {x["component_id"] for x in simhash.near_copies(frame(rows, "doc_id long, text string")).collect()}
    assert got == {7, None}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(200, 200), (301, 300), (300, 301)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {300: 300, 301: 300}


def test_empty_table(frame):
    assert simhash.near_copies(frame([], "doc_id long, text string")).count() == 0


def test_groups_come_whole(spark):
    keys = [0] * 5 + [1] + [2] * 300 + [3, 3]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").coalesce(1).sortWithinPartitions("k")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")

    def sizes(batches):
        import pyarrow as pa

        for whole, at in common.groups(batches, ["k"], 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(at))], names=["n"])

    assert sorted(x["n"] for x in rows.mapInArrow(sizes, "n long").collect()) == [1, 2, 5, 300]

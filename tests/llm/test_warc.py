"""Archives give back what went in, frame by frame."""

import hashlib
import random

import zstandard

from emberline.llm import warc
from emberline.sources import folders

SCHEMA = "page_id long, url string, html string, first string"


def pages():
    r = random.Random(12)
    shared = "".join(r.choice("abc<>é") for _ in range(3000))
    rows = [(i, f"http://h/{i}", shared if i % 3 == 0 else "".join(r.choice("ab<é") for _ in range(r.randrange(400))), "x") for i in range(5, 300)]
    rows += [(1000, None, None, "x"), (1001, "", "", "x"), (1002, "u\r\nX: y", "short", "x"), (1003, "u", "short", "x"), (1004, "u", "é" * 50, "x"), (1005, "u", "é" * 50, "x")]
    rows += [(1006, "u", "a\r\n\r\nb" * 20, "x"), (None, "u", shared, "x"), (5, "u", "again" * 30, "x"), (5, "u", "again" * 30, "x"), (1007, "u", "L" * 9_000_000, "x")]
    return rows


def expected(rows):
    first = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        refers = first.get(data)
        revisit = refers is not None and refers != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", refers if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, frame):
    path = folders.workspace(spark, "warc-test")
    warc.write(frame(pages(), SCHEMA, 4), path)
    got = sorted((tuple(x) for x in warc.read(spark, path).collect()), key=repr)
    assert got == expected(pages())
    record = warc.fetch(spark, path, [1006]).first()["record"]
    fields, http, payload = warc.parse(bytes(record))
    assert payload.decode() == "a\r\n\r\nb" * 20 and fields["WARC-Record-ID"] == "<urn:page:1006>" and int(http["Content-Length"]) == len(payload)


def test_frames_are_independent_and_the_bundle_is_plain_zstandard():
    made = warc.Bundler()
    records = [bytes([65 + i % 26]) * 60_000 for i in range(12)]
    for i, data in enumerate(records):
        made.add(i, data)
    batch = made.finish()
    bundle = batch.column(1)[0].as_py()
    frames = warc.frames_of(bundle)
    assert len(frames) > 2
    for at in batch.column(2)[0].as_py():
        assert warc.frame(bundle, at["frame"])[at["offset"] : at["offset"] + at["length"]] == records[at["page_id"]]
    # A reader that knows nothing of the seek table skips it.
    reader = zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True)
    assert reader.read() == b"".join(records)


def test_damage_is_noticed(spark):
    good = warc.record(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), None, False, "d", 200)
    assert warc.parse(good)[2] == b"x" * 200
    for bad in (good[:-1], good[5:], good + b"y"):
        try:
            warc.parse(bad)
        except ValueError:
            continue
        raise AssertionError("damage went unnoticed")


def test_empty_table(spark, frame):
    path = folders.workspace(spark, "warc-none")
    warc.write(frame([], SCHEMA), path)
    assert warc.read(spark, path).count() == 0

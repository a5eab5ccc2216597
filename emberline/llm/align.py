"""Alignment of two tokenizers' tokens by the byte offsets where both end one.

Each text is encoded twice: a space and the text by a byte-level BPE (A), the text by a
SentencePiece model that adds the space itself (B). Both token lists cover the same bytes,
so the cumulative ends of each go into a dictionary from end to index, a table addressed by
the end itself; the keys that both hold, in order, cut both id lists into groups, and each
group links the tokens that end with it.

Of two tokens that end together the shorter one's bytes end the longer one's. So the
vocabularies alone tell all pairs that can ever be linked (`Pairs.codes`, some 10^5): counts
over the corpus have that many rows at most, whatever the corpus, and that is the size of
what tasks get to score their documents by. Texts are encoded once; their links wait in the
shared folder, as sorted and compressed pair numbers.

A text that is null or empty, or whose tokens of A or B do not join to a space and the text
again (a model may normalize), has no tokens. Rows are answered one by one, repeated ids
too, and all of them count.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import common
from emberline.llm.components import checkpointed

BYTES = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
# Fixed value: how byte-level BPE splits text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """A byte-level BPE, from the text of its JSON file. Special tokens' strings are plain text."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        letters = byte_letters()
        entries = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.file, self.plain = file, self._plain(spec)

    @staticmethod
    def _plain(spec: dict) -> bool:
        """Whether ids are in the order of merges, which a rank encoder needs, and words split by the usual rule."""
        vocab, before = spec["model"]["vocab"], spec["pre_tokenizer"] or {}
        merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        ranks = [vocab[a + b] for a, b in merges]
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        return usual and not spec["normalizer"] and not spec["model"].get("ignore_merges") and ranks == sorted(ranks) and len(vocab) == 256 + len(ranks)

    @cached_property
    def _encode(self):
        if self.plain:
            special = {x["id"] for x in json.loads(self.file)["added_tokens"]}
            ranks = {token: i for i, token in enumerate(self.bytes) if i not in special}
            known = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            return lambda text: known.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        found = tokenizers.Tokenizer.from_str(self.file.decode())
        found.encode_special_tokens = True
        return lambda text: np.array(found.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self._encode(" " + text)


class PieceTokens:
    """A SentencePiece model, from the bytes of its file."""

    def __init__(self, file: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(MARKER, " ").encode())

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int64)


class Pairs:
    """Two tokenizers, and all pairs of their tokens that can end together."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteTokens(a), PieceTokens(b)
        self.sizes = [np.array([len(x) for x in t.bytes]) for t in (self.a, self.b)]
        self.solid = min(map(min, self.sizes)) > 0

    @cached_property
    def codes(self) -> np.ndarray:
        """`a * len(b) + b` of the pairs, sorted; a pair's place here is its number."""
        by_a, by_b, found = {}, {}, set()
        for known, tokens in ((by_a, self.a.bytes), (by_b, self.b.bytes)):
            for i, token in enumerate(tokens):
                known.setdefault(token, []).append(i)
        width = len(self.b.bytes)
        for i, token in enumerate(self.a.bytes):
            found.update(i * width + j for k in range(len(token) + 1) for j in by_b.get(token[k:], ()))
        for j, token in enumerate(self.b.bytes):
            found.update(i * width + j for k in range(len(token) + 1) for i in by_a.get(token[k:], ()))
        return np.array(sorted(found), np.int64)

    @cached_property
    def _slots(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers of the pairs in an open-addressed table, and how far a pair may lie from its slot."""
        size = 1 << (8 * len(self.codes)).bit_length()
        slots, left, step = np.full(size, -1, np.int32), np.arange(len(self.codes)), 0
        while len(left):
            at = (self._slot(self.codes[left], size) + step) % size
            free = slots[at] < 0
            slots[at[free]] = left[free]
            left, step = left[slots[at] != left], step + 1
        return slots, self.codes, step

    @staticmethod
    def _slot(codes: np.ndarray, size: int) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of pairs of tokens."""
        slots, codes, steps = self._slots
        want = a * len(self.b.bytes) + b
        at = self._slot(want, len(slots))
        out = slots[at]
        for step in range(1, steps):
            off = np.flatnonzero(codes[out] != want)
            if not len(off):
                break
            out[off] = slots[(at[off] + step) % len(slots)]
        return out

    @cached_property
    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids with what follows them, as rows of bytes, and which bytes are used: of A within a list and at its end, then of B."""
        texts = [b"%d%c" % (i, sign) for tokens, signs in ((self.a.bytes, b",|"), (self.b.bytes, b",;")) for sign in signs for i in range(len(tokens))]
        width = max(map(len, texts))
        rows = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(-1, width)
        return rows, rows > 0

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by A and by B, or None if one of them does not join to the text."""
        if not text:
            return None
        whole = b" " + text.encode()
        ids = []
        for tokens in (self.a, self.b):
            found = tokens.encode(text)
            # Plain byte-level tokens always join to their text.
            if not (tokens is self.a and tokens.plain) and b"".join(map(tokens.bytes.__getitem__, found.tolist())) != whole:
                return None
            ids.append(found)
        return ids[0], ids[1]

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of A and of B up to the end of each group, and the numbers of the linked pairs."""
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        at_a, at_b = np.zeros((2, int(ends_a[-1]) + 1), np.int32)
        # Of tokens that end together the last one stands.
        at_a[ends_a], at_b[ends_b] = np.arange(1, len(a) + 1), np.arange(1, len(b) + 1)
        keys = np.flatnonzero((at_a > 0) & (at_b > 0))
        to_a, to_b = at_a[keys].astype(np.int64), at_b[keys].astype(np.int64)
        if self.solid:
            return to_a, to_b, self.numbers(a[to_a - 1], b[to_b - 1])
        # Tokens without bytes end where the one before them does.
        many_a = to_a - np.searchsorted(ends_a, keys)
        many_b = to_b - np.searchsorted(ends_b, keys)
        each = many_a * many_b
        step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        wide = np.repeat(many_b, each)
        return to_a, to_b, self.numbers(a[np.repeat(to_a, each) - 1 - step // wide], b[np.repeat(to_b, each) - 1 - step % wide])

    def groups_text(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> bytes:
        """All groups as `a1,a2|b1;a3|b2,b3`."""
        rows, used = self.written
        size_a, size_b = len(self.a.bytes), len(self.b.bytes)
        first, second = a.copy(), b + 2 * size_a
        first[to_a - 1] += size_a
        second[to_b - 1] += size_b
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(np.append(0, to_b[:-1]), np.diff(to_a, prepend=0))] = first
        out[np.arange(len(b)) + np.repeat(to_a, np.diff(to_b, prepend=0))] = second
        return rows[out][used[out]].tobytes()[:-1]


_PAIRS: dict[tuple[int, int], Pairs] = {}


def _pairs(files) -> Pairs:
    """The tokenizers of a worker, built once."""
    key = (hash(files[0]), hash(files[1]))
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pairs(*files)
    return _PAIRS[key]


def _files(df: DataFrame, a: str, b: str):
    """The tokenizers' files (about 2 MB), read where the query is planned and sent to the tasks."""
    with open(a, "rb") as first, open(b, "rb") as second:
        return df.sparkSession.sparkContext.broadcast((first.read(), second.read()))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list]]:
    for rows in common.gathered(batches, "text", CHUNK):
        yield rows, rows.column("text").to_pylist()


def _rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    return common.small_batches(documents).select(F.col(key).cast("long").alias("doc_id"), common.text_of(text).alias("text"))


def aligned(documents: DataFrame, key: str = "doc_id", text: str = "text", a: str = BYTES, b: str = PIECES) -> DataFrame:
    """`doc_id`, the token ids `a` and `b`, and where each group ends in them (`a_ends`, `b_ends`)."""
    files = _files(documents, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(files.value)
        for rows, texts in _texts(batches):
            out = []
            for one in texts:
                ids = pairs.encode(one)
                out.append((*ids, *pairs.align(*ids)[:2]) if ids else ([], [], [], []))
            lists = [pa.array([x[i] for x in out], pa.list_(pa.int32())) for i in range(4)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), *lists], names=["doc_id", "a", "b", "a_ends", "b_ends"])

    return _rows(documents, key, text).mapInArrow(run, "doc_id long, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>")


def packed(numbers: np.ndarray) -> bytes:
    """Pair numbers, order aside."""
    steps = np.diff(np.sort(numbers), prepend=0).astype(np.int32)
    return pa.compress(steps.tobytes(), "zstd", asbytes=True)


def unpacked(links: bytes, count: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(links, 4 * count, "zstd"), np.int32), dtype=np.int64)


KEPT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _encoded(files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(files.value)
        for rows, texts in _texts(batches):
            out = []
            for one in texts:
                ids = pairs.encode(one)
                if not ids:
                    out.append((0, 0, 0, 0, "", None))
                    continue
                to_a, to_b, numbers = pairs.align(*ids)
                digest = hashlib.sha256(pairs.groups_text(*ids, to_a, to_b)).hexdigest()
                out.append((len(ids[0]), len(ids[1]), len(to_a), len(numbers), digest, packed(numbers)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), *columns], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return run


def _tallied(size: int):
    """How often each pair number occurs in the links of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size, np.int64), False
        for batch in batches:
            for links, count in zip(batch.column("links"), batch.column("n_links").to_pylist()):
                if links.is_valid:
                    numbers, times = np.unique(unpacked(links.as_buffer(), count), return_counts=True)
                    total[numbers] += times
                    seen = True
        if seen:
            numbers = np.flatnonzero(total)
            yield from common.frames({"pair": numbers.astype(np.int32), "n": total[numbers]}, pa.schema([("pair", pa.int32()), ("n", pa.int64())]))

    return run


def _scored(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = known.value
        for batch in batches:
            n_best, count_sum = [], []
            for links, count in zip(batch.column("links"), batch.column("n_links").to_pylist()):
                numbers = unpacked(links.as_buffer(), count) if links.is_valid else np.zeros(0, np.int64)
                n_best.append(int(best[numbers].sum()))
                count_sum.append(int(counts[numbers].sum()))
            columns = {name: batch.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
            columns |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": batch.column("groups_sha256")}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _counted(encoded: DataFrame, size: int) -> np.ndarray:
    """Corpus-wide count of each pair number."""
    counts = np.zeros(size, np.int64)
    # One row per pair of the vocabularies at most.
    found = encoded.select("links", "n_links").mapInArrow(_tallied(size), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return counts


def pair_counts(documents: DataFrame, text: str = "text", a: str = BYTES, b: str = PIECES) -> DataFrame:
    """`a`, `b`, `n`: how many links of the corpus hold each pair of ids, and `best`: whether none of its `b` is held more often."""
    files = _files(documents, a, b)
    pairs = _pairs(files.value)
    encoded = _rows(documents.withColumn("_none", F.lit(None).cast("long")), "_none", text).mapInArrow(_encoded(files), KEPT)
    counts = _counted(encoded, len(pairs.codes))
    there, width = np.flatnonzero(counts), len(pairs.b.bytes)
    codes = pairs.codes[there]
    table = pa.table({"a": (codes // width).astype(np.int32), "b": (codes % width).astype(np.int32), "n": counts[there], "best": _best(pairs, counts)[there]})
    return documents.sparkSession.createDataFrame(table)


def _best(pairs: Pairs, counts: np.ndarray) -> np.ndarray:
    right = pairs.codes % len(pairs.b.bytes)
    most = np.zeros(len(pairs.b.bytes), np.int64)
    np.maximum.at(most, right, counts)
    return counts == most[right]


def digests(documents: DataFrame, key: str = "doc_id", text: str = "text", a: str = BYTES, b: str = PIECES) -> DataFrame:
    """Per row: `doc_id`, tokens `n_a` and `n_b`, `n_groups`, `n_links`, `n_best` (links whose pair is
    held most often of all with its b), `count_sum` (of the links' pairs) and `groups_sha256`."""
    files = _files(documents, a, b)
    pairs = _pairs(files.value)
    encoded = checkpointed(_rows(documents, key, text).mapInArrow(_encoded(files), KEPT))
    counts = _counted(encoded, len(pairs.codes))
    known = documents.sparkSession.sparkContext.broadcast((counts, _best(pairs, counts)))
    return encoded.mapInArrow(_scored(known), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

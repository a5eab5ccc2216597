"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The trie holds the pieces' bytes, the whitespace marker as a plain space. A text is
encoded as the chain of pieces with the greatest sum of log scores; a character that no
piece covers costs more than any piece and is written as byte pieces. Decoding joins
pieces, turns markers to spaces and drops the one put before the text.

No piece goes from a letter on into the next word, so words are encoded one by one: a
task encodes each distinct word of a chunk once, all of them together, position by
position. Vocabularies with pieces across words are encoded text by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
# A character without a piece scores this much less than the worst piece.
PENALTY = 10.0
# Words up to so many bytes are encoded together, longer ones one by one.
TOGETHER = 96


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id. `kinds`: 0 piece, 1 byte, 2 not encoded (control, unknown, unused)."""

    pieces: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray

    @staticmethod
    def load(path: str) -> Vocabulary:
        """A SentencePiece model file. Whole scores of merges count as ranks, and score by their frequency's law.

        Merge ranks are no log scores; under Zipf's law the piece of rank r has a share
        in proportion to 1 / (r + 1), whose logarithm takes the rank's place.
        """
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        pieces, scores, kinds = [], np.zeros(count), np.zeros(count, np.int8)
        for i in range(count):
            piece, scores[i] = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                kinds[i] = 1
                pieces.append(bytes([int(piece[3:5], 16)]))
            else:
                kinds[i] = 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0
                pieces.append(piece.replace(MARKER, " ").encode())
        real = scores[kinds == 0]
        if len(real) and (real == np.round(real)).all():
            scores = -np.log1p(-scores) - np.log(np.sum(1 / (1 - real)))
        return Vocabulary(pieces, scores.astype(np.float32), kinds)


class Trie:
    """Double array: the child of state s by byte c is base[s] + c, if check there is s."""

    def __init__(self, entries: dict[bytes, int]):
        root: dict = {}
        for word, value in entries.items():
            node = root
            for byte in word:
                node = node.setdefault(byte, {})
            node[-1] = value
        self.depth = max((len(w) for w in entries), default=0)
        base, check, value = ([-1] * 512 for _ in range(3))
        check[0], free, end, todo = 0, 1, 1, [(0, root)]
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            following = sorted(k for k in node if k >= 0)
            base[state] = 0
            if not following:
                continue
            # The first place from the first free cell on that fits, or the end after some tries.
            cell, tries = free, 0
            while True:
                at = cell - following[0]
                if at > 0 and all(check[at + k] < 0 for k in following):
                    break
                tries += 1
                cell = cell + 1 if tries < 64 else max(end, following[0] + 1)
            for k in following:
                check[at + k] = state
                todo.append((at + k, node[k]))
            base[state], end = at, max(end, at + following[-1] + 1)
            while check[free] >= 0:
                free += 1
            more = end + 768 - len(check)
            if more > 0:
                for array in (base, check, value):
                    array.extend([-1] * (more + len(array) // 2))
        self.base, self.check, self.value = (np.array(a, np.int32) for a in (base, check, value))

    def matches(self, data: np.ndarray, begin: np.ndarray, limit: np.ndarray):
        """For lengths 1, 2, ...: which of the positions `begin` match a piece, and its id.

        `limit` is where the text of each position ends.
        """
        rows, state = np.arange(len(begin)), np.zeros(len(begin), np.int32)
        for length in range(1, self.depth + 1):
            ok = begin[rows] + length <= limit[rows]
            rows, state = rows[ok], state[ok]
            if not len(rows):
                return
            after = self.base[state] + data[begin[rows] + length - 1]
            ok = self.check[after] == state
            rows, state = rows[ok], after[ok]
            found = self.value[state]
            hit = found >= 0
            yield length, rows[hit], found[hit]


class Coder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        entries = {p: i for i, p in reversed(list(enumerate(vocabulary.pieces))) if vocabulary.kinds[i] == 0 and p}
        self.trie = Trie(entries)
        self.by_word = not any(b" " in p.lstrip(b" ") for p in entries)
        self.unknown = np.float32(vocabulary.scores[vocabulary.kinds == 0].min(initial=0) - PENALTY)
        self.bytes = np.full(256, -1, np.int32)
        for i, piece in enumerate(vocabulary.pieces):
            if vocabulary.kinds[i] == 1:
                self.bytes[piece[0]] = i
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary lacks byte pieces")
        self.sizes = np.array([len(p) for p in vocabulary.pieces])
        self.flat = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        self.first = np.cumsum(self.sizes) - self.sizes

    def words(self, data: np.ndarray, starts: np.ndarray):
        """Pieces of several words: ids, where each word's begin, and each word's score."""
        sizes = np.diff(starts)
        order = np.argsort(sizes > TOGETHER, kind="stable")
        parts = [self._together(data, starts, order[: int((sizes <= TOGETHER).sum())])]
        parts += [self._alone(data, starts, int(w)) for w in order[int((sizes <= TOGETHER).sum()) :]]
        word, at, ids, size = (np.concatenate(x) for x in zip(*[p[:4] for p in parts]))
        scores = np.zeros(len(sizes), np.float64)
        for of, value in (p[4] for p in parts):
            scores[of] = value
        back = np.argsort(at, kind="stable")
        word, at, ids, size = word[back], at[back], ids[back], size[back]
        # Characters without a piece become their bytes.
        many = np.where(ids < 0, size, 1)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out = np.repeat(ids, many)
        lost = out < 0
        out[lost] = self.bytes[data[(np.repeat(at, many) + step)[lost]]]
        return out, np.searchsorted(np.repeat(word, many), np.arange(len(sizes) + 1)), scores

    def _edges(self, data, begin, limit):
        """Pieces by length, and single characters that have none."""
        single = np.ones(len(begin), bool)
        width = np.where(data[begin] < 0x80, 1, np.where(data[begin] < 0xE0, 2, np.where(data[begin] < 0xF0, 3, 4)))
        width = np.minimum(width, limit - begin)
        found = []
        for length, rows, ids in self.trie.matches(data, begin, limit):
            single[rows[width[rows] == length]] = False
            found.append((length, rows, ids))
        for length in (1, 2, 3, 4):
            rows = np.flatnonzero(single & (width == length))
            if len(rows):
                found.append((length, rows, np.full(len(rows), -1, np.int32)))
        return found

    def _score(self, ids):
        return np.where(ids < 0, self.unknown, self.vocabulary.scores[ids])

    def _together(self, data, starts, which):
        sizes = np.diff(starts)[which]
        total = int(sizes.sum())
        # Positions by how far into their word they lie, so that a step is a slice.
        word = np.repeat(which, sizes)
        local = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = starts[word] + local
        lead = (data[place] & 0xC0) != 0x80
        word, local, place = word[lead], local[lead], place[lead]
        order = np.argsort(local.astype(np.uint8), kind="stable")
        word, local, place = word[order], local[order], place[order]
        edges = self._edges(data, place, starts[word + 1])
        steps = np.arange(int(sizes.max(initial=0)) + 1)
        cuts = [np.searchsorted(local[rows], steps) for _, rows, _ in edges]
        # A node per position and one per word's end: byte positions shifted by the word.
        node = place + word
        best = np.full(len(data) + len(starts), -np.inf, np.float32)
        came, piece = np.zeros(len(best), np.int64), np.zeros(len(best), np.int32)
        best[starts[which] + which] = 0
        ready = [(length, node[rows], ids, self._score(ids)) for length, rows, ids in edges]
        for i in steps[:-1]:
            for (length, source, ids, score), cut in zip(ready, cuts):
                a, b = cut[i], cut[i + 1]
                if a == b:
                    continue
                origin = source[a:b]
                value = best[origin] + score[a:b]
                better = value > best[origin + length]
                target = (origin + length)[better]
                best[target], came[target], piece[target] = value[better], origin[better], ids[a:b][better]
        out = []
        at, of = starts[which + 1] + which, which
        ends = best[at].astype(np.float64)
        while len(at):
            more = at > starts[of] + of
            at, of = at[more], of[more]
            out.append((of, came[at] - of, piece[at], at - came[at]))
            at = came[at]
        if not out:
            out = [tuple(np.zeros(0, np.int64) for _ in range(4))]
        return (*(np.concatenate(x) for x in zip(*out)), (which, ends))

    def _alone(self, data, starts, which):
        a, b = int(starts[which]), int(starts[which + 1])
        begin = np.arange(a, b)
        begin = begin[(data[a:b] & 0xC0) != 0x80]
        edges = self._edges(data, begin, np.full(len(begin), b))
        rows, length, ids = (np.concatenate(x) for x in zip(*[(r, np.full(len(r), n), i) for n, r, i in edges]))
        order = np.argsort(rows, kind="stable")
        score = self._score(ids)[order]
        source, length, ids = (begin[rows] - a)[order].tolist(), length[order].tolist(), ids[order].tolist()
        best = np.full(b - a + 1, -np.inf, np.float32)
        best[0] = 0
        came = [None] * (b - a + 1)
        for at, n, i, s in zip(source, length, ids, score):
            value = best[at] + s
            if value > best[at + n]:
                best[at + n], came[at + n] = value, (at, i)
        path, at = [], b - a
        while at > 0:
            before, i = came[at]
            path.append((before + a, i, at - before))
            at = before
        place, ids, size = (np.array(x) for x in zip(*path[::-1]))
        return np.full(len(place), which), place, ids, size, (np.array([which]), np.array([float(best[-1])]))

    def encode(self, data: np.ndarray, starts: np.ndarray):
        """Ids of all texts after each other, where each text's begin, and each text's score."""
        rows = len(starts) - 1
        full = np.diff(starts) > 0
        # A space before each text that is not empty.
        wide = np.insert(data, starts[:-1][full], 32)
        starts = starts + np.concatenate([[0], np.cumsum(full)])
        if not len(wide):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64), np.zeros(rows)
        head = np.zeros(len(wide), bool)
        if self.by_word:
            space = wide == 32
            head[1:] = space[1:] & ~space[:-1]
        head[starts[:-1][full]] = True
        edge = np.append(np.flatnonzero(head), len(wide))
        words = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(wide)])
        coded = pc.dictionary_encode(words)
        code = coded.indices.to_numpy()
        ids, first, scores = self.words(*common.flat(coded.dictionary))
        count = np.diff(first)[code]
        out = ids[np.repeat(first[:-1][code], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        text = np.searchsorted(edge[:-1], starts)
        total = np.concatenate([[0], np.cumsum(count)])[text]
        score = np.concatenate([[0.0], np.cumsum(scores[code])])
        return out, total, score[text[1:]] - score[text[:-1]]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each begins. Pieces that are not encoded give nothing."""
        size = np.where(self.vocabulary.kinds[ids] == 2, 0, self.sizes[ids])
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.flat[np.repeat(self.first[ids], size) + np.arange(ends[-1]) - np.repeat(ends[:-1], size)]
        at = ends[starts]
        drop = at[:-1][(np.diff(at) > 0)]
        drop = drop[data[drop] == 32]
        gone = np.zeros(len(data) + 1, np.int64)
        gone[drop + 1] = 1
        return np.delete(data, drop), at - np.cumsum(gone)[at]


def _texts(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data.tobytes())])


def _code(coder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.gathered(batches, "text", 1 << 20):
            text = _texts(*common.flat(rows.column("text")))
            ids, starts, scores = coder.value.encode(*common.flat(text))
            back = _texts(*coder.value.decode(ids, starts))
            # A literal marker was read as a space and does not come back.
            same = pc.and_(pc.equal(back, text), pc.invert(rows.column("marked").combine_chunks()))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), lists, pa.array(np.diff(starts)), pa.array(scores), same], names=["doc_id", "ids", "n_ids", "score", "round_trip"])

    return run


def _decode(coder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            if lists.null_count:
                lists = lists.fill_null(pa.scalar([], lists.type))
            ids = lists.flatten().to_numpy()
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            texts = [t.decode("utf-8", "replace") for t in _texts(*coder.value.decode(ids, starts)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encoded(documents: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `ids`, `n_ids`, `score` and `round_trip` of every row.

    `round_trip` tells that decoding the ids gives the text back. A literal whitespace
    marker is read as a space and so does not come back. A null or empty text has no pieces and score 0; a text of any
    length is encoded whole; of equally good chains the one with the longer piece first,
    seen from the end, stands. Repeated rows stay. Other columns are not read. The model
    is read by the driver and broadcast: as large as its vocabulary.
    """
    coder = documents.sparkSession.sparkContext.broadcast(Coder(Vocabulary.load(model)))
    plain = F.translate(common.text_of(text), MARKER, " ")
    rows = common.small_batches(documents).select(F.col(key).cast("long").alias("doc_id"), plain.alias("text"), F.contains(common.text_of(text), F.lit(MARKER)).alias("marked"))
    return rows.mapInArrow(_code(coder), "doc_id long, ids array<int>, n_ids long, score double, round_trip boolean")


def decoded(rows: DataFrame, model: str = MODEL, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`doc_id` and the `text` of a column of ids; null is the empty text, broken UTF-8 is replaced."""
    coder = rows.sparkSession.sparkContext.broadcast(Coder(Vocabulary.load(model)))
    return rows.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(_decode(coder), "doc_id long, text string")

"""Sum-of-squares online packing.

Each document is tokenised and closed with an end id. What exceeds a window is cut off as full
windows; the rest is one piece, placed online: with N(h) the number of open windows filled to level
h, a piece of size s goes to that level (0: a new window) which leaves the sum of N(h)^2 smallest.
Level counts are held in one array. Every task packs the documents of its own partition, so nothing
is shuffled; at its end the few open windows are merged by cutting pieces, and the last one is cut
into windows of power-of-two lengths, which need no padding.

Defined results: a null text counts as empty (only the end id); equal rows are packed one by one; an
empty table gives no rows. State per task: at most MOST_OPEN open windows, each of at most a window's ids.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakespark.llm.common import steps
from quakespark.llm.memo import Memo

WINDOW = 2048
END_ID = 1
MEMO = 200_000
#: Signs that the tokenizer splits from the letters before them, whatever they are; not ' and <, which can begin more.
SIGNS = ".,!?;:#$%&*()[]{}+-=/|@^_~"
#: Open windows of a task; beyond them all are merged by cutting, as at the end. Random sizes keep far fewer open.
MOST_OPEN = 4096
FIELDS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids of texts as bytes. The tokenizer drops white space and splits there, so runs of text without a
    space are encoded apart. It also splits letters from the signs behind them, lower-cases and normalises, so
    of a run of Latin letters, perhaps with signs at its end, the word goes straight to the merge model; all
    other runs go through the whole tokenizer. Ids are kept in memos of bounded size between batches."""

    def __init__(self, tokenizer_file: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # byte-level characters of the model: printable bytes stand for themselves, the rest follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.shown = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}
        self.word, self.signs, self.run = Memo(self._word, memo), Memo(self._whole, memo), Memo(self._run, memo)

    def _whole(self, run: str) -> bytes:
        return array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _run(self, run: str) -> bytes:
        word = run.rstrip(SIGNS)
        if word.isalpha() and (word.isascii() or max(word) <= "\xff"):
            return self.word[word.lower()] + self.signs[run[len(word) :]]
        return self._whole(run)

    def __call__(self, texts: list[str]) -> list[bytes]:
        found = self.run.__getitem__
        return [b"".join(map(found, x.replace("\n", " ").split(" "))) for x in texts]


@functools.lru_cache(2)
def word_encoder(tokenizer_file: str) -> WordEncoder:
    """One for each Python worker and vocabulary."""
    return WordEncoder(tokenizer_file)


class LevelPacker:
    """Pieces are (document key, start, ids as bytes, document tokens); windows come out as lists of them."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.windows = 0

    def level(self, size: int) -> int:
        """The level that a piece of this size goes to; among equals the fullest."""
        last = self.window - size
        here, there = self.count[1 : last + 1], self.count[1 + size : self.window + 1]
        rise = np.where(here > 0, 2 * (there - here) + 2, np.iinfo(np.int64).max)
        if last and here[-1]:  # a full window leaves the sum
            rise[-1] = 1 - 2 * here[-1]
        fresh = 2 * self.count[size] + 1
        if not last or rise.min(initial=np.iinfo(np.int64).max) > fresh:
            return 0
        return last - int(np.argmin(rise[::-1]))

    def add(self, piece: tuple) -> list | None:
        """Places a piece; returns a window that it filled."""
        size = len(piece[2]) // 4
        if size == self.window:
            return [piece]
        at = self.level(size)
        held = [piece]
        if at:
            self.count[at] -= 1
            self.windows -= 1
            held = [*self.open[at].pop(), piece]
        if at + size == self.window:
            return held
        self.count[at + size] += 1
        self.windows += 1
        self.open[at + size].append(held)
        return None

    def rest(self) -> Iterator[list]:
        """The open windows, merged by cutting pieces; the last in windows of power-of-two lengths."""
        pieces = [p for h in sorted(self.open, reverse=True) for w in self.open[h] for p in w]
        total = sum(len(p[2]) // 4 for p in pieces)
        sizes = [self.window] * (total // self.window)
        sizes += [1 << k for k in range(self.window.bit_length() - 1, -1, -1) if (total % self.window) >> k & 1]
        pieces.reverse()
        for size in sizes:
            held, room = [], size
            while room:
                key, start, ids, tokens = pieces.pop()
                if len(ids) // 4 > room:
                    pieces.append((key, start + room, ids[4 * room :], tokens))
                    ids = ids[: 4 * room]
                held.append((key, start, ids, tokens))
                room -= len(ids) // 4
            yield held
        self.open.clear()
        self.count[:], self.windows = 0, 0


def pack(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: the document's id and FIELDS; ``ids`` are little-endian unsigned 32-bit numbers."""
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, packer = word_encoder(tokenizer_file), LevelPacker(window)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        key_type = None

        def emit(held: list) -> None:
            nonlocal number
            offset = 0
            for key, start, ids, tokens in held:
                rows.append((key, start, len(ids) // 4, ids, tokens, number, offset))
                offset += len(ids) // 4
            number += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[doc_id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        for b in batches:
            key_type = b.column(0).type
            texts = (ids for part in steps(b.column(1).to_pylist()) for ids in encoded(part))
            for key, ids in zip(b.column(0).to_pylist(), texts, strict=True):
                ids += end
                tokens = len(ids) // 4
                for start in range(0, tokens, window):
                    if held := packer.add((key, start, ids[4 * start : 4 * (start + window)], tokens)):
                        emit(held)
                if packer.windows > MOST_OPEN:
                    for held in packer.rest():
                        emit(held)
                if len(rows) >= 2000:
                    yield batch()
        for held in packer.rest():
            emit(held)
        if rows:
            yield batch()

    return docs.select(doc_id, text).mapInArrow(packed, f"`{doc_id}` {kind}, {FIELDS}")


def piece_digests(pieces: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return pieces.select(doc_id, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

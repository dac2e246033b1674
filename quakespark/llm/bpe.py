"""Byte-level BPE by monoid tree reduction.

``encode`` halves a piece until the halves are short, encodes those by the merge rule and joins
neighbours upwards. The join re-encodes a window around the seam, which grows until the tokens
outside provably stay: a token sequence is the encoding of its bytes exactly if every two neighbours
t, u are the encoding of the bytes of t + u. (Until the first merge across the seam of t and u both
sides are merged as if alone, so this merge would also happen for the two alone; ranks and the
leftmost rule decide alike in both.) Both halves satisfy this for their own pairs, the window for
its own, so only the two pairs at the window's ends are tested. Decoding concatenates up the tree.

A text is first split by the tokenizer's pattern; each match is a piece. A piece that is itself in
the rank table is one token. A null text counts as empty and has no tokens. Pieces repeat, so each
worker keeps a bounded memo of the encoded words; very long pieces go through the tree once.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quakespark.llm.memo import Memo

LEAF = 6
MEMO = 100_000
#: Ids that are decoded in one step.
DECODE_IDS = 1 << 20
#: A space that doesn't begin a word: before white space or the end.
ODD_SPACE = re.compile(r" (?=\s|$)")


class TreeBPE:
    def __init__(self, rank_file: str, pattern: str, space_begins: bool = False, leaf: int = LEAF, memo: int = MEMO):
        self.space_begins = space_begins
        import regex

        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        sizes = np.array([len(b) for b in self.bytes_of])
        self.flat, self.sizes, self.starts = np.frombuffer(b"".join(self.bytes_of), np.uint8), sizes, np.cumsum(sizes) - sizes
        self.pieces = regex.compile(pattern).findall
        self.leaf = leaf
        self.stays = functools.lru_cache(60_000)(self._stays)
        self.merge = functools.lru_cache(60_000)(self._merge)
        self.after_space = Memo(lambda word: self._ids(" " + word), memo)
        self.at_start = Memo(self._ids, memo // 8)

    def _merge(self, piece: bytes) -> list[int]:
        """The encoding by the merge rule: always the pair of the lowest rank, leftmost first."""
        ranks, none = self.ranks, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return [ranks[x] for x in parts]

    def _stays(self, t: int, u: int) -> bool:
        return self._merge(self.bytes_of[t] + self.bytes_of[u]) == [t, u]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not left or not right:
            return left + right
        if self.stays(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            seam = b"".join(map(self.bytes_of.__getitem__, left[len(left) - i :] + right[:j]))
            window = self.merge(seam) if len(seam) <= 4 * self.leaf else self._merge(seam)
            low = i == len(left) or self.stays(left[len(left) - i - 1], window[0])
            high = j == len(right) or self.stays(window[-1], right[j])
            if low and high:
                return left[: len(left) - i] + window + right[j:]
            i = i if low else min(2 * i, len(left))
            j = j if high else min(2 * j, len(right))

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf:
            return self.merge(piece)
        half = self.leaf << ((len(piece) - 1) // self.leaf).bit_length() - 1
        left, right = piece[:half], piece[half:]
        first = self.tree(left)
        return self.join(first, first if left == right else self.tree(right))

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return self.tree(piece) if whole is None else [whole]

    def _ids(self, part: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces(part):
            ids += self.encode_piece(piece.encode())
        return array("i", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers.

        Where every space is followed by a word and the pattern begins a piece at such a space, as ``space_begins``
        states of it, the parts between can be encoded apart.
        """
        if not self.space_begins or " " not in text or ODD_SPACE.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        return self.at_start[first] + b"".join(map(self.after_space.__getitem__, rest))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, one after another, and the number of bytes of each id."""
        sizes = self.sizes[ids]
        from_start = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[from_start + np.arange(len(from_start))], sizes


    def encode_texts(self, texts: pa.Array) -> pa.Array:
        parts = [self.encode(x.as_py() or "") for x in texts]
        ends = np.cumsum([0, *(len(x) // 4 for x in parts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))

    def decode_arrays(self, arrays: pa.Array) -> pa.Array:
        offsets = arrays.offsets.to_numpy()
        ids = arrays.values.to_numpy()[offsets[0] : offsets[-1]]
        out = []
        i = 0
        while i < len(arrays):  # about DECODE_IDS at a time bound the index arrays
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + DECODE_IDS, side="right")) - 1)
            data, sizes = self.decode(ids[offsets[i] - offsets[0] : offsets[j] - offsets[0]])
            ends = np.r_[0, np.cumsum(sizes)][offsets[i : j + 1] - offsets[i]].astype(np.int32)
            out.append(pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]))
            i = j
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())


@functools.lru_cache(4)
def tokenizer(rank_file: str, pattern: str, space_begins: bool = False) -> TreeBPE:
    """One for each Python worker and vocabulary."""
    return TreeBPE(rank_file, pattern, space_begins)


def encode(text: Column, rank_file: str, pattern: str, space_begins: bool = False) -> Column:
    """The ids of each text, ``array<int>``."""

    @arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        return tokenizer(rank_file, pattern, space_begins).encode_texts(texts)

    return encoded.asNondeterministic()(text)


def decode(ids: Column, rank_file: str, pattern: str, space_begins: bool = False) -> Column:
    """The bytes of each array of ids, ``binary``; a null array counts as empty."""

    @arrow_udf("binary")
    def decoded(arrays: pa.Array) -> pa.Array:
        return tokenizer(rank_file, pattern, space_begins).decode_arrays(arrays.fill_null([]))

    return decoded(ids)


def round_trip(text: Column, rank_file: str, pattern: str, space_begins: bool = False) -> Column:
    """struct<ids:array<int>, decoded:binary>: the ids of each text and what they decode to, in one pass through Python."""

    @arrow_udf("ids array<int>, decoded binary")
    def both(texts: pa.Array) -> pa.Array:
        bpe = tokenizer(rank_file, pattern, space_begins)
        ids = bpe.encode_texts(texts)
        return pa.StructArray.from_arrays([ids, bpe.decode_arrays(ids)], ["ids", "decoded"])

    return both.asNondeterministic()(text)


def token_digests(docs: DataFrame, rank_file: str, pattern: str, space_begins: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the number of tokens, and the digests of the ids and of the decoded bytes."""
    made = docs.select(F.col(doc_id), round_trip(F.col(text), rank_file, pattern, space_begins).alias("__made"))
    return made.select(
        doc_id,
        F.size("__made.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("__made.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("__made.decoded", 256).alias("decoded_sha256"),
    )

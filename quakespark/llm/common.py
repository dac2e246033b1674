"""Small helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one vectorised step takes at most, unless a single text is longer.
STEP_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_words(text: str) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    for c in "\n\t\r\x0b\x0c":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def steps(texts: Iterable[str | None], most: int = STEP_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters, an empty text counting as one; null becomes the empty text."""
    held, chars = [], 0
    for x in texts:
        x = "" if x is None else x
        size = max(len(x), 1)
        if held and chars + size > most:
            yield held
            held, chars = [], 0
        held.append(x)
        chars += size
    if held:
        yield held


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts: their codes, the distinct words by code, and the number of words of each text."""
    tokens: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, x in enumerate(texts):
        own = ascii_words(x)
        counts[i] = len(own)
        tokens += own
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, object), counts
    array = np.empty(len(tokens), object)
    array[:] = tokens
    codes, distinct = pd.factorize(array)
    return codes.astype(np.int64), distinct, counts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a column expression that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column], first: Column, block: int = 256) -> Column:
    """For each element, ``step`` folded over the elements before it, from ``first``; ``step`` must be associative.

    Folded block by block, so that the work stays near linear in the array.
    """
    fold = lambda x: F.aggregate(x, first, step)
    before = lambda x, n: F.slice(x, F.lit(1), n)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    within = lambda x, base: F.transform(x, lambda _, i: step(base, fold(before(x, i))))
    run = lambda whole: bound(
        F.transform(whole, fold), lambda totals: F.flatten(F.transform(whole, lambda x, b: bound(fold(before(totals, b)), lambda base: within(x, base))))
    )
    return F.when(F.size(values) > 0, bound(blocks, run)).otherwise(F.array().cast("array<int>"))

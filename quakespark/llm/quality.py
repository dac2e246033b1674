"""Quality rules by suffix-array repetition.

The words of a text form a sequence. Its suffix array and the longest common prefixes (LCP) of
neighbouring suffixes give the maximal repeated substrings: the deepest LCP interval that holds the
suffix at position i has the length max(LCP to the suffix before, LCP to the suffix after), and every
shallower interval marks a part of the same span. The union of the spans [i, i + length) over all
positions is thus the union over all LCP intervals. Texts whose repeats cover too large a share of
their words, or whose longest repeat is too long, are rejected.

The arrays are built for many texts at once: each text's words get codes of their own, so that no
common prefix crosses texts. Prefix doubling sorts only suffixes that are not yet unique.

Defined results: a null text counts as empty; an empty text has zeros everywhere and fails the base
rule (fewer than 50 words); equal rows get equal results; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quakespark.llm.common import steps, word_codes
from quakespark.session import free_name

MIN_WORDS = 50
MIN_REPEAT = 5
MAX_COVERED = 0.4
MAX_LONGEST = 100
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, covered_fraction double, longest_repeat long"
)


def repeat_lengths(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring that starts there and occurs again in the same text.

    codes: of all words, text after text; counts: the number of words of each text.
    """
    n = len(codes)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    text = np.repeat(np.arange(len(counts)), counts)
    key = text * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]]
    starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int32)
    rank[order] = starts
    levels, width = [rank], 1
    while True:
        # groups of suffixes with equal first `width` words; `order` holds each group together
        held = levels[-1]
        sorted_rank = held[order]
        same = np.r_[False, sorted_rank[1:] == sorted_rank[:-1]]
        open_at = np.flatnonzero(same | np.r_[same[1:], False])
        if not len(open_at):
            break
        at = order[open_at]
        after = at + width
        inside = after < n
        inside[inside] = text[after[inside]] == text[at[inside]]
        second = np.zeros(len(at), np.int64)
        second[inside] = held[after[inside]].astype(np.int64) + 1
        pair = held[at].astype(np.int64) * (n + 1) + second
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[open_at] = at
        new_group = np.r_[True, pair[1:] != pair[:-1]]
        new_rank = held.copy()
        new_rank[at] = np.maximum.accumulate(np.where(new_group, open_at, 0)).astype(np.int32)
        levels.append(new_rank)
        width *= 2
    left, right = order[:-1], order[1:]
    near = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b = left[near].copy(), right[near].copy()
    lcp = np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        held = levels[level]
        ok = np.flatnonzero((a < n) & (b < n))
        equal = ok[held[a[ok]] == held[b[ok]]]
        lcp[equal] += 1 << level
        a[equal] += 1 << level
        b[equal] += 1 << level
    np.maximum.at(longest, left[near], lcp)
    np.maximum.at(longest, right[near], lcp)
    return longest


def covered_words(lengths: np.ndarray, least: int, span: int | None = None) -> np.ndarray:
    """Whether each word lies in the span of a repeat of ``least`` words or more; ``span`` replaces its length."""
    edge = np.zeros(len(lengths) + 1, np.int64)
    at = np.flatnonzero(lengths >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + (lengths[at] if span is None else span), -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str], min_repeat: int, max_covered: float, max_longest: int) -> pd.DataFrame:
    codes, _, counts = word_codes(texts)
    lengths = repeat_lengths(codes, counts)
    text = np.repeat(np.arange(len(texts)), counts)
    per_text = lambda mask: np.bincount(text[mask], minlength=len(texts)).astype(np.int64)
    repeated = per_text(covered_words(lengths, 3, 3))
    covered = per_text(covered_words(lengths, min_repeat))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, text, lengths)
    out = pd.DataFrame({"n_words": counts})
    out["word_chars"] = [len(x) - sum(map(x.count, " \t\n\x0b\x0c\r")) for x in texts]
    out["n_symbols"] = [sum(map(x.count, "#*$%&|<>")) for x in texts]
    dup = []
    for x in texts:
        seen: set[str] = set()
        again = 0
        for line in x.split("\n"):
            if line in seen:
                again += 1
            elif line.strip(" \t\n\x0b\x0c\r"):
                seen.add(line)
        dup.append(again)
    out["n_dup_lines"] = dup
    out["n_repeat_words"] = repeated
    out["base_failed"] = (counts < MIN_WORDS) | (100 * repeated > 50 * counts)
    out["covered_fraction"] = covered / np.maximum(counts, 1)
    out["longest_repeat"] = longest
    out["kept"] = ~out["base_failed"] & (out["covered_fraction"] <= max_covered) & (longest <= max_longest)
    return out[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_fraction", "longest_repeat"]]


def repetition(text: Column, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> Column:
    """A struct of FIELDS for each text; batches go through in steps of bounded size."""

    @pandas_udf(FIELDS)
    def scored(batch: pd.Series) -> pd.DataFrame:
        parts = [measure(x, min_repeat, max_covered, max_longest) for x in steps(batch)]
        return pd.concat(parts, ignore_index=True) if parts else measure([], min_repeat, max_covered, max_longest)

    return scored.asNondeterministic()(text)  # so that a filter on the result doesn't run it twice


def repetition_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row per document: its id and FIELDS."""
    return docs.select(F.col(doc_id), repetition(F.col(text), **limits).alias("__rule")).select(doc_id, "__rule.*")


def keep_quality(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs``, with their columns, whose text the rules keep."""
    rule = free_name("__rule", docs)
    return docs.withColumn(rule, repetition(F.col(text), **limits)).where(F.col(rule)["kept"]).drop(rule)

"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words (lower-cased, without punctuation at their ends) are inputs at two levels: a hashed word
embedding, and hashed character n-grams of the word, averaged. Both come with smoothed log-odds of their
labels in the training texts. A forward and a backward GRU read every window of WINDOW words; windows
start every STRIDE words and the last ends with the text, so all overlap and every word is read. Attention
pools the states of a window into one logit; a text scores as its most toxic window.

Labels say that a text is toxic, not where. So training repeats: the window of each toxic text that now
scores highest is a positive example; of each clean one, its highest and some random windows are negative
examples. The bias is set at the end so that 0.5 separates the training texts best.

The fit uses at most TRAIN_ROWS labelled texts of each class, whole, those of the smallest hashed ids among the ids that
have a text; of rows that share an id, one. Ids choose rows but are never inputs. Scoring reads whole texts.

Defined results: texts without words, null ones too, score 0; equal texts score alike; without labelled
texts of both classes every text scores 0; columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quakespark.llm.common import mix64, steps, word_codes
from quakespark.session import free_name

WINDOW, STRIDE = 32, 16
HIDDEN = 8
WORD_SLOTS, GRAM_SLOTS = 1 << 16, 1 << 16
WORD_DIM, GRAM_DIM = 4, 4
GRAMS = (3, 5)
INPUTS = WORD_DIM + GRAM_DIM + 3
TRAIN_ROWS = 1000
ROUNDS = 12
SEED = 3
ENDS = ".,;:!?#*$%&|<>\"'()[]{}=+-_/\\"


@dataclass
class Vocabulary:
    """What the distinct words of some texts are as inputs: their word slots, and their n-gram slots word after word."""

    words: np.ndarray
    grams: np.ndarray
    starts: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.words)), np.diff(np.r_[self.starts, len(self.grams)]))


def vocabulary(words: np.ndarray) -> Vocabulary:
    import xxhash

    tidy = [w.strip(ENDS).lower().encode("utf-8", "replace") for w in words]
    slots = np.fromiter((xxhash.xxh3_64_intdigest(w) & (WORD_SLOTS - 1) for w in tidy), np.int64, len(tidy))
    sizes = np.fromiter((len(w) + 2 for w in tidy), np.int64, len(tidy))
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in tidy), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(tidy)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(data))
    found, of = [], []
    for n in GRAMS:
        # a word shorter than n is one gram
        at = np.flatnonzero((left >= n) | ((left == sizes[owner]) & (sizes[owner] < n)))
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            inside = left[at] > k
            h[inside] = h[inside] * np.uint64(1_000_003) + data[at[inside] + k] + np.uint64(1)
        found.append((mix64(h) & np.uint64(GRAM_SLOTS - 1)).astype(np.int64))
        of.append(owner[at])
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    counts = np.bincount(of_all, minlength=len(tidy))
    return Vocabulary(slots, np.concatenate(found)[order], np.r_[0, np.cumsum(counts)[:-1]])


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with so many words, one after another: first word, length and text of every window."""
    per = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = (np.cumsum(counts) - counts)[text]
    length = np.minimum(counts[text], WINDOW)
    return begin + np.minimum(nth * STRIDE, counts[text] - length), length, text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The parameters, the forward pass and its gradients. Weights are float32 arrays in ``p``."""

    def __init__(self, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale=0.3: rng.normal(0, scale, shape).astype(np.float32)
        self.word_odds, self.gram_odds = word_odds.astype(np.float32), gram_odds.astype(np.float32)
        self.p = {
            "word": normal(WORD_SLOTS, WORD_DIM, scale=0.05), "gram": normal(GRAM_SLOTS, GRAM_DIM, scale=0.05),
            "in": normal(2, INPUTS, 3 * HIDDEN), "bias": np.zeros((2, 3 * HIDDEN), np.float32), "state": normal(2, HIDDEN, 3 * HIDDEN),
            "attend": normal(2 * HIDDEN), "out": normal(2 * HIDDEN), "shift": np.zeros(1, np.float32),
        }

    def inputs(self, v: Vocabulary) -> np.ndarray:
        n = np.maximum(np.diff(np.r_[v.starts, len(v.grams)]), 1)[:, None].astype(np.float32)
        odds = self.gram_odds[v.grams]
        return np.hstack([
            self.p["word"][v.words], np.add.reduceat(self.p["gram"][v.grams], v.starts) / n, self.word_odds[v.words][:, None],
            np.maximum.reduceat(odds, v.starts)[:, None], np.add.reduceat(odds, v.starts)[:, None] / n,
        ])

    def forward(self, x: np.ndarray, at: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows; x: inputs of distinct words; at: windows x WINDOW codes; length: words in each."""
        p, n, size = self.p, at.shape[0], int(length.max(initial=1))
        states = np.empty((size, n, 2 * HIDDEN), np.float32)
        mask = (np.arange(size)[:, None] < length).astype(np.float32)[:, :, None]
        full = bool((length == size).all())
        kept = []
        for d in (0, 1):
            projected = x @ p["in"][d] + p["bias"][d]
            u = p["state"][d]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(size) if d == 0 else range(size - 1, -1, -1):
                g = projected[at[:, t]]
                s = h @ u
                zr = sigmoid(g[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if not full:
                    new = h + mask[t] * (new - h)
                if keep:
                    kept.append((d, t, h, z, r, c, s[:, 2 * HIDDEN :]))
                h = new
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        score = np.where(mask[:, :, 0] > 0, states @ p["attend"], -1e9)
        score = np.exp(score - score.max(0))
        share = score / score.sum(0)
        pooled = np.einsum("tn,tnh->nh", share, states)
        logit = pooled @ p["out"] + p["shift"][0]
        return (logit, (states, mask, share, pooled, kept)) if keep else logit

    def gradients(self, v: Vocabulary, x: np.ndarray, at: np.ndarray, length: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss of windows with labels y."""
        p = self.p
        logit, (states, mask, share, pooled, kept) = self.forward(x, at, length, keep=True)
        g = {k: np.zeros_like(a) for k, a in p.items()}
        d_logit = ((sigmoid(logit) - y) * w / w.sum()).astype(np.float32)
        g["shift"][0] = d_logit.sum()
        g["out"] = pooled.T @ d_logit
        d_pooled = d_logit[:, None] * p["out"]
        d_share = np.einsum("tnh,nh->tn", states, d_pooled)
        d_score = share * (d_share - (share * d_share).sum(0))
        d_states = share[:, :, None] * d_pooled + d_score[:, :, None] * p["attend"]
        g["attend"] = np.einsum("tn,tnh->h", d_score, states)
        d_x = np.zeros_like(x)
        carried = {0: np.zeros((len(y), HIDDEN), np.float32), 1: np.zeros((len(y), HIDDEN), np.float32)}
        d_projected = [np.zeros((len(x), 3 * HIDDEN), np.float32) for _ in (0, 1)]
        for d, t, h, z, r, c, s in reversed(kept):
            out = carried[d] + d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            new = out * mask[t]
            d_c = new * (1 - z) * (1 - c * c)
            d_z = new * (h - c) * z * (1 - z)
            d_r = d_c * s * r * (1 - r)
            to_state = np.hstack([d_z, d_r, d_c * r])
            np.add.at(d_projected[d], at[:, t], np.hstack([d_z, d_r, d_c]))
            g["state"][d] += h.T @ to_state
            carried[d] = out * (1 - mask[t]) + new * z + to_state @ p["state"][d].T
        for d in (0, 1):
            g["in"][d] = x.T @ d_projected[d]
            g["bias"][d] = d_projected[d].sum(0)
            d_x += d_projected[d] @ p["in"][d].T
        np.add.at(g["word"], v.words, d_x[:, :WORD_DIM])
        n = np.maximum(np.diff(np.r_[v.starts, len(v.grams)]), 1)[:, None]
        np.add.at(g["gram"], v.grams, (d_x[:, WORD_DIM : WORD_DIM + GRAM_DIM] / n)[v.owner])
        return g

    def text_logits(self, texts: list[str]) -> np.ndarray:
        """The highest logit of each text's windows; minus infinity without words."""
        codes, words, counts = word_codes(texts)
        out = np.full(len(texts), -np.inf)
        if len(codes):
            x = self.inputs(vocabulary(words))
            first, length, text = windows(counts)
            for part in np.array_split(np.argsort(-length, kind="stable"), -(-len(first) // 8192)):
                at = codes[np.minimum(first[part][:, None] + np.arange(WINDOW), len(codes) - 1)]
                np.maximum.at(out, text[part], self.forward(x, at, length[part]))
        return out


def log_odds(v: Vocabulary, own: np.ndarray, y: np.ndarray, grams: bool, least: int = 4) -> np.ndarray:
    """Smoothed log-odds of label 1 among texts that hold a slot, over the prior; 0 for slots in few texts.

    own: of each text its distinct words, as text * number of words + word, in ascending order.
    """
    size = GRAM_SLOTS if grams else WORD_SLOTS
    found = np.zeros((2, size), np.int64)
    sizes = np.diff(np.r_[v.starts, len(v.grams)])
    for part in np.split(own, np.searchsorted(own // len(v.words), np.arange(100, len(y), 100))):
        text, word = part // len(v.words), part % len(v.words)
        slot = v.words[word]
        if grams:
            n = sizes[word]
            text, slot = np.repeat(text, n), v.grams[np.repeat(v.starts[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pairs = np.unique(text * size + slot)
        for label in (0, 1):
            found[label] += np.bincount(pairs[y[pairs // size] == label] % size, minlength=size)
    negative, positive = found
    odds = np.log((positive + 0.5) / ((y == 1).sum() + 1)) - np.log((negative + 0.5) / ((y == 0).sum() + 1))
    n = positive + negative
    return np.where(n >= least, np.clip(odds * n / (n + 4), -3, 3), 0)


def train(texts: list[str], y: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> Network | None:
    """A network fitted to whole texts with labels; None without both classes."""
    codes, words, counts = word_codes(texts)
    if not len(codes) or len(set(y[counts > 0])) < 2:
        return None
    v = vocabulary(words)
    of = np.repeat(np.arange(len(texts)), counts)
    own = np.unique(of * len(words) + codes)
    net = Network(log_odds(v, own, y, False), log_odds(v, own, y, True), seed)
    rng = np.random.default_rng(seed)
    first, length, of_window = windows(counts)
    at = codes[np.minimum(first[:, None] + np.arange(WINDOW), len(codes) - 1)]
    real = np.arange(WINDOW) < length[:, None]
    x = net.inputs(v)
    score = np.where(real, (x[:, -2] + x[:, -3])[at], -9).max(1)  # at first by the log-odds alone
    mean, square = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in (0, 1))
    step = 0
    for turn in range(rounds):
        if turn >= 4 and turn % 4 == 0:
            x = net.inputs(v)
            score = np.concatenate([net.forward(x, at[i : i + 8192], length[i : i + 8192]) for i in range(0, len(at), 8192)])
        order = np.lexsort((score, of_window))
        top = order[np.r_[of_window[order][1:] != of_window[order][:-1], True]]
        clean = np.flatnonzero(y[of_window] == 0)
        chosen = np.unique(np.r_[top, rng.choice(clean, min(len(clean), 2 * len(top)), replace=False)])
        rng.shuffle(chosen)
        for part in np.array_split(chosen, max(1, len(chosen) // 512)):
            label = y[of_window[part]].astype(np.float32)
            weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1)).astype(np.float32)
            used, inverse = np.unique(at[part], return_inverse=True)
            sub = vocabulary_part(v, used)
            g = net.gradients(sub, net.inputs(sub), inverse.reshape(at[part].shape), length[part], label, weight)
            step += 1
            for k, a in net.p.items():
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.01 * (g[k] ** 2 - square[k])
                a -= (0.01 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    x = net.inputs(v)
    score = np.concatenate([net.forward(x, at[i : i + 8192], length[i : i + 8192]) for i in range(0, len(at), 8192)])
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, of_window, score)
    has = counts > 0
    net.p["shift"][0] -= threshold(best[has], y[has])
    return net


def vocabulary_part(v: Vocabulary, used: np.ndarray) -> Vocabulary:
    sizes = np.diff(np.r_[v.starts, len(v.grams)])[used]
    starts = np.cumsum(sizes) - sizes
    inner = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    return Vocabulary(v.words[used], v.grams[np.repeat(v.starts[used], sizes) + inner], starts)


def threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The logit that separates the labels with the highest F1, in the middle of its gap."""
    order = np.argsort(-score)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    return float((score[order[k]] + score[order[min(k + 1, len(y) - 1)]]) / 2)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Network | None:
    """A network fitted to the bounded sample; rows held out are never in it.

    The chosen ids are at most ``rows`` of each class, so they are broadcast, and only their texts reach the driver.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    mark = F.xxhash64(F.lit(SEED), "id")
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    present = known.groupBy("id").agg(F.max("y").alias("y")).join(texts.select("id"), "id", "left_semi")
    chosen = present.where("y = 1").orderBy(mark, "id").limit(rows).union(present.where("y = 0").orderBy(mark, "id").limit(rows))
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")).orderBy(mark, "id").collect()
    return train([r["text"] for r in sample], np.array([r["y"] for r in sample], np.int64))


def toxicity(text: Column, spark, net: Network | None) -> Column:
    """The score of each text, 0 to 1."""
    held = spark.sparkContext.broadcast(net)

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if held.value is None:
                yield pd.Series(np.zeros(len(batch)))
                continue
            parts = [np.where(np.isfinite(x), sigmoid(x), 0.0) for x in map(held.value.text_logits, steps(batch))]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return scored.asNondeterministic()(text)


def toxicity_report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    score = toxicity(F.col(text), docs.sparkSession, fit(docs, labels, doc_id, text, **options))
    return docs.select(F.col(doc_id), score.alias("score")).select(
        doc_id, held_out(F.col(doc_id)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_harmless(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with their columns, that score below 0.5."""
    net = fit(docs, labels, doc_id, text, **options)
    score = free_name("__toxic", docs)
    return docs.withColumn(score, toxicity(F.col(text), docs.sparkSession, net)).where(F.col(score) < 0.5).drop(score)

"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words in a row (a shorter text has one, of all its words). Its weight in a text is
its count there times 1 + IDF_STRENGTH * ln(N / df) / ln(N). The document frequencies df come from one
pass over all texts into a table of DF_SLOTS counters of shingle hashes (less the mean load of a
counter, at least 1), whose size doesn't grow with the corpus. The IDF is damped, as in large groups
of copies the shared shingles are frequent and the few changed ones rare, which would pull true copies
below the threshold.

Texts are collapsed to distinct texts first. Each gets a sketch: in each of HASHES slots, the shingle
that improved consistent weighted sampling picks; two texts agree in a slot with a probability of
their weighted Jaccard similarity. BANDS bands of ROWS slots make buckets. Two texts that share a bucket and
agree in LEAST_AGREE of all slots are candidates; a candidate is a link if the exact weighted Jaccard
similarity of the whole texts is THRESHOLD or more. Classes are the connected components of the links.

Links within a class needn't all be verified, so the candidates are taken in two rounds. First, the texts of
a bucket stand in the order of their sketches, and each is compared with the first and the LEADS before it.
Then all candidates between different classes are verified, so that no link between classes is lost. In a bucket
of at most SMALL texts, each text outside its largest class meets every other one. A larger bucket is split by rare
shingles first: with texts x and y of weights |x| <= |y| and similarity t or more, the common weight is at
least 2t / (1 + t) |x| and t |y|; so, with all shingles in one fixed order, rare ones first, their first
common shingle lies within the head of each text beyond which less than that weight is left. Texts
that share no shingle of their heads are thus no link, and are never compared. Texts whose shingles that no other
text of large buckets holds leave too little weight drop out before. What still meets is dealt into cells of two
blocks of about BLOCK texts, and is a candidate only if weights and sketches allow the similarity.

At similarity 0.8 two texts share a bucket with probability 0.9998 and are candidates with 0.998.

Defined results: a null text counts as empty; empty texts are copies of each other and of nothing
else; rows with equal texts share a class, whatever their ids; the class id is the smallest id in the
class (null ids last), and exactly one row of a class is kept, that of the smallest id, text and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakespark.llm.common import mix64, steps, word_codes
from quakespark.operators.graph import connected_components
from quakespark.session import discard, free_name, materialise

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
HASHES = BANDS * ROWS
DF_SLOTS = 1 << 18
IDF_STRENGTH = 0.25
#: Sketches of texts at the threshold agree in fewer slots than this with probability below 0.002.
LEAST_AGREE = 0.6
#: Rows before it that a row of a bucket is compared with in the first round; the second has no such bound.
LEADS = 2
#: Texts of about so many a block are compared with one another in one step of the second round.
BLOCK = 1024
#: Texts of a bucket from which on it is split by rare shingles.
SMALL = 64
#: Counters of the shingles in large buckets, one byte each, and parts in which they are summed.
RARE_SLOTS, RARE_PARTS = 1 << 22, 64
#: Texts in a chunk, and pairs between two chunks from which on they are verified together.
CHUNK, DENSE = 512, 2048
#: Shingles of a head before a shingle that its row names; texts that share an earlier one beyond them meet again.
EARLIER = 32
#: Bins of a profile, in which the weights of a text's shingles are summed.
PROFILE = 256
#: Sums of weights may differ by this in the last places.
SLACK = 1e-6
SEED = 7
#: Bits of a shingle's hash; the rest of 64 number the texts of a step, of which there are at most STEP_CHARS.
HASH_BITS = 44


def word_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its distinct shingles: their text's number, their hash, their count; ordered by text, then hash."""
    codes, words, counts = word_codes(texts)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = word_hashes(words)[codes]
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(texts)), counts)
    full = np.zeros(len(codes), np.uint64)
    n = len(codes)
    left = ends[text] - np.arange(n)  # words from here to the end of the text
    for k in range(SHINGLE):
        inside = left > k
        full[inside] = mix64(full[inside] * np.uint64(0x9E3779B97F4A7C15) + h[np.arange(n)[inside] + k])
    starts = (left >= SHINGLE) | ((counts[text] < SHINGLE) & (left == counts[text]))
    # text and hash in one number, so that one sort brings equal ones together
    key = (text[starts].astype(np.uint64) << np.uint64(HASH_BITS)) | (full[starts] >> np.uint64(64 - HASH_BITS))
    key.sort()
    fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    found = key[fresh]
    return (found >> np.uint64(HASH_BITS)).astype(np.int64), found & np.uint64((1 << HASH_BITS) - 1), np.diff(np.r_[fresh, len(key)])


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(DF_SLOTS - 1)).astype(np.int64)


def weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[slots_of(hashes)]


def idf_table(docs: DataFrame, text: str) -> np.ndarray:
    """The IDF factor for each slot (float32, DF_SLOTS), from one pass over all texts."""
    part = 4096

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DF_SLOTS, np.int64), 0
        for b in batches:
            for texts in steps(b.column(0).to_pylist()):
                n += len(texts)
                df += np.bincount(slots_of(shingles(texts)[1]), minlength=DF_SLOTS)
        used = [i for i in range(0, DF_SLOTS, part) if df[i : i + part].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *used], pa.int64()), pa.array([[n], *(df[i : i + part] for i in used)], pa.list_(pa.int64()))], names=["at", "counts"]
        )

    parts = docs.select(text).mapInArrow(counted, "at long, counts array<bigint>")
    rows = parts.groupBy("at").applyInArrow(_summed, "at long, counts array<bigint>").collect()
    df, n = np.zeros(DF_SLOTS), 1
    for r in rows:
        if r["at"] < 0:
            n = max(r["counts"][0], 1)
        else:
            df[r["at"] : r["at"] + part] = r["counts"]
    df = np.clip(df - df.mean(), 1, n)
    return (1 + IDF_STRENGTH * np.log(n / df) / max(np.log(n), 1)).astype(np.float32)


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    arrays = [row.values.to_numpy() for row in table.column("counts")]
    return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([np.sum(arrays, axis=0)], pa.list_(pa.int64()))})


class Sampler:
    """Improved consistent weighted sampling: for slot k, r and c from Gamma(2, 1) and b uniform, all fixed by
    the shingle and k; t = floor(ln w / r + b); the shingle of least ln c - r (t - b) - r is picked.

    The variates are drawn from tables of 2^16 quantiles by 16 bits each of a hash of shingle and slot.
    """

    def __init__(self, hashes: int = HASHES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = 1 << 16
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.uniform = ((np.arange(size) + 0.5) / size).astype(np.float32)
        self.salts = rng.integers(1, 1 << 62, hashes, dtype=np.uint64)

    def sketch(self, hashes: np.ndarray, w: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of groups of shingles that end at ``ends`` (none empty): the low 32 bits of those picked, groups x slots."""
        out = np.empty((len(ends), len(self.salts)), np.uint32)
        starts = np.r_[0, ends[:-1]]
        log_w = np.log(w).astype(np.float32)
        sizes = ends - starts
        low = hashes.astype(np.uint32)
        for k, salt in enumerate(self.salts):
            h = (hashes ^ salt) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            i = (h >> np.uint64(48)).astype(np.int32)
            r, b = self.r[i], self.uniform[((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32)]
            value = self.log_c[((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int32)] - r * (np.floor(log_w * self.inverse[i] + b) - b + 1)
            least = np.minimum.reduceat(value, starts)
            at = np.flatnonzero(value == np.repeat(least, sizes))
            group = np.searchsorted(ends, at, side="right")
            out[group[::-1], k] = low[at[::-1]]
        return out


def sketches(docs: DataFrame, text: str, idf: np.ndarray) -> DataFrame:
    """``docs`` (of the columns it has) with ``drawn``: the sketch, an array<int> of HASHES slots (empty for texts
    without words), and the mass, the sum of the weights."""
    table = docs.sparkSession.sparkContext.broadcast(idf)

    @F.arrow_udf("struct<sketch:array<int>,mass:double>")
    def sketched(batch: pa.Array) -> pa.Array:
        sampler, parts, lengths, masses = Sampler(), [], [], []
        for texts in steps(batch.to_pylist()):
            own, hashes, counts = shingles(texts)
            n, w = np.bincount(own, minlength=len(texts)), weights(hashes, counts, table.value)
            has = n > 0
            if has.any():
                parts.append(sampler.sketch(hashes, w, np.cumsum(n[has])).view(np.int32).ravel())
            lengths.append(np.where(has, HASHES, 0))
            masses.append(np.bincount(own, w, len(texts)))
        ends = np.r_[0, np.cumsum(np.concatenate(lengths))] if lengths else np.zeros(1, np.int64)
        sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
        return pa.StructArray.from_arrays([sketch, pa.array(np.concatenate(masses) if masses else np.zeros(0))], ["sketch", "mass"])

    return docs.withColumn("drawn", sketched.asNondeterministic()(F.col(text)))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts' (hashes, weights), each ordered by hash without repeats."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum()
    return float(low / (total - low)) if total else 1.0


def verified(pairs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """pairs: a, b, text_a, text_b. Returns (a, b) of those whose similarity is ``threshold`` or more."""
    table = pairs.sparkSession.sparkContext.broadcast(idf)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("text_a"), batch.column("text_b")
            at, keep = 0, []
            while at < batch.num_rows:
                chars, end = 0, at
                while end < batch.num_rows and (end == at or chars < 500_000):
                    chars += len(left[end].as_py()) + len(right[end].as_py())
                    end += 1
                distinct: dict[str, int] = {}
                sides = [[distinct.setdefault(x.as_py(), len(distinct)) for x in side[at:end]] for side in (left, right)]
                own, hashes, counts = shingles(list(distinct))
                w = weights(hashes, counts, table.value)
                cuts = np.searchsorted(own, np.arange(len(distinct) + 1))
                vectors = [(hashes[s:e], w[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                keep += [at + k for k, (i, j) in enumerate(zip(*sides, strict=True)) if weighted_jaccard(vectors[i], vectors[j]) >= threshold]
                at = end
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.mapInArrow(checked, "a string, b string")


def text_key(text: Column) -> Column:
    """A 128-bit key of a text."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _similar(pairs: pa.Table, texts: pa.Table, idf: np.ndarray, threshold: float) -> pa.Table:
    """pairs: a, b; texts: key, text, of every text in them. The pairs of similarity ``threshold`` or more."""
    key = {k: i for i, k in enumerate(texts.column("key").to_pylist())}
    parts = [shingles(step) for step in steps(texts.column("text").to_pylist())]
    hashes, counts = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    sizes, at = np.zeros(len(key), np.int64), 0
    for step, part in zip(steps(texts.column("text").to_pylist()), parts, strict=True):
        sizes[at : at + len(step)] = np.bincount(part[0], minlength=len(step))
        at += len(step)
    w = weights(hashes, counts, idf).astype(np.float64)
    _, code = np.unique(hashes, return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = np.bincount(np.repeat(np.arange(len(key)), sizes), w, len(key))
    a = np.array([key[k] for k in pairs.column("a").to_pylist()], np.int64)
    b = np.array([key[k] for k in pairs.column("b").to_pylist()], np.int64)
    order = np.argsort(a, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(a[order])) + 1, len(a)]
    dense, keep = np.zeros(code.max(initial=-1) + 1), []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        own, others = a[order[low]], b[order[low:high]]
        dense[code[starts[own] : ends[own]]] = w[starts[own] : ends[own]]
        for k, other in enumerate(others):
            span = slice(starts[other], ends[other])
            common = np.minimum(dense[code[span]], w[span]).sum()
            if common >= threshold * (total[own] + total[other] - common):
                keep.append(order[low + k])
        dense[code[starts[own] : ends[own]]] = 0
    return pairs.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _links(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The verified ones of (a, b); texts: key, text, one row for each text that occurs in a pair or more.

    Texts are dealt by their keys into chunks of about CHUNK. Where DENSE pairs or more lie between two chunks,
    each text goes there once for all of them; the other pairs get their texts pair by pair.
    """
    chunks = max(texts.count() // CHUNK, 1)
    cell = [F.pmod(F.xxhash64(c), F.lit(chunks)).alias(f"chunk_{c}") for c in ("a", "b")]
    placed = pairs.select("a", "b", *cell)
    cells = ["chunk_a", "chunk_b"]
    dense = materialise(placed.groupBy(*cells).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= DENSE).select(*cells), "cells")
    few = placed.join(dense, cells, "left_anti").select("a", "b")
    both = (
        few.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    )
    alone = verified(both.select("a", "b", "text_a", "text_b"), idf, threshold)
    many = placed.join(dense, cells, "left_semi")
    needed = many.select(*cells, F.explode(F.array("a", "b")).alias("key")).distinct().join(texts, "key").select(F.col("chunk_a").alias("to_a"), F.col("chunk_b").alias("to_b"), "key", "text")
    table = pairs.sparkSession.sparkContext.broadcast(idf)

    def checked(key: tuple, some: pa.Table, held: pa.Table) -> pa.Table:
        return _similar(some, held, table.value, threshold)

    return alone.union(many.groupBy(*cells).cogroup(needed.groupBy("to_a", "to_b")).applyInArrow(checked, "a string, b string"))


def _neighbours(members: DataFrame, reach: int, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of texts in one bucket whose sketches agree enough.

    members: bucket, key, sketch, mass, component. Rows are range-partitioned and sorted by bucket and sketch, so a
    large bucket spreads over tasks and texts that agree in more slots stand together. Each row is compared
    with the bucket's first row in the task and the ``reach`` rows before it; of each other component that
    passes, the row that agrees best gives the pair.
    """

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, components = None, [], []
        held, masses = np.zeros((0, HASHES), np.int32), np.zeros(0)
        for batch in batches:
            mass = batch.column("mass").to_numpy()
            sketch = batch.column("sketch").flatten().to_numpy().reshape(-1, HASHES)
            left, right = [], []
            for i, (own, key, component) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "component")), strict=True)):
                if own != bucket:
                    bucket, keys, components, held, masses = own, [], [], np.zeros((0, HASHES), np.int32), np.zeros(0)
                agree = (held == sketch[i]).sum(1) * (np.minimum(masses, mass[i]) >= threshold * np.maximum(masses, mass[i]) - SLACK)
                best: dict[str, int] = {}
                for j in np.flatnonzero(agree >= LEAST_AGREE * HASHES):
                    if components[j] != component and (components[j] not in best or agree[j] > agree[best[components[j]]]):
                        best[components[j]] = j
                left += [min(key, keys[j]) for j in best.values()]
                right += [max(key, keys[j]) for j in best.values()]
                drop = 1 if len(keys) > reach else len(keys) + 1  # the first row stays, then the oldest goes
                keys, components = [*keys[:drop], *keys[drop + 1 :], key], [*components[:drop], *components[drop + 1 :], component]
                held, masses = np.vstack([held[:drop], held[drop + 1 :], sketch[i : i + 1]]), np.r_[masses[:drop], masses[drop + 1 :], mass[i]]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["a", "b"])

    dealt = members.select("bucket", "key", "sketch", "mass", "component").repartitionByRange("bucket", "sketch").sortWithinPartitions("bucket", "sketch", "key")
    return dealt.mapInArrow(paired, "a string, b string").distinct()


def _rare_counts(texts: DataFrame) -> np.ndarray:
    """For each of RARE_SLOTS slots of shingle hashes, the texts that hold one of them, at most 255 (uint8)."""
    width = RARE_SLOTS // RARE_PARTS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RARE_SLOTS, np.int32)
        for b in batches:
            for part in steps(b.column(0).to_pylist()):
                np.add.at(counts, _rare_slots(shingles(part)[1]), 1)
        used = np.flatnonzero(counts)
        cuts = np.searchsorted(used, np.arange(0, RARE_SLOTS + 1, width))
        lists = [pa.array([x[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.int32())) for x in (used % width, np.minimum(counts[used], 255))]
        yield pa.RecordBatch.from_arrays([pa.array(range(RARE_PARTS), pa.int32()), *lists], names=["part", "slots", "counts"])

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        slots, counts = (np.concatenate([x.values.to_numpy() for x in table.column(c)]) for c in ("slots", "counts"))
        total = np.minimum(np.bincount(slots, counts, width), 255).astype(np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((RARE_PARTS, width), np.uint8)
    for r in texts.select("text").mapInArrow(counted, "part int, slots array<int>, counts array<int>").groupBy("part").applyInArrow(summed, "part int, total binary").collect():
        out[r["part"]] = np.frombuffer(r["total"], np.uint8)
    return out.ravel()


def _rare_slots(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes) >> np.uint64(64 - RARE_SLOTS.bit_length() + 1)).astype(np.int64)


def _heads(texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(bucket, key, light, earlier): the rare shingles of each text by which it can meet others; texts: key, text.

    ``light`` tells whether the shingle also lies in the shorter head, in which the lighter text of a link has it.
    """
    tables = texts.sparkSession.sparkContext.broadcast((idf, _rare_counts(texts)))
    lighter = 2 * threshold / (1 + threshold)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, rare = tables.value
        for batch in batches:
            at = 0
            for part in steps(batch.column("text").to_pylist()):
                own, hashes, counts = shingles(part)
                w = weights(hashes, counts, idf).astype(np.float64)
                n = rare[_rare_slots(hashes)]
                order = np.lexsort((hashes, n, own))
                own, hashes, w, n = own[order], hashes[order], w[order], n[order]
                total = np.bincount(own, w, len(part))
                shared = np.bincount(own, w * (n > 1), len(part))
                left = total[own] - (np.cumsum(w) - w - (np.cumsum(total) - total)[own])  # weight from here on
                left = np.where(shared[own] >= threshold * total[own] * (1 - SLACK), left, -1)
                # what no other text holds is in no common weight; what is left of the head is shared
                keep = (left >= threshold * total[own] * (1 - SLACK)) & (n > 1)
                light = (left >= lighter * total[own] * (1 - SLACK)) & (shared[own] >= lighter * total[own] * (1 - SLACK))
                own, head = own[keep], hashes[keep].astype(np.int64)
                nth = np.arange(len(own)) - np.searchsorted(own, own)
                size = np.minimum(nth, EARLIER)
                ends = np.cumsum(size)
                before = np.arange(size.sum()) + np.repeat(np.arange(len(own)) - size - (ends - size), size)
                earlier = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(head[before]))
                keys = batch.column("key").take(pa.array(own + at))
                yield pa.RecordBatch.from_arrays([pa.array(head), keys, pa.array(light[keep]), earlier], names=["bucket", "key", "light", "earlier"])
                at += len(part)

    return texts.select("key", "text").mapInArrow(headed, "bucket long, key string, light boolean, earlier array<bigint>")


def _cells(labelled: DataFrame) -> DataFrame:
    """Members of buckets with several classes, dealt into cells (bucket, row block, minor block).

    A minor is a text outside its bucket's largest class. Every member goes to its row block's cells, every
    minor to its minor block's cells besides, so that each minor meets every member of its bucket once.
    """
    classes_in = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.max("light").alias("light")).groupBy("bucket").agg(
        F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), F.max("light").alias("light")
    )
    blocks = classes_in.where("classes > 1 and light").select(
        "bucket", F.col("top.component").alias("top"), F.ceil(F.col("n") / BLOCK).alias("rows"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("minors")
    )
    held = labelled.join(blocks, "bucket")
    own = F.xxhash64("key")
    sides = [
        held.withColumns({"row_block": F.pmod(own, F.col("rows")), "minor": F.lit(False)})
        .withColumn("minor_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1))),
        held.where("component <> top").withColumns({"minor_block": F.pmod(own, F.col("minors")), "minor": F.lit(True)})
        .withColumn("row_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))),
    ]
    return sides[0].select(*CELL, *MEMBER).union(sides[1].select(*CELL, *MEMBER))


CELL = ["bucket", "row_block", "minor_block"]
MEMBER = ["minor", "key", "component", "sketch", "mass", "profile", "light", "earlier"]


def _profiles(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(key, profile): the weights of each text's shingles summed in PROFILE bins, as half-precision numbers."""
    table = texts.sparkSession.sparkContext.broadcast(idf)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in steps(batch.column("text").to_pylist()):
                own, hashes, counts = shingles(part)
                bins = own * PROFILE + (mix64(hashes) % np.uint64(PROFILE)).astype(np.int64)
                sums = np.bincount(bins, weights(hashes, counts, table.value), len(part) * PROFILE).astype(np.float16)
                rows += [x.tobytes() for x in sums.reshape(-1, PROFILE)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, pa.binary())], names=["key", "profile"])

    return texts.select("key", "text").mapInArrow(summed, "key string, profile binary")


def _near_profiles(profile: np.ndarray, mass: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the profiles of texts i and j allow the similarity.

    The weights of two texts differ in sum by at least as much as their profiles, since shingles of one bin can only
    cancel out; a similarity of t leaves (1 - t) / (1 + t) of the weights of both as difference.
    """
    ok = np.zeros(len(i), bool)
    for at in range(0, len(i), 4096):
        a, b = i[at : at + 4096], j[at : at + 4096]
        both = mass[a] + mass[b]
        with np.errstate(invalid="ignore"):  # beyond half precision nothing is known
            apart = np.abs(profile[a].astype(np.float32) - profile[b]).sum(1)
        ok[at : at + 4096] = ~(apart > ((1 - threshold) / (1 + threshold) + 1e-3) * both)
    return ok


def _candidates(table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one cell: the keys of its candidates."""
    import pandas as pd

    minor = table.column("minor").to_numpy()
    if minor.all() or not minor.any():
        return np.zeros(0, object), np.zeros(0, object)
    keys, mass, light = (table.column(c).to_numpy() for c in ("key", "mass", "light"))
    profile = np.frombuffer(b"".join(table.column("profile").to_pylist()), np.float16).reshape(-1, PROFILE)
    component, _ = pd.factorize(table.column("component").to_numpy())
    earlier = table.column("earlier").to_pylist()
    sketch = np.ascontiguousarray(table.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, HASHES).T)
    x, y = np.flatnonzero(minor), np.flatnonzero(~minor)
    others, width, found = sketch[:, y], max(1, (1 << 20) // len(y)), []
    for at in range(0, len(x), width):
        strip = x[at : at + width]
        agree = np.zeros((len(strip), len(y)), np.uint8)
        for k in range(HASHES):
            agree += sketch[k, strip][:, None] == others[k]
        i, j = np.nonzero((agree >= LEAST_AGREE * HASHES) & (component[strip][:, None] != component[y]))
        i, j = strip[i], y[j]
        lighter = np.where(mass[i] <= mass[j], i, j)
        ok = light[lighter] & (mass[lighter] >= threshold * np.maximum(mass[i], mass[j]) - SLACK)
        i, j = i[ok], j[ok]
        ok = _near_profiles(profile, mass, i, j, threshold)
        ok[ok] = ~_met_before(earlier, i[ok], j[ok])
        found.append((keys[i[ok]], keys[j[ok]]))
    left, right = (np.concatenate(side) for side in zip(*found, strict=True))
    swap = left > right
    return np.where(swap, right, left), np.where(swap, left, right)


def _met_before(earlier: list[list[int]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the texts i and j share an earlier bucket."""
    sets = {k: set(earlier[k]) for k in {*i.tolist(), *j.tolist()}}
    return np.fromiter((not sets[a].isdisjoint(sets[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))


def _between(labelled: DataFrame, threshold: float) -> DataFrame:
    """Distinct candidates (a, b), a < b, between different classes of one bucket.

    labelled: bucket, key, component, sketch, mass, profile, light, earlier. Texts that share one of their earlier
    buckets meet there, and are passed over here.
    """

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def compared(table: pa.Table) -> pa.RecordBatch:
            left, right = _candidates(table, threshold)
            return pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["a", "b"])

        for batch in batches:
            fresh = pa.Table.from_batches([batch])
            table = fresh if held is None else pa.concat_tables([held, fresh])
            ids = np.stack([table.column(c).to_numpy() for c in CELL])
            cuts = np.r_[0, np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                yield compared(table.slice(start, end - start))
            held = table.slice(cuts[-1])
        if held is not None:
            yield compared(held)

    dealt = _cells(labelled).repartition(*CELL).sortWithinPartitions(*CELL)
    return dealt.mapInArrow(paired, "a string, b string").distinct()


def _texts_of(plain: DataFrame, distinct: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``keys``, one for each key, with its text."""
    wanted = keys.join(distinct.select("key", F.col("id").alias("least")), "key")
    return (
        plain.select(text_key(F.col("text")).alias("key"), "id", "text").join(wanted, "key").where(F.col("id").eqNullSafe(F.col("least")))
        .dropDuplicates(["key"]).select(*keys.columns, "text")
    )


def _ends(pairs: DataFrame) -> DataFrame:
    """(key) of each text that occurs in a pair, once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, class_key, class_id) for each distinct text of ``docs``; key is text_key of the text."""
    plain = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    idf = idf_table(plain, "text")
    drawn = sketches(plain, "text", idf).select("id", text_key(F.col("text")).alias("key"), "drawn")
    distinct = materialise(drawn.groupBy("key").agg(F.min("id").alias("id"), F.first("drawn").alias("drawn")).select("key", "id", "drawn.*"), "sketches")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.slice("sketch", k * ROWS + 1, ROWS)))
    banded = distinct.where(F.size("sketch") > 0).select("key", bands.alias("bands")).select("key", "bands", F.posexplode("bands").alias("k", "bucket"))
    banded = banded.select("key", "bucket", F.slice("bands", F.lit(1), F.col("k")).alias("earlier"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    drawn_of = distinct.select("key", "sketch", "mass")
    members = materialise(banded.join(shared, "bucket"), "buckets")
    first = materialise(_neighbours(members.join(drawn_of, "key").withColumn("component", F.col("key")), LEADS, threshold), "pairs")
    texts = materialise(_texts_of(plain, distinct, _ends(first)), "texts")
    links = materialise(_links(first, texts, idf, threshold), "links")
    label = connected_components(links, "a", "b")
    discard(texts)

    labelled = members.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    sizes = labelled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    opened = materialise(labelled.join(sizes.select("bucket", (F.col("n") > SMALL).alias("large")), "bucket"), "open")
    discard(members)
    still = opened.groupBy("key").agg(F.first("component").alias("component"), F.max("large").alias("large"))
    held = materialise(_texts_of(plain, distinct, still), "texts")
    known = materialise(_profiles(held, idf).join(drawn_of, "key"), "profiles")
    heads = materialise(_heads(held.where("large"), idf, threshold).join(held.select("key", "component"), "key"), "heads")
    met = heads.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("light").alias("any")).where("low <> high and any")
    fresh = _between(opened.where("not large").withColumn("light", F.lit(True)).join(known, "key"), threshold)
    fresh = fresh.union(_between(heads.join(met.select("bucket"), "bucket").join(known, "key"), threshold)).distinct()
    pairs = materialise(fresh.join(first, ["a", "b"], "left_anti"), "pairs")
    discard(first, opened, known, heads)
    more = materialise(_links(pairs, held.select("key", "text").join(_ends(pairs), "key"), idf, threshold), "links")
    discard(pairs, held)
    whole = distinct.select("key", "id").join(label.withColumnRenamed("node", "key"), "key", "left").select("key", "id", F.coalesce("component", "key").alias("class_key"))
    if not more.isEmpty():  # links between classes that the first links made: only classes are merged
        class_of = lambda side: whole.select(F.col("key").alias(side), F.col("class_key").alias(f"class_{side}"))
        merged = connected_components(more.join(class_of("a"), "a").join(class_of("b"), "b").select("class_a", "class_b").distinct(), "class_a", "class_b")
        whole = whole.join(merged.withColumnRenamed("node", "class_key"), "class_key", "left").select("key", "id", F.coalesce("component", "class_key").alias("class_key"))
    least = whole.groupBy("class_key").agg(F.min("id").alias("class_id"))
    found = materialise(whole.join(least, "class_key").select("key", "class_key", "class_id"), "classes")
    discard(distinct, links, more)
    return found


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: its id, class_id, and whether it is the one of its class that stays.

    Of rows with the class's smallest id, the first in the order of text key and place is kept.
    """
    rows = materialise(docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"), F.monotonically_increasing_id().alias("row")), "rows")
    placed = rows.join(classes(docs, doc_id, text, **options), "key")
    place = F.struct(F.col("id").isNull(), "id", "key", "row")
    first = placed.groupBy("class_key").agg(F.min(place).alias("first"))
    return placed.join(first, "class_key").select(F.col("id").alias(doc_id), "class_id", (F.col("first") == place).alias("kept"))


def near_duplicate_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    return near_duplicates(docs, doc_id, text, **options)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with their columns of whatever names, less all but one of each class of near-duplicates.

    Rows are numbered once, in a table written before the choice, so that each is what it was when it was chosen.
    """
    key, row = free_name("__key", docs), free_name("__row", docs)
    marked = materialise(docs.withColumns({key: text_key(F.col(text)), row: F.monotonically_increasing_id()}), "numbered")
    found = classes(marked, doc_id, text, **options)
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(key).alias("key"), F.col(row).alias("row"))
    first = (
        marked.select(order.alias("first")).groupBy(F.col("first.key").alias("key")).agg(F.min("first").alias("first"))
        .join(found, "key").groupBy("class_key").agg(F.min("first").alias("first")).select("first.key", "first.row")
    )
    return marked.join(first.select(F.col("key").alias(key), F.col("row").alias(row)), [key, row], "left_semi").select(*docs.columns)

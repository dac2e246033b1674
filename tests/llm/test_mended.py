"""Licence scores, shards and runs of one sign against brute force; columns of clashing names; repeated rows."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from quakespark.llm import bpe, licenses, quality, sharding

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_texts():
    rng = random.Random(4)
    filler = "the of this license software free version and may not gnu public file copy source any under is to".split()
    rows = [None, "", "Licensed under the Apache License, version 2.0", "licensed under the gnu general public license", "mozilla public license v 2 0"]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            body = rng.choice(licenses.TEMPLATES)[1].split()
            words += [w for w in body if rng.random() > 0.12] if rng.random() < 0.6 else body
            words += rng.choices(filler, k=rng.randint(0, 6))
        rows.append(" ".join(words).upper() if rng.random() < 0.3 else ", ".join(words))
    return rows + rows[5:9]


def test_license_scores_equal_loops(spark):
    texts = license_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "words long, rare string").withColumnsRenamed({"words": "doc_id", "rare": "text"}).withColumns({"words": F.lit("w"), "__scan": F.lit("kept"), "row": F.lit(1)}).repartition(3)
    split = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) for x in texts]
    df = Counter(w for s in split for w in set(s))
    weight = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 1 for w in licenses.vocabulary()}
    chosen = []
    for _, body, _ in licenses.TEMPLATES:
        words = body.split()
        top = max(weight[w] for w in words)
        rare = sorted((i for i in range(len(words)) if weight[words[i]] >= top / 2), key=lambda i: (-weight[words[i]], i))[: licenses.POSTED]
        chosen.append({i: weight[words[i]] / sum(weight[words[k]] for k in rare) for i in rare})
    posted = {licenses.TEMPLATES[t][1].split()[i] for t, c in enumerate(chosen) for i in c}
    got = {r["doc_id"]: Counter((f["label"], f["score"], f["at"]) for f in r["found"]["found"]) for r in licenses.scan(docs, name="found").select("doc_id", "found").collect()}
    for d, words in enumerate(split):
        own = set(sorted(posted & set(words), key=lambda w: (-weight[w], w))[: licenses.LOOKED_UP])
        want = Counter()
        for (label, body, phrase), parts in zip(licenses.TEMPLATES, chosen, strict=True):
            body, phrase = body.split(), phrase.split()
            key = next(i for i in range(len(body)) if body[i : i + len(phrase)] == phrase)
            for at in range(-len(body), len(words)):
                same = [i for i in parts if 0 <= at + i < len(words) and words[at + i] == body[i]]
                score = sum(parts[i] for i in same)
                if any(body[i] in own for i in same) and score >= licenses.LEAST_SCORE - 1e-12 and at + key >= 0 and words[at + key : at + key + len(phrase)] == phrase:
                    want[label, min(round(score, 6), 1.0), at] += 1
        assert {(a, round(b, 5), c) for a, b, c in got[d]} == {(a, round(b, 5), c) for a, b, c in want}, (d, got[d], want)
    assert sum(map(len, got.values())) > 60
    assert licenses.scan(docs).columns[:5] == ["doc_id", "text", "words", "__scan", "row"]
    equal = {texts[d]: set() for d in range(5, 9)}
    for r in licenses.license_report(docs).collect():
        if texts[r["doc_id"]] in equal:
            equal[texts[r["doc_id"]]].add(tuple(r)[1:])
    assert all(len(v) == 1 for v in equal.values())


def test_shards_equal_loops(spark, tmp_path):
    rng = random.Random(6)
    texts = [None, "", "é" * 50, *(("x" * rng.randint(0, 300)) for _ in range(200)), *["same"] * 30]
    rows = [(i if i % 7 else None, x, "a", 5, 6) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __place string, shard int, bucket int").repartition(4).cache()
    report = sharding.shard_report(docs, bucket_bytes=2000).collect()
    want = Counter((i, len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for i, x, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in report) == want
    assert {(r["law"], r["grown_shard"]) for r in report} == {("rows", None)}
    held = sharding.external_shuffle(docs, bucket_bytes=2000).cache()
    by = defaultdict(list)
    for r in held.collect():
        by[r["bucket"]].append(r)
    marked = docs.select("*", F.xxhash64(F.lit(sharding.SEED), F.monotonically_increasing_id()).alias("mark"))
    marks = defaultdict(list)
    for r in marked.withColumn("b", F.pmod(F.xxhash64("mark"), F.lit(len(by)))).collect():
        marks[r["b"]].append((r["mark"], tuple(r)[:5]))
    n = 0
    for bucket in sorted(by):
        order = np.argsort(np.array([m for m, _ in marks[bucket]]), kind="stable")
        np.random.default_rng([sharding.SEED, bucket]).shuffle(order)
        assert [tuple(r["row"]) for r in sorted(by[bucket], key=lambda r: r["place"])] == [marks[bucket][k][1] for k in order]
        n += len(order)
    dealt = sorted((r["slot"] * 16 + r["shard"] for r in sharding.deal(held).collect()))
    assert dealt == list(range(n)) and n == len(rows)
    name = sharding.write_shards(docs, str(tmp_path / "out"), 4, bucket_bytes=2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "_shard" and Counter(tuple(r)[:5] for r in back.select(*docs.columns).collect()) == Counter(rows)
    assert set(back.columns) == {*docs.columns, name} and max(Counter(r[name] for r in back.collect()).values()) <= len(rows) // 4 + 1
    assert sharding.shard_report(docs.limit(0)).count() == 0


def test_runs_of_one_sign():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    model = bpe.TreeBPE(path, public_tokenizers.PATTERN)
    known = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["a" * n for n in (1, 6, 7, 12, 13, 47, 48, 49, 997, 4096)] + ["ab" * 700 + "a", "=" * 333, "\U0001F600" * 100, "".join(rng.choices("aab", k=3000))]
    for x in texts:
        assert np.frombuffer(model.encode(x), "<i4").tolist() == known.encode(x, disallowed_special=())
    began = time.time()
    model.encode("a" * 200_000)
    assert time.time() - began < 10


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "w x y z. " * 40), (1, "w x y z. " * 40), (2, "w x y z. " * 40)], "doc_id long, text string")
    assert len({tuple(r)[1:] for r in quality.repetition_report(docs).collect()}) == 1
    ids = bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(ids) == 3 and len({tuple(r)[1:] for r in ids}) == 1

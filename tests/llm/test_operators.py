"""The text operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeats."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quakespark.llm import bpe, licenses, neardup, packing, pii, preference, quality, search, sharding, toxicity
from quakespark.llm.common import ascii_words

TEXTS = [
    None, "", " ", "one", "a b c a b c a b c", "Shti " * 80, "x" * 5000, "the gnu general public license, version 3. " * 2,
    "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "cc by cc by mit license mit license",
    "mail a.b@c.de or +44 20 7946 0958 at 10.0.0.255, not 10.0.0.256; card 4111 1111 1111 1111!", "a" * 3000 + "@b.c.d_e@f.g 1.2.3.4.5.6.7.8",
    "x\x1c y \x1f  z　 é日本 \n\n foo  bar\t", "don't 's 'LL \U0001F600" * 20, " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(299)) + " other",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, "src0") for i, x in enumerate(TEXTS)] + [(3, "one", "src1"), (None, "one", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3).cache()


def pairs_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_repetition(docs):
    def longest(w, i):
        n = len(w)
        return max((next((k for k in range(n) if max(i, j) + k >= n or w[i + k] != w[j + k]), n) for j in range(n) if j != i), default=0)

    got = collections.Counter((r["doc_id"], r["n_words"], r["n_repeat_words"], r["longest_repeat"], r["base_failed"]) for r in quality.repetition_report(docs).collect())
    want = collections.Counter()
    for i, x in pairs_of(docs):
        w = ascii_words(x or "")
        assert w == re.findall(r"[^\x20\x09-\x0D]+", x or "")
        windows = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        want[(i, len(w), len(hit), max((longest(w, k) for k in range(len(w))), default=0), len(w) < 50 or 100 * len(hit) > 50 * len(w))] += 1
    assert got == want
    assert quality.keep_quality(docs).columns == docs.columns


def test_license_base(docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in licenses.license_report(docs.where("doc_id is not null")).collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), TEXTS[r["doc_id"]] or "")
        w = word.findall(text)
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x[1] for x in places})))
        assert r["first_word"] == min((x[0] for x in places), default=None) and 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in licenses.license_report(docs).collect()}
    assert labels[8] == "apache,apache-2.0,mit"


def test_shards(docs):
    rows = sharding.shard_report(docs, bucket_bytes=2000).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == docs.count() and all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_preference_edges(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, None, None), (None, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in preference.format_pairs(preference.neighbour_pairs(turns)).collect()}
    assert set(got) == {0, 1} and got[0]["n_common"] == 1 and got[0]["prompt"] == "<|user|>\nhi<|end|>\n"
    start, end = map(int, got[0]["rejected_mask"].split(":"))
    assert got[0]["rejected"][start:end] == "no" and got[1]["rejected"] == ""


def luhn(s):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pii_base(docs):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    for r in pii.pii_report(docs.where("doc_id is not null")).collect():
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, TEXTS[r["doc_id"]] or "") if ok(m.group())]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), r
    assert pii.redact(docs).columns == docs.columns


def test_pii_discovers(spark):
    rows = [(i, f"pay card {4111111111111111}. id" if i % 2 else f"card 900000{i:04d} end") for i in range(10)]
    rows += [(100 + i, f"card +1 (555) 555-{1000 + i} x") for i in range(60)]
    found = pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string"), confidence=0.5).collect()
    assert any("id:" in r["spans"] for r in found)


def id_texts(found, texts):
    """The texts of the discovered spans by row."""
    out = {}
    for r in found.collect():
        ids = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("id:")]
        out[r["doc_id"]] = [texts[r["doc_id"]][a:b] for a, b in ids]
    return out


def test_pii_seeds_without_digits(spark):
    texts = [f"please mailto {'abcdefghijklmnopqrst'[i]}@mail.example.com" for i in range(20)]
    texts += ["please mailto jo_doe", "please mailto jane [at] mail [dot] org", "please mailto q.r7", "this well-known e.g. state-of-the-art 12"]
    got = id_texts(pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), confidence=0.8), texts)
    assert [got[i] for i in range(20, 24)] == [["jo_doe"], ["jane [at] mail [dot] org"], ["q.r7"], []] and not any(got[i] for i in range(20))


def test_pii_lexical_cues(spark):
    texts = [f"nota kunde +1 (0{i}) 555-77{i} ruft an" for i in range(10, 30)]  # the cue is across the phone's own signs
    texts += [f"1{i}.55.66.{i} addressed host" for i in range(10, 30)]  # at the text's start, the cue behind
    texts += ["nota kunde 7788-12 da", "12 90-77 addressed host", "1000 2000 3000 4000 5000", "4000 and 5000", "kunde ohne 5"]
    got = id_texts(pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), confidence=0.8), texts)
    assert [got[i] for i in range(40, 45)] == [["7788-12"], ["12", "90-77"], [], [], []] and not any(got[i] for i in range(40))


def test_pii_patterns(spark):
    text = "12 Uno dos a1 3.4 tres. x@y.de (+1 (017) 555-7713) vier 5 fünf sechs"
    seen = pii.occurrences(spark.createDataFrame([(0, text)], "__row long, t string").select(
        "__row", *(pii.base_spans(F.col("t"), k).alias(f"_{k}") for k in pii.PATTERNS), pii.pieces(F.col("t")).alias("__pieces")
    ).select("__row", "__pieces", *(F.transform(f"_{k}", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["text"]).alias("instance"), pii.kind_of(s["text"]).alias("kind")
    )).alias(f"__{k}") for k in pii.PATTERNS)))
    got = {text[r["start"] : r["end"]]: (r["seed"], [p.split("|", 2)[0] + " " + p.split("|", 2)[2] for p in r["patterns"]]) for r in seen.collect()}
    assert got == {
        "12": (False, ["r1 uno", "r2 uno dos"]), "a1": (False, ["l1 dos", "l2 uno dos", "r1 tres", "r2 tres vier"]), "3.4": (False, ["l1 dos", "l2 uno dos", "r1 tres", "r2 tres vier"]),
        "x@y.de": (True, ["l1 tres", "l2 dos tres", "r1 vier", "r2 vier fünf"]), "+1 (017) 555-7713": (True, ["l1 tres", "l2 dos tres", "r1 vier", "r2 vier fünf"]),
        "5": (False, ["l1 vier", "l2 tres vier", "r1 fünf", "r2 fünf sechs"]),
    }


def test_near_duplicates_brute(spark):
    rng = random.Random(1)
    base = [[f"t{rng.randrange(4000)}" for _ in range(rng.randrange(30, 200))] for _ in range(40)]
    texts = [" ".join(w) for w in base] + [None, "", "short one", "short one"]
    for w in base[:25]:
        for _ in range(3):
            c = list(w)
            for _ in range(rng.randrange(1, 4)):
                c[rng.randrange(len(c))] = "edit"
            texts.append(" ".join(c))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_report(docs).collect()}
    idf = neardup.idf_table(docs, "text")
    own, hashes, counts = neardup.shingles([x or "" for x in texts])
    w = neardup.weights(hashes, counts, idf)
    cut = np.searchsorted(own, np.arange(len(texts) + 1))
    vectors = [(hashes[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or (len(vectors[i][0]) and len(vectors[j][0]) and neardup.weighted_jaccard(vectors[i], vectors[j]) >= 0.8):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert [got[i] for i in range(len(texts))] == label
    assert neardup.keep_one(docs).count() == len(set(label))


def test_toxicity(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(300):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 120))]
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilewort", "nastyterm"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(docs, labels).collect()}
    held = [i for i, _ in marks if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == marks[i][1] for i in held]) > 0.9 and got[1000]["score"] == 0
    assert toxicity.toxicity_report(docs, labels.where("false")).agg({"score": "max"}).first()[0] == 0


def test_search_brute(spark):
    rng = random.Random(3)
    texts = [" ".join(f"v{min(rng.randrange(200), rng.randrange(200))}" for _ in range(rng.randrange(0, 60))) for _ in range(200)] + [None, "solo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tf = [collections.Counter(ascii_words((x or "").lower())) for x in texts]
    mean = sum(map(lambda c: sum(c.values()), tf)) / len(tf)
    df = collections.Counter(w for c in tf for w in c)
    got = collections.defaultdict(list)
    for r in search.search_report(docs, every=20, shard_chars=4000, query_chars=3000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], round(r["score"], 6)))
    for q in range(0, len(texts), 20):
        scored = []
        for i, c in enumerate(tf):
            s = sum(math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in tf[q] if w in c)
            if s > 0:
                scored.append((-round(s, 9), i))
        assert [x[0] for x in got[q]] == [i for _, i in sorted(scored)[:10]]


def shard_of(texts):
    own, h, c, lengths = search.hashed_words(texts)
    order = np.argsort(h, kind="stable")
    words, df = np.unique(h, return_counts=True)
    shard = search.Shard(words, df, own[order].astype(np.int32), c[order], lengths, lengths.mean())
    idf = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
    return shard, {q: h[own == q] for q in range(len(texts))}, idf


def plain_scores(shard, at, idf):
    every = np.zeros(shard.docs)
    for t, w in zip(at, idf, strict=True):
        run = slice(shard.first[t], shard.first[t + 1])
        every[shard.doc[run]] += w * shard.score[run]
    return every


def test_search_pivot(monkeypatch):
    """A shard's answers under any threshold equal those of scoring every document, while only few postings are walked; equal texts score alike."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"v{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 80)) % 4000) for _ in range(900)]
    texts += texts[:40] * 2  # ties
    shard, terms, idf = shard_of(texts)
    walked, skipped = [0, 0], 0
    for step in (1, 16):
        monkeypatch.setattr(search, "STEP", step)
        for q in range(0, len(texts), 9):
            at = np.searchsorted(shard.words, terms[q])
            every = plain_scores(shard, at, idf[at])
            best = np.sort(every)[::-1]
            for least in (0.0, best[9] * (1 - 1e-9), best[3] * (1 - 1e-9), best[0] + 1):
                before = shard.walked
                found, scores = shard.top(terms[q], idf[at], 10, least)
                want = np.flatnonzero((every >= max(least, best[9] * (1 - 1e-9))) & (every > 0))
                assert sorted(found) == list(want) and np.allclose(scores, every[found], rtol=1e-10)
                of = dict(zip(found, scores, strict=True))
                assert all(of[i] == of[j] for i, j in ((d, d + 900) for d in range(40)) if i in of and j in of)
                walked[0] += shard.walked - before
                walked[1] += int(idf[at].size and (shard.first[at + 1] - shard.first[at]).sum())
                skipped += shard.walked == before and len(at) > 0
    assert walked[0] < 0.7 * walked[1] and skipped > 0


def test_search_walks_less_on_the_given_documents():
    """Whole documents as queries, the hardest case: fewer postings than scoring everything, with and without a threshold to begin with."""
    import pyarrow.parquet as pq

    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()[:3000]]
    shard, terms, idf = shard_of(texts)
    for known in (False, True):
        walked = plain = 0
        for q in range(0, len(texts), 100):
            at = np.searchsorted(shard.words, terms[q])
            best = np.sort(plain_scores(shard, at, idf[at]))[::-1]
            before = shard.walked
            shard.top(terms[q], idf[at], 10, best[9] * (1 - 1e-9) if known else 0.0)
            walked, plain = walked + shard.walked - before, plain + int((shard.first[at + 1] - shard.first[at]).sum())
        assert walked < (0.85 if known else 1.0) * plain, (known, walked / plain)


def test_search_reads_rows_of_frequent_words_for_candidates_only():
    """Known thresholds on the given documents: less than 0.55 of the postings are read (0.72 without rows), with the scores of plain scoring."""
    import pyarrow.parquet as pq

    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()[:3000]]
    shard, terms, idf = shard_of(texts)
    walked = plain = 0
    for q in range(0, len(texts), 100):
        at = np.searchsorted(shard.words, terms[q])
        every = plain_scores(shard, at, idf[at])
        least = np.sort(every)[-10] * (1 - 1e-9)
        before = shard.walked
        found, scores = shard.top(terms[q], idf[at], 10, least)
        assert sorted(found) == list(np.flatnonzero((every >= least) & (every > 0))) and np.allclose(scores, every[found], rtol=1e-10)
        walked, plain = walked + shard.walked - before, plain + int((shard.first[at + 1] - shard.first[at]).sum())
    assert walked < 0.55 * plain, walked / plain


def test_search_rows_of_few_long_documents():
    """Where few documents hold very many words, rows stay within a fixed multiple of the postings."""
    shard, terms, idf = shard_of([" ".join(f"v{i * 7 % 5000}" for i in range(k, k + 4000)) for k in range(3)])
    assert shard.rows.size <= search.DENSE * len(shard.doc)
    every = plain_scores(shard, np.searchsorted(shard.words, terms[0]), idf[np.searchsorted(shard.words, terms[0])])
    found, scores = shard.top(terms[0], idf[np.searchsorted(shard.words, terms[0])], 10)
    assert sorted(found) == [0, 1, 2] and np.allclose(scores, every[found], rtol=1e-10)


def test_search_ids_and_ties(spark):
    """Null ids, ids beyond doubles, repeated ids and rows: ties by id, null last, each row an answer of its own."""
    big = 9007199254740993
    rows = [(big, "rare word"), (None, "rare word"), (big, "rare word"), (7, "rare word"), (3, "other"), (None, None), (50, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    queries = spark.createDataFrame([(1, "rare"), (None, "rare word")], "query_id long, text string")
    got = {q: [r["doc_id"] for r in search.search(docs, queries, shard_chars=15, k=4).orderBy("rank").collect() if r["query_id"] == q] for q in (1, None)}
    assert got == {1: [50, 7, big, big], None: [7, big, big, None]}


def test_search_index_rows_are_bounded(spark):
    """A shard's index comes in rows of bounded size, from which its whole lists are put together again."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"v{int(x)}" for x in rng.zipf(1.2, 600) % 5000) for _ in range(400)] + [None, "", "only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "coalesce(text, '') as text", "id + 7 as place").coalesce(1)
    rows = search.indexed(docs, 1).toArrow()
    own, h, c, lengths = search.hashed_words([x or "" for x in texts])
    order = np.argsort(h, kind="stable")
    words, df = np.unique(h, return_counts=True)
    held = [sum(x) for x in rows.column("df").to_pylist()]
    assert len(held) > 1 and sum(held) == len(h) and max(held) <= search.PIECE + df.max()
    (got,) = search.pieced(rows.take(np.arange(len(held))[::-1]))
    ids = np.asarray(got["ids"])
    assert sorted(ids) == list(range(len(texts))) and (np.asarray(got["places"]) == ids + 7).all() and (np.asarray(got["lengths"]) == lengths[ids]).all()
    assert (np.asarray(got["words"]) == words).all() and (np.asarray(got["df"]) == df).all()
    want = list(zip(h, own, c, strict=True))
    assert sorted(zip(np.repeat(words, df), ids[got["doc"]], got["count"], strict=True)) == sorted(want)
    first = np.r_[0, np.cumsum(df)]
    assert all((np.diff(got["doc"][a:b]) > 0).all() for a, b in zip(first[:-1], first[1:], strict=True))


def test_search_lists_as_gaps():
    """Numbers of one, two and four bytes, and lists whose gaps add up to more than 32 bits."""
    for most in (0, 255, 256, 65_535, 65_536, 2**31 - 1):
        x = np.array([0, most, 1], np.int32)
        data = search.narrow(x)
        assert len(data) == 1 + 3 * (1 if most < 256 else 2 if most < 65_536 else 4) and (search.widen(search.pa.scalar(data, search.pa.binary())) == x).all()
    assert len(search.widen(search.pa.scalar(search.narrow(np.zeros(0, np.int32)), search.pa.binary()))) == 0
    doc, df = np.array([5, 2**31 - 1] * 4 + [3], np.int32), np.array([2, 2, 2, 2, 1], np.int32)
    gap = np.diff(doc, prepend=np.int32(0))
    gap[[0, 2, 4, 6, 8]] = doc[[0, 2, 4, 6, 8]]
    assert (search.documents(gap, df) == doc).all()


def test_clashing_names(spark):
    """Columns named like an operator's own pass through every stage that returns the rows of its input."""
    names = ["__row", "__key", "__toxic", "__rule", "__spans", "__doc", "key", "row", "first", "id", "bucket", "component"]
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words + " a@b.de", *range(12)), (2, words, *range(20, 32)), (2, words, *range(40, 52)), (None, None, *[None] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names)).repartition(2)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    want = sorted(map(tuple, docs.select(names).collect()), key=str)
    assert sorted(map(tuple, toxicity.keep_harmless(docs, labels).select(names).collect()), key=str) == want
    assert sorted(map(tuple, pii.redact(docs).select(names).collect()), key=str) == want
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and sorted(r["__row"] for r in kept.select(names).collect()) == [0, 20, 40]
    one = neardup.keep_one(docs)
    assert one.columns == docs.columns and {tuple(r[2:]) for r in one.collect()} <= set(want) and one.where("doc_id is null").count() == 1
    assert one.count() == 2 and pii.redact(docs).where("doc_id = 1").first()["text"].endswith("[email]")


def test_near_duplicates_large_buckets(spark, monkeypatch):
    """Buckets split by rare shingles lose no link between classes: as with buckets compared whole."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):  # copies of one text around the threshold, so that many links are only met in the second round
        c = list(base)
        for _ in range(rng.randrange(0, 6)):
            c[rng.randrange(len(c))] = f"e{rng.randrange(6)}"
        texts.append(" ".join(c))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(neardup, "SMALL", 4)
    split = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicate_report(docs).collect()}
    idf = neardup.idf_table(docs, "text")
    own, hashes, counts = neardup.shingles(texts)
    w = neardup.weights(hashes, counts, idf)
    cut = np.searchsorted(own, np.arange(len(texts) + 1))
    vectors = [(hashes[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if neardup.weighted_jaccard(vectors[i], vectors[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert [split[i] for i in range(len(texts))] == label and len(set(label)) > 5


def test_profiles_bound(spark):
    """A profile never rules out a pair at or above the threshold."""
    rng = random.Random(7)
    texts = [" ".join(f"v{min(rng.randrange(50), rng.randrange(50))}" for _ in range(60)) for _ in range(40)]
    texts += [" ".join(t.split()[: 60 - rng.randrange(4)]) for t in texts]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    idf = np.ones(neardup.DF_SLOTS, np.float32)
    held = {int(r["key"]): np.frombuffer(r["profile"], np.float16) for r in neardup._profiles(docs, idf).collect()}
    own, hashes, counts = neardup.shingles(texts)
    vectors = [(hashes[own == i], counts[own == i].astype(float)) for i in range(len(texts))]
    profile, mass = np.stack([held[i] for i in range(len(texts))]), np.array([v[1].sum() for v in vectors])
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.weighted_jaccard(vectors[i], vectors[j]) >= 0.8]
    assert len(pairs) > 20 and neardup._near_profiles(profile, mass, *map(np.array, zip(*pairs, strict=True)), 0.8).all()


def test_long_texts(spark):
    """Texts of hundreds of thousands of characters take time in proportion to their length."""
    reps = 8000
    docs = spark.createDataFrame([(1, "released under the mit license " * reps), (2, "call 12345 a@b.cd " * reps)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_report(docs).collect()}
    assert got[1]["n_base"] == reps and got[1]["last_word"] == 5 * reps - 2 and got[1]["labels"] == "mit"
    spans = {r["doc_id"]: r for r in pii.pii_report(docs).collect()}
    assert spans[2]["n_email"] == reps and spans[2]["spans"].split(",")[reps - 1] == f"email:{18 * reps - 7}:{18 * reps - 1}"
    assert pii.redact(docs).where("doc_id = 2").first()["text"].count("[email]") == reps


def test_quality_digests(docs):
    """The other columns of the rules, by plain loops."""
    for r in quality.repetition_report(docs.where("doc_id is not null")).collect():
        text = TEXTS[r["doc_id"]] or ""
        w = ascii_words(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if ascii_words(line):
                dup += line in seen
                seen.add(line)
        covered = set()
        for i in range(len(w)):
            for n in range(5, min(len(w) - i, 400) + 1):
                if any(w[j : j + n] == w[i : i + n] for j in range(len(w) - n + 1) if j != i):
                    covered |= set(range(i, i + n))
                else:
                    break
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup)
        assert round(r["covered_fraction"] * len(w)) == len(covered)
        assert r["kept"] == (not r["base_failed"] and len(covered) <= 0.4 * len(w) and r["longest_repeat"] <= 100)


def test_gradients():
    """The backward pass against differences of the loss."""
    rng = np.random.default_rng(8)
    net = toxicity.Network(np.zeros(toxicity.WORD_SLOTS), np.zeros(toxicity.GRAM_SLOTS))
    v = toxicity.vocabulary(np.array(["alpha", "be", "gamma", "delta"], object))
    net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
    at, length = rng.integers(0, 4, (3, 6)), np.array([6, 4, 2])
    y, w = np.array([1.0, 0, 1]), np.array([0.5, 1, 0.25])

    def loss():
        p = toxicity.sigmoid(net.forward(net.inputs(v), at, length))
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())

    g = net.gradients(v, net.inputs(v), at, length, y, w)
    for name in ("in", "bias", "state", "attend", "out", "shift", "word", "gram"):
        flat = net.p[name].reshape(-1)
        for i in np.argsort(-np.abs(g[name].reshape(-1)))[:4]:
            held = flat[i]
            flat[i] = held + 1e-3
            up = loss()
            flat[i] = held - 1e-3
            down = loss()
            flat[i] = held
            assert abs((up - down) / 2e-3 - g[name].reshape(-1)[i]) < 2e-3 * max(1, abs(g[name]).max()), name


def test_bpe_equals_tiktoken(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.token_digests(docs.where("doc_id is not null"), path, public_tokenizers.PATTERN).collect():
        text = TEXTS[r["doc_id"]] or ""
        ids = plain.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    tree = bpe.TreeBPE(path, public_tokenizers.PATTERN, space_begins=True)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("aabeinrst ") for _ in range(rng.randrange(500)))
        assert np.frombuffer(tree.encode(text), "<i4").tolist() == plain.encode_ordinary(text)


def test_packing_round_trip(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), path, window=64).collect()
    whole, fills = collections.defaultdict(dict), collections.defaultdict(list)
    for p in pieces:
        whole[p["doc_id"]][p["start"]] = np.frombuffer(p["ids"], "<u4").tolist()
        fills[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, x in enumerate(TEXTS):
        assert sum((whole[i][s] for s in sorted(whole[i])), []) == [*tokenizer.encode(x or "", add_special_tokens=False).ids, 1]
    for f in fills.values():
        f.sort()
        total = sum(n for _, n in f)
        assert [o for o, _ in f] == [sum(n for _, n in f[:k]) for k in range(len(f))] and total <= 64 and (total == 64 or total & (total - 1) == 0)


def test_level_brute():
    """Every piece goes where the sum of squared level counts ends smallest, among equals to the fullest level."""
    rng = random.Random(5)
    packer, counts, placed = packing.LevelPacker(32), [0] * 33, 0
    for n in range(400):
        size = rng.choice([1, 3, 5, 8, 13, 16, 17, 31, 32, rng.randrange(1, 33)])
        squares = {}
        for level in [0, *(h for h in range(1, 33 - size) if counts[h])]:
            after = list(counts)
            after[level] -= level > 0
            after[level + size] += level + size < 32
            squares[level] = sum(c * c for c in after)
        want = min(squares, key=lambda h: (squares[h], -h)) if size < 32 else 0
        if size < 32:
            assert packer.level(size) == want, (n, size, squares)
        full = packer.add((n, 0, b"abcd" * size, size))
        counts[want] -= want > 0
        counts[want + size] += want + size < 32
        placed += size
        assert packer.count.tolist() == counts and packer.windows == sum(counts) and (full is None) == (want + size < 32)
    assert sum(len(p[2]) // 4 for w in packer.rest() for p in w) == sum(h * c for h, c in enumerate(counts)) and packer.windows == 0


def test_packing_bounds_open_windows(spark, monkeypatch):
    """Pieces over half a window never meet; open windows are then merged by cutting, and nothing is lost."""
    monkeypatch.setattr(packing, "MOST_OPEN", 3)
    rows = [(i, " ".join(["ab"] * 39), "x") for i in range(20)] + [(None, None, None), (5, "a", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack(docs, path, window=64).collect()
    assert sum(p["length"] for p in pieces) == 20 * 40 + 2 * 1 + 2 * 2 and max(p["length"] + p["offset"] for p in pieces) <= 64


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for df in (
        quality.repetition_report(docs), licenses.license_report(docs), sharding.shard_report(docs), neardup.near_duplicate_report(docs), pii.pii_report(docs),
        preference.format_pairs(preference.neighbour_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
        quality.keep_quality(docs), toxicity.keep_harmless(docs, labels), neardup.keep_one(docs), pii.redact(docs),
        toxicity.toxicity_report(docs, labels), search.search_report(docs), bpe.token_digests(docs, byte, public_tokenizers.PATTERN), packing.piece_digests(packing.pack(docs, word)),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == columns and 0 < after.count() <= docs.count(), name
        docs = after


def test_pipeline_planted(spark, tmp_path):
    """Every stage on planted rows: junk, toxic, copied and personal rows change, clean ones stay as they are; all ids are packed."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    clean = [" ".join(f"w{rng.randrange(900)}x" for _ in range(70)) for _ in range(60)]
    rows = list(enumerate(clean))
    rows += [(1000 + i, t + " vilewort nastyterm") for i, t in enumerate(" ".join(f"q{rng.randrange(900)}x" for _ in range(70)) for _ in range(60))]
    rows += [(2000, clean[0]), (2001, clean[0] + " end"), (2002, "junk words " * 60), (2003, None), (2004, "short")]
    rows += [(3000, " ".join(f"z{i}x" for i in range(60)) + " mail jo@mail.example.org today")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(i >= 1000)) for i, _ in rows if i < 1060]
    spark.createDataFrame([(i, 1, t) for i, t in marks], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages, folder = dict(corpus_pipeline.STAGES), f"file://{tmp_path}"
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    good = stages["quality_rules"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert ids(good) == {i for i, _ in rows} - {2002, 2003, 2004}
    harmless = stages["toxicity"](spark, good, folder)
    assert ids(harmless) == set(range(60)) | {2000, 2001, 3000}
    single = stages["near_duplicates"](spark, harmless, folder)
    assert ids(single) == set(range(60)) | {3000}
    cleared = stages["personal_data"](spark, single, folder)
    texts = {r["doc_id"]: r["text"] for r in cleared.collect()}
    assert all(texts[i] == clean[i] for i in range(60)) and texts[3000].endswith(" mail [email] today") and cleared.where("n_chars <> length(text)").count() == 0
    pieces = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"]: r["n"] for r in pieces} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert all(r["n"] == r["all"] for r in pieces)

"""Licence scan by a positional rare-token index.

The words of the licence templates form a small vocabulary. Its document frequencies over the whole
corpus give inverse document frequencies (IDF). Each template posts the places of its words of highest
IDF (at most POSTED, none below half of its highest). In a file, its own LOOKED_UP words of highest IDF that have postings
are looked up; each (template, place in the file minus place in the template) that one of them names is a candidate,
scored by the share of the template's posted IDF whose words stand at their places. A candidate counts if the template's
mandatory key phrase stands at the right place. A text of more than LOOKED_UP different posted words, which no
single template has, may thus lose a template all of whose words are commoner than these. Beside it, base phrases are found wherever their words stand consecutively.

All of it is column expressions; only the frequencies (one row for each vocabulary word) are shuffled
or reach the driver. A null text counts as empty: no words, no labels, score 0. Equal rows get equal
results; columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a text whose A-Z are lower-cased, and the same words in a text as it is.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, text, and the key phrase that must stand in it.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
POSTED = 8
LOOKED_UP = 32
LEAST_SCORE = 0.6


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def vocabulary() -> list[str]:
    return sorted({w for _, body, _ in TEMPLATES for w in body.split()})


def idf(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """IDF of the vocabulary over all documents; its size is that of the vocabulary."""
    known = F.array(*map(F.lit, vocabulary()))
    held = docs.select(F.array_intersect(words_of(F.col(text)), known).alias("w"))
    found = held.select(F.explode(F.array_append("w", F.lit(""))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    df = {r["w"]: r["n"] for r in found.collect()}
    n = df.get("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary()}


def postings(weights: dict[str, float], posted: int = POSTED) -> dict[str, list[tuple[int, int, float]]]:
    """Of each posted word: (template, place, share of the template's posted IDF)."""
    out: dict[str, list[tuple[int, int, float]]] = {}
    for t, (_, body, _) in enumerate(TEMPLATES):
        words = body.split()
        highest = max(weights[w] for w in words)
        rare = sorted((i for i in range(len(words)) if weights[words[i]] >= highest / 2), key=lambda i: (-weights[words[i]], i))[:posted]
        total = sum(weights[words[i]] for i in rare)
        for i in sorted(rare):
            out.setdefault(words[i], []).append((t, i, weights[words[i]] / total))
    return out


def _starts(words: Column, phrase: str) -> Column:
    """Places (from 0) where the words of the phrase stand consecutively."""
    parts = phrase.split()
    first = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    same = lambda i: reduce(and_, (F.get(words, i + k).eqNullSafe(F.lit(w)) for k, w in enumerate(parts)))
    return F.when(F.array_contains(words, parts[-1]) & F.array_contains(words, parts[0]), F.filter(first, same)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, text: str = "text", name: str = "__scan", least_score: float = LEAST_SCORE, looked_up: int = LOOKED_UP) -> DataFrame:
    """``docs`` with a struct column of the given name: n_words, places (array<struct<at,label>>), found (array<struct<label,score,at>>)."""
    weights = idf(docs, text)
    posted = postings(weights)
    by_idf = F.array(*map(F.lit, sorted(posted, key=lambda w: (-weights[w], w))))
    index = F.create_map(*(x for w in sorted(posted) for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i, _ in posted[w])))))
    of_template = [[(w, i, s) for w in sorted(posted) for u, i, s in posted[w] if u == t] for t in range(len(TEMPLATES))]
    parts = F.array(*(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(i).alias("i"), F.lit(s).alias("s")) for w, i, s in own)) for own in of_template))
    keys = F.array(*(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, phrase.split())).alias("words"), F.lit(len(re.split(rf"(?:^|\s){re.escape(phrase)}(?:\s|$)", body)[0].split())).alias("at")) for label, body, phrase in TEMPLATES))
    none = F.array().cast("array<struct<t:int,at:int,s:double>>")
    held = docs.select(F.struct(*docs.columns).alias("row"), words_of(F.col(text)).alias("words"))
    # array_intersect keeps the order of its first array: the file's posted words, those of highest IDF first
    step1 = held.withColumn("rare", F.slice(F.array_intersect(by_idf, "words"), 1, looked_up))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains("rare", h["w"]))
    votes = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["w"]), lambda q: F.struct(q["t"].alias("t"), (h["i"] - q["i"]).alias("at"))))))
    stands = lambda v: lambda total, p: total + F.when(F.get(F.col("words"), F.greatest(v["at"] + p["i"], F.lit(0))).eqNullSafe(p["w"]) & (v["at"] + p["i"] >= 0), p["s"]).otherwise(0.0)
    scored = F.transform(votes, lambda v: F.struct(v["t"].alias("t"), v["at"].alias("at"), F.aggregate(F.get(parts, v["t"]), F.lit(0.0), stands(v)).alias("s")))
    step2 = step1.withColumn("runs", F.when(F.size("rare") > 0, F.array_sort(F.filter(scored, lambda r: r["s"] >= least_score))).otherwise(none))
    key = lambda r: F.element_at(keys, r["t"] + 1)
    at = lambda r: r["at"] + key(r)["at"]
    verified = F.filter("runs", lambda r: (at(r) >= 0) & F.forall(F.transform(key(r)["words"], lambda w, k: F.get(F.col("words"), at(r) + k).eqNullSafe(w)), lambda same: same))
    marked = lambda label: lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))
    places = F.array_sort(F.concat(*(F.transform(_starts(F.col("words"), phrase), marked(label)) for phrase, label in BASE.items())))
    return step2.select("row", F.struct(
        F.size("words").cast("long").alias("n_words"),
        places.alias("places"),
        F.transform(verified, lambda r: F.struct(key(r)["label"].alias("label"), F.least(F.round(r["s"], 6), F.lit(1.0)).alias("score"), r["at"].alias("at"))).alias("found"),
    ).alias("scan")).select("row.*", F.col("scan").alias(name))


def license_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    places, found = F.col("__scan.places"), F.col("__scan.found")
    base = F.array_distinct(F.transform(places, lambda p: p["label"]))
    every = F.array_union(base, F.transform(found, lambda f: f["label"]))
    return scan(docs.select(doc_id, text), text, **options).select(
        doc_id,
        F.col("__scan.n_words").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform(places, lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform(found, lambda f: f["score"])), F.lit(0.0)), F.when(F.size(places) > 0, 0.5).otherwise(0.0)).alias("score"),
    )

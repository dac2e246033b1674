"""Personal data by patterns and bootstrapped contextual extraction.

Base kinds are found by regular expressions and checked (Luhn's rule, digit counts, parts of an
address). They are the seeds: each base span is one occurrence of its whole text, whatever its digits.
Every other token that isn't letters only (a digit, or an inner sign such as @, a dot or _) is an
occurrence too. An occurrence's patterns are the nearest word and the nearest two words before and after it
(across other occurrences, at any distance), each with the kind of the instance (digits and signs, or
with letters); letters-only tokens can't be found, since no seed has their kind. Where no word is, there
is no pattern. Spark scores the bipartite graph of patterns and instances in
rounds: a pattern's confidence is the mean score of what it surrounds, smoothed; an instance that is no
seed scores as the noisy-or of its trusted patterns. At the end, patterns of high confidence and support
mark the tokens that they surround as further identifiers (kind "id"), wherever those aren't part of a
base span.

Everything is column expressions, windows over the tokens of a text, joins and aggregations, linear in
the tokens. Pattern and instance counts are summed before they are joined, so a frequent word is one row
for each instance. A null text counts as empty (no spans); equal rows get equal spans; an empty table
gives an empty result; the row key is made here, so ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.llm.common import bound, running
from quakespark.session import discard, free_name, materialise

#: The base kinds in their order, as regular expressions. What can't change a match keeps them
#: linear on long runs: possessive loops, and starts only at the beginning of a run or after the last match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
#: An email, or letters and digits with signs between them (@, dots, "[at]"), but not letters only. Every digit is in one.
JOIN = r"(?:[._%+@-]++| ?+[\[({] ?+(?:at|dot) ?+[\])}] ?+)"
TOKEN = rf"{PATTERNS['email']}|(?<![\p{{L}}\p{{N}}])(?!\p{{L}}++(?!\p{{N}}|{JOIN}[\p{{L}}\p{{N}}]))[\p{{L}}\p{{N}}]++(?:{JOIN}[\p{{L}}\p{{N}}]++)*+"
ROUNDS = 3
CONFIDENCE = 0.9
SUPPORT = 5
SMOOTHING = 1.0
SPAN = "array<struct<start:int,end:int,text:string>>"
PIECE = "array<struct<skip:int,length:int,instance:bigint,kind:string,tail:string,tail2:string,head:string,head2:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places, in code points, end exclusive (SPAN).

    ``split`` and ``regexp_extract_all`` scan alike, so gaps and matches alternate.
    """
    found = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")),
        lambda x: F.struct(F.length(x["gap"]).alias("skip"), F.coalesce(F.length(x["match"]), F.lit(0)).alias("length"), x["match"].alias("text")),
    )
    placed = lambda x: bound(
        running(F.transform(x, lambda m: m["skip"] + m["length"]), lambda a, b: a + b, F.lit(0)),
        lambda before: F.transform(x, lambda m, i: F.struct(
            (F.get(before, i) + m["skip"]).alias("start"), (F.get(before, i) + m["skip"] + m["length"]).alias("end"), m["text"].alias("text")
        )),
    )
    return F.filter(bound(found, placed), lambda m: m["text"].isNotNull())


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's rule."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(F.try_to_number(c, F.lit("9")).cast("int").alias("v"), i.alias("i")))
    value = lambda x: F.when(x["i"] % 2 == 0, x["v"]).when(x["v"] > 4, 2 * x["v"] - 9).otherwise(2 * x["v"])
    return F.aggregate(figures, F.lit(0), lambda held, x: held + F.coalesce(value(x), F.lit(0))) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), lambda m: passes(kind, m["text"]))
    return F.when(HINTS[kind](text), found).otherwise(F.array().cast(SPAN))


def written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def pieces(text: Column) -> Column:
    """The text as gaps and tokens in turn (PIECE), with the last and first words, and two words, of each gap.

    The last gap has no token. A text without tokens has no pieces.
    """
    word = lambda gap, pattern: F.nullif(F.lower(F.regexp_replace(F.regexp_extract(gap, pattern, 1), r"[^\p{L}]++", " ")), F.lit(""))
    found = F.transform(
        F.arrays_zip(F.split(text, TOKEN, -1).alias("gap"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("match")),
        lambda x: F.struct(
            F.length(x["gap"]).alias("skip"), F.length(x["match"]).alias("length"), F.xxhash64(x["match"]).alias("instance"), kind_of(x["match"]).alias("kind"),
            word(x["gap"], r"(?<!\p{L})(\p{L}++)[^\p{L}]*+$").alias("tail"), word(x["gap"], r"(?<!\p{L})(\p{L}++[^\p{L}]++\p{L}++)[^\p{L}]*+$").alias("tail2"),
            word(x["gap"], r"^[^\p{L}]*+(\p{L}++)").alias("head"), word(x["gap"], r"^[^\p{L}]*+(\p{L}++[^\p{L}]++\p{L}++)").alias("head2"),
        ),
    )
    return F.when(text.rlike(TOKEN), found).otherwise(F.array().cast(PIECE))


def kind_of(instance: Column) -> Column:
    return F.when(instance.rlike(r"[\p{L}@]"), "x").otherwise("9")


def occurrences(held: DataFrame) -> DataFrame:
    """Rows __row, start, end, instance, seed, patterns: the base spans, and the tokens that touch none, with a pattern at least.

    A base span has the words before its first token and after its last; it can't hold a letter outside its tokens.
    """
    row, none = Window.partitionBy("__row"), F.struct(F.lit(None).cast("string").alias("near"), F.lit(None).cast("string").alias("wide"))
    last = lambda c: F.last(c, ignorenulls=True)
    until = lambda *order: row.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = lambda *order: row.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tokens = (
        held.where(F.size("__pieces") > 0).select("__row", F.posexplode("__pieces").alias("at", "p")).select("__row", "at", "p.*")
        .withColumn("end", F.sum(F.col("skip") + F.coalesce("length", F.lit(0))).over(until("at")).cast("int"))
        .withColumn("start", F.col("end") - F.col("length"))
        .withColumn("tail2", F.coalesce("tail2", F.concat(last("tail").over(past("at")), F.lit(" "), F.col("tail"))))
        .withColumn("head2", F.coalesce("head2", F.concat(F.col("head"), F.lit(" "), last("head").over(past(F.desc("at"))))))
        .withColumn("left", last(F.when(F.col("tail").isNotNull(), F.struct(F.col("tail").alias("near"), F.col("tail2").alias("wide")))).over(until("at")))
        .withColumn("right", last(F.when(F.col("head").isNotNull(), F.struct(F.col("head").alias("near"), F.col("head2").alias("wide")))).over(past(F.desc("at"))))
        .where("length is not null").select("__row", "start", "end", "instance", "kind", *(F.coalesce(side, none).alias(side) for side in ("left", "right")), F.lit(False).alias("seed"))
    )
    bases = (
        held.select("__row", F.explode(F.array_distinct(F.concat(*(F.col(f"__{kind}") for kind in PATTERNS)))).alias("b"))
        .select("__row", "b.start", "b.end", "b.instance", "b.kind", *(F.lit(None).cast(tokens.schema[side].dataType).alias(side) for side in ("left", "right")), F.lit(True).alias("seed"))
    )
    # By "first" a base span comes before the tokens that end after its start, by "final" after those that start before its end.
    first, final = F.when(F.col("seed"), F.col("start")).otherwise(F.col("end")), F.when(F.col("seed"), F.col("end")).otherwise(F.col("start"))
    items = (
        tokens.unionByName(bases).withColumn("first", first).withColumn("final", final)
        .withColumn("reach", F.max(F.when(F.col("seed"), F.col("end"))).over(past("first", "seed")))
        .withColumn("left", F.coalesce("left", last("left").over(past(F.desc("first"), F.desc("seed")))))
        .withColumn("right", F.coalesce("right", last("right").over(past("final", F.desc("seed")))))
        .where("seed or reach is null or reach <= start")
    )
    marked = lambda mark, words: F.concat(F.lit(mark), F.col("kind"), F.lit("|"), words)
    patterns = F.array_compact(F.array(
        marked("l1|", F.col("left.near")), marked("l2|", F.col("left.wide")), marked("r1|", F.col("right.near")), marked("r2|", F.col("right.wide"))
    ))
    return items.select("__row", "start", "end", "instance", "seed", patterns.alias("patterns")).where(F.size("patterns") > 0)


def trusted_patterns(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """edges: pattern, instance, n, seed. Returns the patterns whose confidence and support are high after the rounds."""
    score = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        judged = (
            edges.join(score, "instance").groupBy("pattern")
            .agg(
                F.round(F.sum(F.col("n") * F.col("score")) / (F.sum("n") + SMOOTHING), 6).alias("confidence"),
                F.sum((F.col("score") >= 0.5).cast("long")).alias("support"),
            )
        )
        trusted = materialise(judged.where((F.col("confidence") >= confidence) & (F.col("support") >= support)), "patterns")
        heard = (
            edges.where("not seed").join(trusted, "pattern").groupBy("instance")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("heard"))
        )
        score = (
            edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("seed")).join(heard, "instance", "left")
            .select("instance", F.round(F.greatest("seed", F.coalesce("heard", F.lit(0.0))), 6).alias("score"))
        )
    return trusted.select("pattern")


def find(docs: DataFrame, text: str = "text", spans: str = "__spans", **options) -> DataFrame:
    """``docs`` with a column named by ``spans``: a struct of the spans (start, end) of each base kind, and of ``id``, the discovered ones.

    Its own columns are in one struct of their own beside the input's, whose names are thus free.
    """
    whole = docs.select(F.struct("*").alias("__doc"), F.monotonically_increasing_id().alias("__row"))
    value = F.coalesce(F.col(f"__doc.`{text}`"), F.lit(""))
    places = lambda spans: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["text"]).alias("instance"), kind_of(s["text"]).alias("kind")
    ))
    base = (places(base_spans(value, kind)).alias(f"__{kind}") for kind in PATTERNS)
    held = materialise(whole.select("__doc", "__row", *base, pieces(value).alias("__pieces")), "pii")
    seen = materialise(occurrences(held), "occurrences")
    linked = seen.select(F.explode("patterns").alias("pattern"), "instance", "seed", "__row", "start", "end")
    edges = materialise(linked.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "graph")
    trusted = trusted_patterns(edges, **options)
    fresh = materialise(
        linked.where("not seed").join(trusted, "pattern", "left_semi").groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__id")), "discovered"
    )
    discard(seen, edges)
    found = held.drop("__pieces").join(fresh, "__row", "left")
    every = F.struct(*(F.col(f"__{kind}").alias(kind) for kind in PATTERNS), F.coalesce("__id", F.array().cast("array<struct<start:int,end:int>>")).alias("id"))
    return found.select("__doc.*", every.alias(spans))


def pii_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    kinds = list(PATTERNS)
    base = F.concat(*(written(k, F.col(f"__spans.{k}")) for k in kinds))
    return find(docs.select(doc_id, text), text, **options).select(
        doc_id,
        *(F.size(f"__spans.{k}").cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, written("id", F.col("__spans.id"))), ",").alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs``, with columns of whatever names, with every span of personal data in the text replaced by its kind in brackets; null texts stay null.

    Where spans overlap, the one that starts first (the longer one of two) is replaced, and the rest of the other is cut out.
    """
    spans, value = free_name("__spans", docs), F.col(text)
    marked = F.array_sort(F.concat(*(F.transform(F.col(f"{spans}.{k}"), named(k)) for k in [*PATTERNS, "id"])))
    # what stands before a span begins where all spans before it have ended
    kept = lambda s, reach: F.when(s["start"] >= reach, F.concat(F.substring(value, reach + 1, s["start"] - reach), F.lit("["), s["kind"], F.lit("]"))).otherwise("")
    cut = bound(marked, lambda m: bound(
        running(F.transform(m, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0)),
        lambda reach: F.concat(
            F.array_join(F.transform(m, lambda s, i: kept(s, F.get(reach, i))), ""),
            F.substring(value, F.array_max(F.transform(m, lambda s: s["end"])) + 1, F.length(value)),
        ),
    ))
    found = find(docs, text, spans, **options)
    some = F.size(F.flatten(F.array(*(F.transform(F.col(f"{spans}.{k}"), lambda s: s["start"]) for k in [*PATTERNS, "id"])))) > 0
    return found.withColumn(text, F.when(some, cut).otherwise(value)).select(*docs.columns)


def named(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), F.lit(kind).alias("kind"))

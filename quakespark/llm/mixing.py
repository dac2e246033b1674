"""Mixing sources to target weights by systematic sampling.

Every source has a target of words: its share, by weight, of ``share`` times all words, but at most ``most`` times
what it holds; what is above goes to the other sources by their weights until none is above. So many copies of
each of its documents are expected as the target is times its size. Within a source the expected copies
are summed up in the order of the documents, one random offset of the source is added, and a document is
taken once for each integer that its own step crosses: so floor(e) or ceil(e) times, and never above ``most``.

Documents are ordered by size (then id, then text), so that every stretch of similar sizes gives its share: the words
taken differ from the target by at most twice the longest document of the source, whatever the sizes are.

Sums are exact, in units of 2^-24 copies, and the offset is a hash of seed and source: reruns, other layouts of
files and tasks that run anew give the same mix. Everything is column expressions; a source that holds most
rows is spread over ranges of its order (``ordered.running``), and the two numbers that reach the driver are
sums over sources. A null text has size 0; a null source is a source of its own, after all others; documents of size
0 are dealt like others but take no words; a mix of no words has targets 0; equal rows are documents of their
own; an empty table gives an empty result; other columns, whatever their names, travel along in ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakespark.llm.ordered import running
from quakespark.session import discard, materialise

SEED = 20240
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
UNITS_LOG2 = 24


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A string in the order of the sources' code points, null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, source_size, target) from rows of key, size.

    With sources in the order of the level at which they are full, the level that leaves the right sum is the highest of
    (what is left) / (weights left), since it rises as long as sources are full and falls from then on.
    """
    held = materialise(sizes.groupBy("key").agg(F.sum("size").alias("source_size")), "sources")
    ranked = running(held, [], [F.col("key")], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = materialise(ranked.select("key", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    discard(held, ranked)
    words, all_weights = capped.agg(F.sum("source_size"), F.sum("weight")).first()
    full = running(capped, [], [F.col("cap") / F.col("weight"), F.col("key")], {"caps": F.col("cap"), "weights": F.col("weight")})
    level = full.agg(F.max((F.lit(share * (words or 0)) - F.col("caps")) / (F.lit(all_weights or 0) - F.col("weights")))).first()[0] or 0.0
    discard(full)
    return capped.select("key", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def sampled(docs: DataFrame, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **targets) -> DataFrame:
    """(row, size, source_size, target, copies): the ``keep`` columns (or all) of every row, as a struct, and the copies that the mix takes."""
    rows = materialise(
        docs.select(
            F.struct(*map(F.col, keep or docs.columns)).alias("row"), F.col(doc_id).alias("id"), source_key(F.col(source)).alias("key"),
            word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("mark"),
        ),
        "sized",
    )
    placed = running(rows, ["key"], [F.col("size"), F.col("id"), F.col("mark")], {"place": F.lit(1)}, source_targets(rows, **targets))
    expected = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * (1 << UNITS_LOG2))).otherwise(0).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "key")), 1, UNITS_LOG2 // 4), 16, 10).cast("long")
    crossed = lambda n: F.shiftright(offset + expected * n, UNITS_LOG2)
    return placed.select("row", "size", "source_size", "target", (crossed(F.col("place") + 1) - crossed(F.col("place"))).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    taken = sampled(docs, **options).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def mix_report(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The digest of the mix: doc_id, size, source_size, target, taken. Texts are read once, for their sizes, and don't travel."""
    rows = sampled(docs, [doc_id], doc_id, **options)
    return rows.select(F.col("row").getField(doc_id).alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: Shares again in rounds, as the rule says, where the operator takes one maximum.
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, {MOST} * source_size AS cap, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM s),
r AS (
  SELECT source, source_size, cap, weight, false AS is_full, ({SHARE} * sum(source_size) OVER ()) / sum(weight) OVER () AS level, 0 AS round FROM w
  UNION ALL
  SELECT source, source_size, cap, weight, now_full,
    ({SHARE} * sum(source_size) OVER () - coalesce(sum(cap) FILTER (WHERE now_full) OVER (), 0)) / nullif(sum(weight) FILTER (WHERE NOT now_full) OVER (), 0), round + 1
  FROM (SELECT *, is_full OR cap <= level * weight AS now_full, bool_or(NOT is_full AND cap <= level * weight) OVER () AS changed FROM r) WHERE changed),
t AS (
  SELECT source, source_size, CASE WHEN is_full OR level IS NULL THEN cap ELSE level * weight END AS target,
    CASE WHEN source_size > 0 THEN round(CASE WHEN is_full OR level IS NULL THEN cap ELSE level * weight END / source_size * {1 << UNITS_LOG2})::BIGINT ELSE 0 END AS expected,
    ('0x' || substr(md5('{SEED}:' || coalesce('s' || source, 't')), 1, {UNITS_LOG2 // 4}))::BIGINT AS shift
  FROM r WHERE round = (SELECT max(round) FROM r)),
p AS (
  SELECT doc_id, size, source_size, target, expected, shift, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((((shift + expected * n) >> {UNITS_LOG2}) - ((shift + expected * (n - 1)) >> {UNITS_LOG2})) * size)::BIGINT AS taken FROM p
"""

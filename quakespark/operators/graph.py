"""Graph helpers: connected components by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakespark.session import discard, materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge; ``component`` is the smallest node of its component.

    Every round takes the smallest label among a node's neighbours, then jumps to the label of that
    label, so that the number of rounds grows with the logarithm of the diameter. The labels of each
    round are written to the shared folder. Null ends are ignored; loops and repeated edges do no harm.
    A graph that has not settled after ``max_rounds`` raises instead of returning wrong labels.
    """
    ends = materialise(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"), "ends")
    both = materialise(ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    discard(ends)
    spent = labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(max_rounds):
        heard = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy("a").agg(F.min("label").alias("heard"))
        )
        nearer = labels.join(heard.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = materialise(
            nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")),
            "labels",
        )
        settled = new.where("old <> label").isEmpty()
        discard(spent)
        labels, spent = new.select("node", "label"), new
        if settled:
            discard(both)
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Bands of time are first so narrow that an event has about this many neighbours in it.
NEIGHBOURS = 100.0


def linked_in_time(events: DataFrame, pairs: Callable[[DataFrame, DataFrame, float], DataFrame], seconds: float, nodes: DataFrame | None = None, links: DataFrame | None = None, neighbours: float = NEIGHBOURS) -> DataFrame:
    """(id, component): events linked by ``pairs(first, second, seconds)`` (a_id, b_id), directly or over others, share the least id.

    Where events are dense, pairs are taken from a narrower band of time first. Then the band widens fourfold each time up to
    ``seconds``, and only pairs with an end outside the largest component are sought: all others would link what is linked. So no link
    is lost, while the pairs made grow with the events and not with their square, once they hang together. ``nodes`` (id): all ids,
    if ``events`` lacks some; ``links`` (a_id, b_id): further links.
    """
    c = F.col
    held = materialise(events.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "linked")  # few bytes, much work
    all_ids = held.select("id") if nodes is None else nodes.select("id")
    n = held.where("t is not null").groupBy(F.floor(c("t") / seconds).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    dense = n.agg(F.sum(c("n") * c("n")) / F.sum("n")).first()[0]
    wide = seconds if not dense else min(seconds, seconds * neighbours / dense)
    first = pairs(held, held, wide).select("a_id", "b_id")
    found = connected_components(first if links is None else first.unionByName(links.select("a_id", "b_id")), "a_id", "b_id")
    labels = materialise(all_ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("label")), "linked")
    while wide < seconds:
        wide = min(seconds, 4 * wide)
        largest = labels.groupBy("label").count().orderBy(c("count").desc(), "label").first()[0]
        outside = held.join(labels.where(c("label") != largest).select("id"), "id", "left_semi")
        more = pairs(outside, held, wide).select("a_id", "b_id").union(pairs(held, outside, wide).select("a_id", "b_id"))
        side = lambda p: labels.select(c("id").alias(f"{p}_id"), c("label").alias(p))
        ends = more.join(side("a"), "a_id").join(side("b"), "b_id").where("a <> b").select("a", "b").distinct()
        joined = connected_components(ends, "a", "b")
        spent, labels = labels, materialise(labels.join(joined.withColumnRenamed("node", "label"), "label", "left").select("id", F.coalesce("component", "label").alias("label")), "linked")
        discard(spent)
    discard(held)
    return labels.withColumnRenamed("label", "component")

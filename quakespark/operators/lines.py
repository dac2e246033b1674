"""Polylines as rows: exact cuts at latitudes and at distances along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.functions.columns import haversine_km, let

NODE = "struct<lon: double, lat: double, depth: double>"


def between(a: Column, b: Column, t: Column) -> Column:
    """The node at the share ``t`` of the way from a to b."""
    return F.struct(*((a[n] + t * (b[n] - a[n])).alias(n) for n in ("lon", "lat", "depth")))


def cut_to_latitudes(line: Column, low: Column, high: Column) -> Column:
    """The part of a line (an array of NODE) between two latitudes, from south to north, with nodes exactly at the cuts.

    Neighbouring parts thus share their end nodes. Cuts beyond the line's ends are its ends; null for lines of no node.
    """
    def cut(nodes: Column) -> Column:
        bounded = lambda lat: F.least(F.greatest(lat, nodes[0]["lat"]), F.element_at(nodes, -1)["lat"])

        def at(lat: Column) -> Column:
            below = F.filter(nodes, lambda n: n["lat"] <= lat)
            above = F.filter(nodes, lambda n: n["lat"] > lat)
            last, first = F.element_at(below, -1), F.get(above, F.lit(0))
            return F.when((F.size(above) == 0) | (last["lat"] == lat), last).otherwise(between(last, first, (lat - last["lat"]) / (first["lat"] - last["lat"])))

        inside = F.filter(nodes, lambda n: (n["lat"] > bounded(low) + 1e-9) & (n["lat"] < bounded(high) - 1e-9))
        return F.concat(F.array(let(bounded(low), at)), inside, F.array(let(bounded(high), at)))

    south_first = F.array_sort(line, lambda a, b: F.when(a["lat"] < b["lat"], -1).when(a["lat"] > b["lat"], 1).otherwise(0))
    return F.when(F.size(line) > 0, let(south_first, cut))


def cut_edges(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment, edge, nodes) of every edge (edge, nodes) in each segment's band of latitude (segment, low, high); edges outside of it are left out.

    Both meet by whole degrees of latitude.
    """
    c = F.col
    south = F.array_min(F.transform("nodes", lambda n: n["lat"]))
    north = F.array_max(F.transform("nodes", lambda n: n["lat"]))
    spans = lambda a, b: F.explode(F.sequence(F.floor(a), F.floor(b)))
    left = edges.where(F.size("nodes") > 1).withColumns({"south": south, "north": north}).withColumn("band", spans(c("south"), c("north")))
    right = segments.where("low < high").withColumn("band", spans(c("low"), c("high")))
    first = F.floor(F.greatest("south", "low")) == c("band")
    met = left.join(right, "band").where(first & (c("south") < c("high")) & (c("north") > c("low")))
    return met.select("segment", "edge", cut_to_latitudes(c("nodes"), c("low"), c("high")).alias("nodes"))


def split_at_lengths(lines: DataFrame, piece_km: float) -> DataFrame:
    """(line, piece, part, lon, lat, depth): lines cut where their length along the surface passes a multiple of ``piece_km``.

    lines: line, nodes. Each step between two nodes gives its own cuts, so a long line is work for many tasks; a cut is the
    last node of a piece and the first of the next.
    """
    c = F.col
    nodes = lines.select("line", F.posexplode("nodes").alias("i", "n"))
    order = Window.partitionBy("line").orderBy("i")
    steps = nodes.select("line", "i", "n", F.lag("n").over(order).alias("before"))
    km = F.coalesce(haversine_km(c("before.lat"), c("before.lon"), c("n.lat"), c("n.lon")), F.lit(0.0))
    placed = steps.withColumn("step", km).withColumn("end", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", c("end") - c("step"))
    multiples = F.sequence(F.floor(c("start") / piece_km) + 1, F.ceil(c("end") / piece_km) - 1)
    inner = F.when(F.floor(c("start") / piece_km) + 1 <= F.ceil(c("end") / piece_km) - 1, multiples).otherwise(F.array().cast("array<bigint>"))
    cut = lambda k: between(c("before"), c("n"), (k * piece_km - c("start")) / c("step"))
    row = lambda piece, at, n: F.struct(piece.cast("long").alias("piece"), at.cast("double").alias("at"), n.alias("n"))
    cuts = F.flatten(F.transform(inner, lambda k: F.array(row(k - 1, k * piece_km, cut(k)), row(k, k * piece_km, cut(k)))))
    own = F.greatest(F.ceil(c("end") / piece_km) - 1, F.lit(0))
    # a node that lies at a multiple ends one piece and, unless it is the last, begins the next
    twice = (c("end") > 0) & (c("end") == F.floor(c("end") / piece_km) * piece_km) & c("more")
    ends = F.when(twice, F.array(row(own, c("end"), c("n")), row(own + 1, c("end"), c("n")))).otherwise(F.array(row(own, c("end"), c("n"))))
    held = placed.withColumn("more", F.lead("i").over(order).isNotNull())
    out = held.select("line", F.explode(F.concat(cuts, ends)).alias("r")).select("line", "r.piece", "r.at", "r.n.*")
    return out.withColumn("part", F.row_number().over(Window.partitionBy("line", "piece").orderBy("at")) - 1).select("line", "piece", "part", "lon", "lat", "depth")

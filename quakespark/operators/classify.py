"""Tectonic classes of events from a slab's nodes, the trench, the volcanic arc, the errors of their places and their mechanisms."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakespark.functions.columns import let
from quakespark.functions.mechanism import interface_like
from quakespark.operators.catalog import inside_polygon
from quakespark.operators.faults import nearest_on_line, side_of_line
from quakespark.operators.grids import depth_range, nearest_node
from quakespark.session import discard, materialise

PLANES = ("strike1", "dip1", "rake1", "strike2", "dip2", "rake2")
#: Final classes of the raw ones; those not named are unclassified.
FINAL = {"intraarc_shallow": "intraarc", "intraarc_deep": "intraarc"} | {c: c for c in ("slab_interface", "intra_slab", "slab_deep", "outer_rise", "forearc")}


@dataclass
class Limits:
    """Fixed values of the decision tree: km, and degrees of the cones and of the plates' convergence."""

    arc_shallow: float = 40.0
    arc_deep: float = 90.0
    deep_margin: float = 15.0
    shallow_slab: float = 50.0
    margin: float = 11.0
    loose_margin: float = 15.0
    back_arc: float = 70.0
    node_km: float = 15.0
    convergence: float = 78.0
    normal_cone: float = 35.0
    slip_cone: float = 90.0


def prepared(events: DataFrame, nodes: DataFrame, limits: Limits) -> DataFrame:
    """Events with slab, slab_strike and slab_dip of the nearest node (null beyond ``node_km``), and low and high, the slab's depths in the error ellipse.

    events: id, lon, lat, depth, lon_error, lat_error, and more; nodes: node, lon, lat, depth, strike, dip. Places meet nodes by tiles;
    events of one place and error are measured once, and meet the result by these.
    """
    c = F.col
    keys = ["lon", "lat", "lon_error", "lat_error"]
    asked = materialise(events.select(*keys).distinct().withColumn("id", F.struct(*keys)), "places")
    spots = asked.select("lon", "lat").distinct().select(F.struct("lon", "lat").alias("id"), "lon", "lat")
    near = nearest_node(spots, nodes.select("node", "lon", "lat", "depth"), limits.node_km)
    found = near.join(nodes.select("node", c("strike").alias("slab_strike"), c("dip").alias("slab_dip")), "node", "left").select(c("id").alias("spot"), c("depth").alias("slab"), "slab_strike", "slab_dip")
    held = materialise(asked.select("id", F.struct("lon", "lat").alias("spot")).join(found, "spot").drop("spot"), "slab")
    around = depth_range(asked, nodes.select("node", "lon", "lat", "depth"), held.select("id", c("slab").alias("depth")))
    told = materialise(held.join(around, "id").select(*(c("id")[k].alias(f"at_{k}") for k in keys), "slab", "slab_strike", "slab_dip", "low", "high"), "prepared")
    discard(asked, held)
    same = functools.reduce(Column.__and__, (c(k).eqNullSafe(c(f"at_{k}")) for k in keys))
    return events.join(told, same).drop(*(f"at_{k}" for k in keys))


def raw_class(trench: list[tuple[float, float]], arc: list[tuple[float, float]], limits: Limits) -> Column:
    """The decision tree over the columns of ``prepared``, with relocated (boolean), depth_error and the planes' angles.

    What the branches share is one value each, so that no expression is written out twice.
    """
    c, x = F.col, limits
    depth, slab, error = c("depth"), c("slab"), c("depth_error")
    known = [all_known(n) for n in (PLANES[:3], PLANES[3:])]
    like = interface_like([tuple(c(n) for n in PLANES[:3]), tuple(c(n) for n in PLANES[3:])], c("slab_strike"), c("slab_dip"), x.convergence, x.normal_cone, x.slip_cone)
    in_zone = F.when(~(known[0] | known[1]) | like, "slab_interface").when(depth < slab, "forearc").otherwise("intra_slab")
    above = F.when(c("relocated"), depth <= slab - x.margin).when(error > 0, depth + error < c("low") - x.margin).otherwise(depth <= slab - x.loose_margin)
    below = F.when(c("relocated"), depth >= slab + x.margin).when(error > 0, depth - error > c("high") + x.margin).otherwise(depth >= slab + x.loose_margin)
    within_arc = (
        F.when(slab.isNotNull() & (depth >= slab - x.deep_margin), "slab_deep").when(depth <= x.arc_shallow, "intraarc_shallow")
        .when(slab.isNotNull() | (depth <= x.arc_deep), "intraarc_deep").otherwise("slab_deep")
    )
    west = F.coalesce(side_of_line(c("lon"), c("lat"), trench) == "west", F.lit(False))
    east = F.coalesce(c("lon") > nearest_on_line(c("lon"), c("lat"), [*arc, arc[0]])["x"], F.lit(False))
    in_arc = F.coalesce(inside_polygon(c("lon"), c("lat"), arc), F.lit(False))
    return let(in_arc, lambda inside: (
        F.when(inside & depth.isNotNull(), within_arc).when(west, "outer_rise").when(~inside & east & (depth < x.back_arc), "backarc")
        .when(slab.isNull() | depth.isNull(), "unclassified")
        .when(slab >= x.shallow_slab, F.when(depth >= slab - x.deep_margin, "slab_deep").otherwise("forearc"))
        .when(above, "forearc").when(below, "intra_slab").otherwise(in_zone)
    ))


def all_known(names: tuple[str, ...]) -> Column:
    held = F.lit(True)
    for n in names:
        held = held & F.col(n).isNotNull()
    return held


def classified(events: DataFrame, nodes: DataFrame, trench: list[tuple[float, float]], arc: list[tuple[float, float]], limits: Limits | None = None, overrides: dict[str, tuple[str, float]] | None = None, poor_before: float = 1930.0) -> DataFrame:
    """``events`` with class_raw, sub_depth (the slab's depth where it decided) and class.

    Events inside the slab before ``poor_before`` count as of the interface, since their depths are poor; ``overrides`` sets
    class and slab depth by id. events: id, lon, lat, depth, yr, lon_error, lat_error, depth_error (numbers), relocated, the six angles.
    """
    c, x = F.col, limits or Limits()
    held = prepared(events, nodes, x)
    final = F.create_map(*(F.lit(v) for pair in FINAL.items() for v in pair))
    by_id = {k: F.struct(F.lit(n).alias("name"), F.lit(float(d)).alias("depth")) for k, (n, d) in (overrides or {}).items()}
    own = F.create_map(*(v for k, o in by_id.items() for v in (F.lit(k), o)))[c("id").cast("string")] if by_id else F.lit(None).cast("struct<name: string, depth: double>")

    def result(raw: Column) -> Column:
        decided = raw.isin("slab_interface", "intra_slab", "forearc", "slab_deep")
        old = F.when((raw == "intra_slab") & (c("yr") < poor_before), "slab_interface").otherwise(raw)
        return F.struct(F.coalesce(own["name"], old).alias("raw"), F.coalesce(own["depth"], F.when(decided, c("slab"))).alias("depth"))

    one = held.select(*events.columns, F.explode(F.array(let(raw_class(trench, arc, x), result))).alias("found"))  # an explode keeps what it holds in one place
    return one.select(*events.columns, c("found.raw").alias("class_raw"), c("found.depth").alias("sub_depth"), F.coalesce(final[c("found.raw")], F.lit("unclassified")).alias("class"))

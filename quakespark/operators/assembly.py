"""Assembly of catalogs: thresholds that depend on magnitude and source, duplicate labels, best records, updates, truncated rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.functions.columns import haversine_km
from quakespark.session import materialise

#: From this magnitude on, events match up to this distance in km.
REACH = ((7.8, 220.0), (7.2, 150.0), (6.8, 100.0))
#: Records of these two sources match this much farther.
LOOSE_PAIR, LOOSE_KM = ("anss", "gcmt"), 40.0


def match_km(source_a: Column, source_b: Column, mag_a: Column, mag_b: Column, base_km: float) -> Column:
    """The distance up to which two records can be one event, by the larger known magnitude and the pair of sources."""
    largest = F.greatest(mag_a, mag_b)  # skips nulls
    far = F.lit(float(base_km))
    for least, km in sorted(REACH):
        far = F.when(largest >= least, F.lit(max(base_km, km))).otherwise(far)
    a, b = F.lower(source_a), F.lower(source_b)
    loose = (F.least(a, b) == LOOSE_PAIR[0]) & (F.greatest(a, b) == LOOSE_PAIR[1])
    return F.when(loose, F.greatest(far, F.lit(base_km + LOOSE_KM))).otherwise(far)


def record_pairs(events: DataFrame, seconds: float, base_km: float, delta_mag: float, others: DataFrame | None = None) -> DataFrame:
    """Pairs (a_id, b_id, km) of records that can be one event; events: id, t, mag, lon, lat, source. With ``others``, b is one of these.

    Times are cut into buckets of ``seconds`` and latitudes into bands as wide as the farthest match; the right side also goes to
    the bucket after its own and to the bands beside it, so the join is on both. Two magnitudes must be known to be compared; records without a time or place match nothing.
    """
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("id", "t", "mag", "lon", "lat", "source")]
    bucket, c = F.floor(F.col("t") / seconds), F.col
    band = F.floor(F.col("lat") * 111.19 / max(base_km + LOOSE_KM, *(km for _, km in REACH)))
    left = events.where("t is not null").select(*side("a"), bucket.alias("bucket"), band.alias("band"))
    right = (events if others is None else others).where("t is not null").select(*side("b"), F.explode(F.array(bucket, bucket - 1)).alias("bucket"), band.alias("own"))
    right = right.withColumn("band", F.explode(F.array(c("own") - 1, c("own"), c("own") + 1))).drop("own")
    return (
        left.join(right, ["bucket", "band"])
        .where((c("b_t") - c("a_t")).between(0, seconds) & ((c("b_t") > c("a_t")) | (c("b_id") > c("a_id"))))
        .where(F.abs(c("a_mag") - c("b_mag")) <= delta_mag + 1e-9)
        .withColumn("km", haversine_km(c("a_lat"), c("a_lon"), c("b_lat"), c("b_lon")))
        .where(c("km") <= match_km(c("a_source"), c("b_source"), c("a_mag"), c("b_mag"), base_km))
        .select("a_id", "b_id", "km")
    )


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their places (long, from 1) in the order, which must be total.

    Rows are range-partitioned by the order and numbered in each part; only the counts of the parts meet in one window.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", own).join(bases, "__part").withColumn(name, F.col("__base") + F.col("__own")).drop("__part", "__own", "__base")


def duplicate_labels(events: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, label): 'number_source' of each record, clusters numbered by their earliest time (unknown first), then by their id.

    events: id, t, source; clusters: id, cluster. The second and later records of a source in a cluster, by id, get a letter after
    the source: b for the second.
    """
    held = events.select("id", "t", F.coalesce(F.nullif(F.lower("source"), F.lit("")), F.lit("other")).alias("source")).join(clusters, "id")
    first = held.groupBy("cluster").agg(F.when(F.count(F.lit(1)) > F.count("t"), F.lit(float("-inf"))).otherwise(F.min("t")).alias("first"))
    ranked = numbered(first, [F.col("first"), F.col("cluster")], "number").select("cluster", "number")
    nth = F.row_number().over(Window.partitionBy("cluster", "source").orderBy("id"))
    return (
        held.withColumn("nth", nth).join(ranked, "cluster")
        .select("id", F.concat(F.col("number").cast("string"), F.lit("_"), "source", F.when(F.col("nth") > 1, F.char(F.lit(96) + F.col("nth"))).otherwise("")).alias("label"))
    )


def best_record(records: DataFrame, key: str, rank: str, fields: list[str], time: str, tie: str) -> DataFrame:
    """For each key the record of lowest rank, then most filled fields, then latest time, then lowest ``tie``.

    One aggregate, combined before the shuffle, so that a key with many records makes no large group.
    """
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    order = F.struct(F.coalesce(F.col(rank), F.lit(1 << 30)).alias("rank"), (-filled).alias("empty"), F.coalesce(-F.col(time), F.lit(float("inf"))).alias("time"), F.col(tie).alias("tie"))
    others = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("__best")).select(key, "__best.*")


def upsert(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of equal key, and the new ones besides."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def event_weight(mag: Column, steps: list[tuple[float, float]], end: float, b: float) -> Column:
    """1 / T * 10^(b (Mc - least Mc)), with Mc and T of the completeness step (Mc, since) of the magnitude; 0 below all steps."""
    least, out = min(m for m, _ in steps), F.lit(0.0)
    for mc, since in sorted(steps):
        value = 10.0 ** (b * (mc - least)) / (end - since) if end > since else 0.0
        out = F.when(mag + 1e-9 >= mc, F.lit(value)).otherwise(out)
    return out


def truncated_rates(shares: DataFrame, total: float, b: float, edges: list[float], most: Column) -> DataFrame:
    """(cell, bin, rate): ``total`` dealt over cells by ``share`` and over magnitude bins by a truncated recurrence law.

    Above ``most`` (a column of ``shares``) rates are 0. The bins are an array of each cell, so nothing is joined.
    """
    beyond = lambda m: F.pow(F.lit(10.0), b * (edges[0] - F.least(F.lit(m), most)))
    edge = lambda m: F.when(F.lit(m) >= most - 1e-9, F.pow(F.lit(10.0), b * (edges[0] - most))).otherwise(beyond(m))
    bins = F.array(*(F.greatest(edge(low) - edge(high), F.lit(0.0)) for low, high in zip(edges[:-1], edges[1:], strict=True)))
    whole = shares.agg(F.sum("share").alias("__all"))
    return (
        shares.crossJoin(F.broadcast(whole))  # one row
        .select("cell", (F.col("share") / F.col("__all") * total).alias("own"), F.posexplode(bins).alias("bin", "part"))
        .select("cell", F.col("bin").cast("long").alias("bin"), (F.col("own") * F.col("part")).alias("rate"))
    )


def weighted_depth(points: DataFrame, rate: str = "rate", depth: str = "depth") -> DataFrame:
    """(lon, lat, depth): the mean depth of a place weighted by rates; the plain mean where no rate is positive."""
    r, z = F.col(rate), F.col(depth)
    return points.groupBy("lon", "lat").agg(F.when(F.max(r) <= 0, F.avg(z)).otherwise(F.sum(r * z) / F.sum(r)).alias("depth"))


def collapse_source(planes: DataFrame, depths: DataFrame) -> DataFrame:
    """(source, plane, depth): of each source the most probable plane (the first of equals) and the mean depth by probability.

    planes: source, nth, probability, plane; depths: source, probability, depth.
    """
    best = planes.groupBy("source").agg(F.min_by("plane", F.struct((-F.col("probability")).alias("p"), "nth")).alias("plane"))
    mean = depths.groupBy("source").agg((F.sum(F.col("probability") * F.col("depth")) / F.sum("probability")).alias("depth"))
    return best.join(mean, "source")

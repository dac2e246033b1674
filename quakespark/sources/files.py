"""Readers of catalog, completeness, grid and source-model files: one DataFrame each, with declared schemas.

Numbers that can't be read become null. Every reader takes a path, a folder or a glob, so that many files are
read in one scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.functions.columns import wrap_longitude

#: Columns of the unified catalog; the three errors are numbers or one of the words relocated, default.
CATALOG = (
    "id string, time_iso string, longitude double, latitude double, depth double, mag double, mag_type string, lon_error string, lat_error string, depth_error string, "
    "mag_error double, strike1 double, dip1 double, rake1 double, strike2 double, dip2 double, rake2 double, "
    "Mrr double, Mtt double, Mpp double, Mrt double, Mrp double, Mtp double, source string, dups string"
)
COMPLETENESS = "start_iso string, end_iso string, n int, mc double, b double, years double"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The unified catalog, with time, each error as a number and as a flag, and yr (decimal year); columns are matched by name."""
    names = [x.split() for x in CATALOG.split(", ")]
    raw = spark.read.csv(path, header=True)
    held = raw.select(*((F.col(n).try_cast(t) if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, t in names))
    time = F.coalesce(F.try_to_timestamp("time_iso"), F.try_to_timestamp("time_iso", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    year = F.year("time")
    day = (F.dayofyear("time") - 1 + (F.unix_micros("time") / 1e6 % 86400) / 86400) / F.when(F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366, 366).otherwise(365)
    errors = ("lon_error", "lat_error", "depth_error")
    return (
        held.withColumn("time", time).withColumn("yr", year + day)
        .withColumns({f"{e}_flag": F.when(F.lower(F.trim(e)).isin("relocated", "default"), F.lower(F.trim(e))) for e in errors})
        .withColumns({e: F.col(e).try_cast("double") for e in errors})
    )


def read_completeness(spark: SparkSession, path: str) -> DataFrame:
    """Completeness windows, tab-separated under one header line, in any letter case."""
    return spark.read.csv(path, sep="\t", header=True, schema=COMPLETENESS, enforceSchema=True)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Sites or cells: lon, lat, vs30 (null where the file has none)."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*((F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")).alias(c) for c in ("lon", "lat", "vs30")))


def read_moment_tensors(spark: SparkSession, path: str) -> DataFrame:
    """Centroid moment tensors in the public five-line format: id, time, lat, lon, depth and their errors, moment (N m), mw, six components, two planes.

    Time and place are the centroid's: the origin time with the shift of line 3 added, and the hypocentre only where line 3 has no
    place. mw is rounded to one decimal. Lines 3 to 5 are read as numbers between white space. Events without an origin time are left out.
    Events are cut from whole files, which this format keeps to a month or some years each; lines after the
    last whole event of a file are left out.
    """
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    files = spark.read.text(path, wholetext=True).select(F.filter(lines, lambda x: F.length(F.trim(x)) > 0).alias("lines"))
    events = files.where(F.size("lines") >= 5).select("lines", F.explode(F.sequence(F.lit(0), F.floor(F.size("lines") / 5).cast("int") - 1)).alias("at"))
    line = [F.element_at("lines", F.col("at") * 5 + k + 1) for k in range(5)]
    held = events.select(*(x.alias(f"l{k}") for k, x in enumerate(line)))

    def part(k: int, start: int, end: int) -> Column:
        return F.trim(F.substring(f"l{k}", start, end - start + 1))

    def number(k: int, start: int, end: int) -> Column:
        return part(k, start, end).try_cast("double")

    def numbers(text: Column) -> Column:
        return F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())

    held = held.select(
        "*", numbers(F.when(F.col("l2").contains("CENTROID:"), F.substring_index("l2", "CENTROID:", -1)).otherwise("")).alias("n2"),
        numbers(F.col("l3")).alias("n3"), numbers(F.col("l4")).alias("n4"),
    )
    at = lambda k, i: F.get(f"n{k}", F.lit(i))
    origin = F.try_to_timestamp(F.concat_ws(" ", part(0, 6, 15), F.substring(part(0, 17, 26), 1, 8)), F.lit("yyyy/MM/dd HH:mm:ss"))
    second = F.coalesce(F.concat(F.lit("0."), F.regexp_extract(part(0, 17, 26), r"\.([0-9]+)", 1), F.lit("0")).try_cast("double"), F.lit(0.0))
    micros = F.unix_micros(origin) + F.round((second + F.coalesce(at(2, 0), F.lit(0.0))) * 1e6).cast("long")
    unit = F.pow(F.lit(10.0), at(3, 0) - 7)  # from dyn cm
    tensor = {n: at(3, 2 * i + 1) * unit for i, n in enumerate(("Mrr", "Mtt", "Mpp", "Mrt", "Mrp", "Mtp"))}
    moment = F.when(F.size("n4") >= 10, at(4, 9)) * unit
    planes = {n: F.when(F.size("n4") >= 16, F.get("n4", F.size("n4") - 6 + i)) for i, n in enumerate(("strike1", "dip1", "rake1", "strike2", "dip2", "rake2"))}
    centroid = {"lat": (2, number(0, 28, 33)), "lon": (4, number(0, 35, 41)), "depth": (6, number(0, 43, 47))}
    return held.where(origin.isNotNull()).select(
        part(1, 1, 16).alias("id"), F.timestamp_micros(micros).alias("time"), *(F.coalesce(at(2, i), header).alias(n) for n, (i, header) in centroid.items()),
        *(at(2, i + 1).alias(f"{n}_error") for n, (i, _) in centroid.items()),
        moment.alias("moment"), F.when(moment > 0, F.round((F.log10(moment) - 9.1) / 1.5, 1)).alias("mw"), *(v.alias(n) for n, v in tensor.items()), *(v.alias(n) for n, v in planes.items()),
    )


def read_logic_tree(spark: SparkSession, path: str) -> DataFrame:
    """(branch_id, model, weight), one row a branch; raises if the weights don't add up to 1."""
    branches = spark.read.format("xml").options(rowTag="logicTreeBranch", attributePrefix="_").schema(
        "_branchID string, uncertaintyModel string, uncertaintyWeight double"
    ).load(path).select(F.col("_branchID").alias("branch_id"), F.trim("uncertaintyModel").alias("model"), F.col("uncertaintyWeight").alias("weight"))
    total = branches.agg(F.sum("weight")).first()[0]
    if total is None or not math.isclose(total, 1.0, abs_tol=1e-6):
        raise ValueError(f"the weights of {path} add up to {total}")
    return branches


def read_point_sources(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, lon, lat, a, b, m_min, m_max) of point sources with truncated Gutenberg-Richter laws."""
    rows = spark.read.format("xml").options(rowTag="pointSource", attributePrefix="_", ignoreNamespace=True).schema(
        "_id string, _name string, pointGeometry struct<Point: struct<pos: string>>, "
        "truncGutenbergRichterMFD struct<_aValue: double, _bValue: double, _minMag: double, _maxMag: double>"
    ).load(path)
    place = F.split(F.trim("pointGeometry.Point.pos"), r"\s+")
    law = "truncGutenbergRichterMFD"
    return rows.select(
        F.col("_id").alias("id"), F.col("_name").alias("name"), F.try_element_at(place, F.lit(1)).try_cast("double").alias("lon"), F.try_element_at(place, F.lit(2)).try_cast("double").alias("lat"),
        F.col(f"{law}._aValue").alias("a"), F.col(f"{law}._bValue").alias("b"), F.col(f"{law}._minMag").alias("m_min"), F.col(f"{law}._maxMag").alias("m_max"),
    )


def read_forecast_events(spark: SparkSession, path: str) -> DataFrame:
    """The first six columns (id, time, lon, lat, depth, mag) of catalogs, by position. Rows without time, place or
    magnitude are left out; a missing depth is 0. A missing id stays null: lines of a split file have no number."""
    names = ("id", "time", "lon", "lat", "depth", "mag")
    lines = spark.read.option("header", True).option("enforceSchema", True).schema(", ".join(f"{n} string" for n in names)).csv(path)
    c = {n: F.nullif(F.trim(n), F.lit("")) for n in names}
    held = lines.select(c["id"].alias("id"), c["time"].try_cast("timestamp").alias("time"), *(c[n].try_cast("double").alias(n) for n in names[2:]))
    return held.na.drop(subset=["time", "lon", "lat", "mag"]).na.fill(0.0, ["depth"])


def read_xyz(spark: SparkSession, path: str, flip: bool = False) -> DataFrame:
    """Nodes of "lon,lat,value" lines: longitudes of 0..360 become -180..180, ``flip`` changes the sign; lines without a value go."""
    nodes = spark.read.schema("lon double, lat double, value double").csv(path).na.drop()
    return nodes.where(~F.isnan("value")).select(wrap_longitude(F.col("lon")).alias("lon"), "lat", (-F.col("value") if flip else F.col("value")).alias("value"))

"""Readers of strong-motion records, spectra and geometry as JSON, and writers of forecasts, spectra and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines): each file, a record of some thousand samples, in one row."""
    text = F.regexp_replace("value", "\r", "")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split(text, "\n").alias("lines"))


def _numbers(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(text), r"\s+"), lambda x: F.replace(F.upper(x), F.lit("D"), F.lit("E")).try_cast("double")), lambda x: x.isNotNull())


def read_accelerations(spark: SparkSession, path: str, dt: float | None = None) -> DataFrame:
    """(file, dt, npts, samples) of files whose first 50 lines hold one with NPTS= and DT=; the samples follow it, at most NPTS of them.

    ``dt`` takes the place of the header's. Files without such a line, or without a positive step, are left out.
    """
    header = F.array_position(F.transform(F.slice("lines", 1, 50), lambda x: F.upper(x).contains("NPTS") & F.upper(x).contains("DT")), F.lit(True))
    held = _whole_files(spark, path).withColumn("at", header.cast("int")).where("at > 0")
    line = F.element_at("lines", F.col("at"))
    npts = F.nullif(F.regexp_extract(line, r"(?i)NPTS\s*=\s*(\d+)", 1), F.lit("")).try_cast("int")
    step = F.lit(dt) if dt is not None else F.regexp_extract(line, r"(?i)\bDT\s*=\s*([\d.Ee+-]+)", 1).try_cast("double")
    rest = F.array_join(F.slice("lines", F.col("at") + 1, F.size("lines")), " ")
    found = held.select("file", step.alias("dt"), npts.alias("npts"), _numbers(rest).alias("samples")).where("dt > 0")
    return found.select("file", "dt", "npts", F.when(F.col("npts").isNotNull(), F.slice("samples", 1, F.col("npts"))).otherwise(F.col("samples")).alias("samples"))


TEXT_LINES, INTEGER_LINES, REAL_LINES = 11, 6, 10


def read_smc(spark: SparkSession, path: str, width: int = 10) -> DataFrame:
    """(file, dt, npts, samples) of fixed-width records: 11 lines of text, 6 of integers (8 of 10 characters), 10 of reals (5 of
    15), as many comment lines as the 16th integer says, and samples of ``width`` characters, 8 a line, as many as the 17th says.

    dt is the inverse of the second real, samples a second. Files that are too short, or whose samples aren't as many, are left out.
    """
    fields = lambda x, n: F.filter(F.transform(F.sequence(F.lit(0), F.ceil(F.length(x) / n).cast("int")), lambda i: F.trim(F.substring(x, i * n + 1, F.lit(n)))), lambda v: v != "")
    part = lambda start, n, size: F.flatten(F.transform(F.slice("lines", F.lit(start + 1), F.lit(n)), lambda x: fields(x, size)))
    held = _whole_files(spark, path).where(F.size("lines") > TEXT_LINES + INTEGER_LINES + REAL_LINES)
    held = held.select("file", "lines", part(TEXT_LINES, INTEGER_LINES, 10).alias("ints"), part(TEXT_LINES + INTEGER_LINES, REAL_LINES, 15).alias("reals")).where((F.size("ints") >= 48) & (F.size("reals") >= 2))
    comments, npts = F.col("ints")[15].try_cast("int"), F.col("ints")[16].try_cast("int")
    rate = F.replace(F.upper(F.col("reals")[1]), F.lit("D"), F.lit("E")).try_cast("double")
    body = F.slice("lines", comments + TEXT_LINES + INTEGER_LINES + REAL_LINES + 1, F.size("lines"))
    samples = F.filter(F.transform(F.flatten(F.transform(body, lambda x: fields(x, width))), lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    found = held.where(comments.isNotNull() & (rate > 0)).select("file", (1 / rate).alias("dt"), npts.alias("npts"), samples.alias("samples"))
    return found.where(F.size("samples") == F.col("npts"))


def read_spectrum(spark: SparkSession, path: str) -> DataFrame:
    """(file, period, value) of lines "label value": PGA has period 0, SA(x) period x; comments and other labels are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    label = parts[0]
    period = F.when(label == "PGA", 0.0).otherwise(F.nullif(F.regexp_extract(label, r"^SA\((.+)\)$", 1), F.lit("")).try_cast("double"))
    rows = spark.read.text(path).where(~F.ltrim("value").startswith("#")).select(F.input_file_name().alias("file"), period.alias("period"), F.get(parts, F.lit(1)).try_cast("double").alias("value"))
    return rows.where("period is not null and value is not null")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(geometry, edge, type, nodes) of geometry documents with edges from the top down, by their index, or by depth where they have none."""
    node = "struct<lon: double, lat: double, depth_km: double>"
    raw = spark.read.schema(f"geometry_id string, edges array<struct<edge_index: int, edge_type: string, depth_km: double, nodes: array<{node}>>>").json(path, multiLine=True)
    order = F.array_sort("edges", lambda a, b: F.coalesce(F.signum(F.coalesce(a["edge_index"].cast("double"), a["depth_km"]) - F.coalesce(b["edge_index"].cast("double"), b["depth_km"])).cast("int"), F.lit(0)))
    nodes = F.transform("e.nodes", lambda n: F.struct(n["lon"].alias("lon"), n["lat"].alias("lat"), n["depth_km"].alias("depth")))
    return raw.select(F.col("geometry_id").alias("geometry"), F.posexplode(order).alias("edge", "e")).select("geometry", "edge", F.col("e.edge_type").alias("type"), nodes.alias("nodes"))


def _scientific(value: Column, digits: int) -> Column:
    """A number as in 1.25e-03, with so many decimals; zero as 0.0e+00."""
    return F.lower(F.format_string(f"%.{digits}e", value.cast("double")))


def forecast_lines(cells: DataFrame, m_min: float, m_max: float = 10.5) -> DataFrame:
    """One line a cell (column value) of cells with west, east, south, north, upper, lower, rate and dispersion, in the spatial format."""
    c = F.col
    fixed = [F.format_string("%.1f", c(n)) for n in ("west", "east", "south", "north", "upper", "lower")] + [F.lit(f"{m_min:.1f}"), F.lit(f"{m_max:.1f}")]
    return cells.select(F.concat_ws(",", *fixed, _scientific(c("rate"), 16), F.format_string("%.6f", c("dispersion")), F.lit("1")).alias("value"))


FORECAST_HEAD = "lon_min, lon_max, lat_min, lat_max, depth_min, depth_max, m_min, m_max, rate, dispersion, mask"


def bin_lines(rates: DataFrame, magnitudes: list[float]) -> DataFrame:
    """One line a cell of rows west, east, south, north, upper, lower, dispersion, bin, rate: a rate for each bin, 0 where a cell lacks it."""
    place = ["west", "east", "south", "north", "upper", "lower", "dispersion"]
    wide = rates.groupBy(*place).pivot("bin", list(range(len(magnitudes)))).agg(F.sum("rate"))
    shown = [F.format_string("%.1f", F.col(n)) for n in place[:6]] + [_scientific(F.coalesce(F.col(f"`{k}`"), F.lit(0.0)), 16) for k in range(len(magnitudes))]
    return wide.select(F.concat_ws(",", *shown, _scientific(F.col("dispersion"), 16)).alias("value"))


def write_lines(lines: DataFrame, path: str, head: str) -> None:
    """Text files, each with the header as its first line, so that a part is a forecast of its own."""
    lines.withColumnRenamed("value", head).write.csv(path, header=True, quote="", sep="\x01")


def write_spectra(rows: DataFrame, path: str) -> None:
    """A folder for each place of rows place, label, value (in the order of ``nth``), with lines "label value"."""
    text = F.concat(F.rpad("label", 8, " "), F.lit("  "), _scientific(F.col("value"), 6))
    rows.select("place", "nth", text.alias("value")).repartition("place").sortWithinPartitions("place", "nth").select("place", "value").write.partitionBy("place").text(path)


def write_results(rows: DataFrame, path: str) -> None:
    """One JSON object a row; unknown values are written as null."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)

"""Readers of polygons and lines: GeoJSON, well-known text and shapefiles, as rows of ``rings`` or ``parts`` (arrays of corners)."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RING = "array<array<struct<lon: double, lat: double>>>"


def _corners(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def read_geojson(spark: SparkSession, path: str, key: str | None = None, lines: bool = False) -> DataFrame:
    """(poly, properties, rings) of the Polygons and MultiPolygons of feature collections, or of one feature a line.

    ``key`` names the property that is the polygon's name; without one it is the feature's place in its file, from 0.
    Each part of a MultiPolygon is a row of the same name. Other geometries and features without one are left out.
    """
    feature = "struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    if lines:
        held = spark.read.text(path).select(F.from_json("value", feature).alias("f"), F.lit(None).cast("int").alias("i"))
    else:
        held = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<features: array<{feature}>>")["features"].alias("all")).select(F.posexplode("all").alias("i", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.array(F.from_json(F.when(kind == "Polygon", text), "array<array<array<double>>>"))
    parts = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))
    name = F.col("i").cast("string") if key is None else F.col("f.properties")[key]
    return held.select(name.alias("poly"), F.col("f.properties").alias("properties"), F.explode(parts).alias("part")).select("poly", "properties", F.transform("part", _corners).alias("rings"))


def wkt_rings(text: Column) -> Column:
    """The rings of a POLYGON text; of a MULTIPOLYGON an array for each part."""
    ring = lambda r: F.transform(F.split(r, ","), lambda p: _pair(F.split(F.trim(p), r"\s+")))
    _pair = lambda x: F.struct(x[0].try_cast("double").alias("lon"), F.get(x, F.lit(1)).try_cast("double").alias("lat"))
    parts = F.regexp_extract_all(text, F.lit(r"\((\s*\([^()]*\)\s*(?:,\s*\([^()]*\)\s*)*)\)"), F.lit(1))
    return F.transform(parts, lambda part: F.transform(F.regexp_extract_all(part, F.lit(r"\(([^()]*)\)"), F.lit(1)), ring))


def read_wkt(spark: SparkSession, path: str, column: str, key: str) -> DataFrame:
    """(poly, rings) of a CSV with a column of POLYGON or MULTIPOLYGON texts; other texts are left out."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
    wanted = F.upper(F.trim(column)).rlike("^(MULTI)?POLYGON")
    return raw.where(wanted).select(F.col(key).alias("poly"), F.explode(wkt_rings(F.col(column))).alias("rings"))


def _shapes(content: bytes) -> list[list[list[tuple[float, float]]] | None]:
    """The parts of each record of a .shp file; None for null shapes, a part of one corner for points."""
    out, at = [], 100
    while at + 12 <= len(content):
        words = struct.unpack_from(">i", content, at + 4)[0]
        kind, body = struct.unpack_from("<i", content, at + 8)[0], at + 8
        if kind in (1, 11, 21):
            out.append([[struct.unpack_from("<2d", content, body + 4)]])
        elif kind in (3, 5, 13, 15, 23, 25):
            n_parts, n_points = struct.unpack_from("<2i", content, body + 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", content, body + 44), n_points]
            values = struct.unpack_from(f"<{2 * n_points}d", content, body + 44 + 4 * n_parts)
            points = list(zip(values[::2], values[1::2], strict=True))
            out.append([points[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)])
        else:
            out.append(None)
        at += 8 + 2 * words
    return out


def _attributes(content: bytes, encoding: str) -> list[dict[str, str]]:
    """The rows of a .dbf file as trimmed texts, deleted ones included, since shapes are matched by place."""
    count, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode(encoding), content[at + 16]))
        at += 32
    out = []
    for i in range(count):
        row, at = {}, head + i * size + 1
        for name, width in fields:
            row[name] = content[at : at + width].decode(encoding).strip(" \0")
            at += width
        out.append(row)
    return out


def read_shapefiles(spark: SparkSession, folder: str, encoding: str = "latin-1") -> DataFrame:
    """(file, n, properties, parts) of the points, lines and polygons of all .shp files of a folder, with the attributes of the .dbf beside each.

    A file, at most 2 GB by its format, is decoded in one task; files are dealt over tasks. Null shapes have null parts.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(folder)
    name = F.regexp_replace("path", r"\.[^.]*$", "")
    kind = lambda k: F.max(F.when(F.lower("path").endswith(k), F.col("content")))
    pairs = files.groupBy(name.alias("file")).agg(kind(".shp").alias("shp"), kind(".dbf").alias("dbf")).where("shp is not null")
    corner = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
    types = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.list_(corner))]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, shp, dbf in zip(*(b.column(c).to_pylist() for c in ("file", "shp", "dbf")), strict=True):
                shapes = _shapes(shp)
                rows = _attributes(dbf, encoding) if dbf else []
                parts = [s and [[{"lon": x, "lat": y} for x, y in part] for part in s] for s in shapes]
                own = [list(rows[i].items()) if i < len(rows) else [] for i in range(len(shapes))]
                columns = [[file] * len(shapes), list(range(len(shapes))), own, parts]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "n", "properties", "parts"])

    return pairs.mapInArrow(decoded, f"file string, n long, properties map<string, string>, parts {RING}")


def turned_back(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of web-Mercator metres."""
    radius = 6378137.0
    return F.degrees(x / radius), F.degrees(2 * F.atan(F.exp(y / radius)) - math.pi / 2)


def usable_faults(faults: DataFrame, least: float) -> DataFrame:
    """Faults with ``reason``: null for those that can be used, else the first rule that they break.

    faults: points (array of corners), dip, upper, lower, slip_rate, max_mag.
    """
    missing = F.col("dip").isNull() | F.col("upper").isNull() | F.col("lower").isNull() | F.col("slip_rate").isNull() | F.col("max_mag").isNull()
    bad = (F.col("slip_rate") <= 0) | (F.col("lower") <= F.col("upper")) | (F.col("dip") <= 0) | (F.col("dip") > 90)
    few = F.coalesce(F.size("points"), F.lit(0)) < 2
    return faults.withColumn("reason", F.when(few, "points").when(missing, "attribute").when(bad, "geometry").when(F.col("max_mag") <= least, "magnitude"))

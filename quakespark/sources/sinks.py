"""Writers: catalogs by class, wide rate grids, tab-separated summaries, GeoJSON features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_class(catalog: DataFrame, path: str, column: str = "class") -> None:
    """CSV files with a header, one folder for each class."""
    catalog.write.partitionBy(column).csv(path, header=True)


def wide_rates(rates: DataFrame, edges: list[float]) -> DataFrame:
    """lon, lat, depth and a column rate_M<low>_<high> for each bin, from rows lon, lat, depth, bin, rate; 0 where a cell lacks a bin."""
    names = [f"rate_M{low:.1f}_{high:.1f}" for low, high in zip(edges[:-1], edges[1:], strict=True)]
    wide = rates.groupBy("lon", "lat", "depth").pivot("bin", list(range(len(names)))).agg(F.sum("rate"))
    return wide.select("lon", "lat", "depth", *(F.coalesce(F.col(f"`{k}`"), F.lit(0.0)).alias(n) for k, n in enumerate(names)))


def write_wide_rates(rates: DataFrame, edges: list[float], path: str) -> None:
    wide_rates(rates, edges).write.csv(path, header=True)


def write_summary(rows: DataFrame, path: str) -> None:
    """Tab-separated text with a header."""
    rows.write.csv(path, sep="\t", header=True)


def point_features(rows: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One GeoJSON feature a row (column value): a point, and the other columns as properties."""
    others = [c for c in rows.columns if c not in (lon, lat)]
    place = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), place.alias("geometry"), F.struct(*others).alias("properties"))).alias("value"))


def write_point_features(rows: DataFrame, path: str, **places) -> None:
    """Newline-delimited GeoJSON, which any number of tasks can write and read."""
    point_features(rows, **places).write.text(path)

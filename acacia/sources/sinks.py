"""Feature collections, documents in columns, and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acacia.functions import text


def point_features(rows: DataFrame, lat: str, lon: str, properties: list[str]) -> DataFrame:
    """A GeoJSON feature for each row."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def polygon_features(areas: DataFrame, properties: list[str]) -> DataFrame:
    shape = F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates"))
    return areas.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def line_features(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Each trajectory as a line in the order of its nodes."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat")))
    lines = nodes.groupBy(*keys).agg(F.transform(ordered, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    shape = F.struct(F.lit("LineString").alias("type"), "coordinates")
    return lines.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*keys).alias("properties"))).alias("feature"))


def write_collection(features: DataFrame, path: str) -> None:
    """Features as lines of JSON; a collection of any size is a folder of such files."""
    features.write.mode("overwrite").text(path)


def collection(features: DataFrame) -> DataFrame:
    """One GeoJSON document. For results of a size a client can read; larger ones go to ``write_collection``."""
    joined = F.array_join(F.array_sort(F.collect_list("feature")), ",")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("document"))


def bounded_list(items: Column, most: int = 500, sample: int = 50) -> Column:
    """A list as JSON; a long one as its length and first items."""
    long = F.to_json(F.struct(F.size(items).alias("count"), F.slice(items, 1, sample).alias("sample")))
    return F.when(F.size(items) > most, long).otherwise(F.to_json(items))


def parks_export(areas: DataFrame, fires: DataFrame, settlements: DataFrame, loss: DataFrame, roadless: DataFrame) -> DataFrame:
    """A row for every area with four aggregates, 0 where there is none; numbers as text with fixed decimals."""
    out = areas.select("id", "name", "country", "area_km2")
    for rows, column in ((fires, "fire_count"), (settlements, "settlement_count"), (loss, "deforestation_km2"), (roadless, "roadless_pct")):
        out = out.join(rows.select(F.col("park_id").alias("id"), column), "id", "left")
    return out.select(
        F.col("id").alias("park_id"), "name", "country", text.fixed(F.coalesce("area_km2", F.lit(0.0)), 2).alias("area_km2"), F.coalesce("fire_count", F.lit(0)).cast("string").alias("fire_count"),
        F.coalesce("settlement_count", F.lit(0)).cast("string").alias("settlement_count"), text.fixed(F.coalesce("deforestation_km2", F.lit(0.0)), 4).alias("deforestation_km2"),
        text.fixed(F.coalesce("roadless_pct", F.lit(0.0)), 2).alias("roadless_pct"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def job_status(history: DataFrame, most: int = 10) -> DataFrame:
    """Each task's latest state with its last events."""
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("at", "status", "details"))))
    return history.groupBy("task").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("updated"), F.slice(ordered, 1, most).alias("history"))

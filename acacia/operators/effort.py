"""Patrol effort by grid cell and season."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acacia.functions import classify

DRY, RAINY = (11, 12, 1, 2, 3, 4), (5, 6, 7, 8, 9, 10)


def in_bounds(effort: DataFrame, cells: DataFrame, box: tuple[float, float, float, float] | None = None, years: tuple[int, int] | None = None, movement: str | None = None) -> DataFrame:
    """Effort with its cell's centre; a filter that is not given filters nothing."""
    out = effort.join(cells, effort["grid_cell_id"] == cells["id"]).drop(cells["id"])
    if years is not None:
        out = out.where(F.col("year").between(*years))
    if movement is not None:
        out = out.where(F.col("movement_type") == movement)
    if box is not None:
        out = out.where(F.col("lat_center").between(box[0], box[1]) & F.col("lon_center").between(box[2], box[3]))
    return out


def monthly(effort: DataFrame) -> DataFrame:
    return effort.where("day is null and movement_type = 'all'")


def by_season(effort: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Each cell's effort over some years, with the dry and rainy months in which it was visited."""
    rows = monthly(effort).where(F.col("year").between(*years))
    return rows.groupBy("grid_cell_id").agg(
        F.sum("total_distance_km").alias("total_distance_km"), F.sum("total_points").alias("total_points"), F.max("unique_uploads").alias("unique_uploads"),
        F.max("coverage_percent").alias("coverage_percent"), F.array_join(F.array_sort(F.collect_set(F.col("month").cast("string"))), ",").alias("months_visited"),
        F.count_distinct("month").alias("month_count"), F.count_distinct(F.when(F.col("month").isin(*DRY), F.col("month"))).alias("dry_months"),
        F.count_distinct(F.when(F.col("month").isin(*RAINY), F.col("month"))).alias("rainy_months"),
    )


def grid_intensity(seasonal: DataFrame) -> DataFrame:
    return seasonal.withColumn("intensity", classify.coverage_intensity("dry_months", "rainy_months", "coverage_percent", "total_distance_km"))


def month_over_years(effort: DataFrame, month: int, years: tuple[int, int]) -> DataFrame:
    rows = monthly(effort).where((F.col("month") == month) & F.col("year").between(*years))
    return rows.groupBy("grid_cell_id").agg(
        F.sum("total_distance_km").alias("total_distance_km"), F.sum("total_points").alias("total_points"), F.sum("unique_uploads").alias("unique_uploads"), F.max("coverage_percent").alias("coverage_percent")
    ).withColumn("season", classify.season(F.lit(month)))


def totals(effort: DataFrame, years: tuple[int, int] | None = None) -> DataFrame:
    rows = monthly(effort)
    if years is not None:
        rows = rows.where(F.col("year").between(*years))
    return rows.agg(
        F.count_distinct("grid_cell_id").alias("active_pixels"), F.coalesce(F.sum("total_distance_km"), F.lit(0.0)).alias("total_distance_km"),
        F.coalesce(F.sum("total_points"), F.lit(0)).alias("total_points"), F.coalesce(F.sum("unique_uploads"), F.lit(0)).alias("total_uploads"),
    )


def by_year(effort: DataFrame) -> DataFrame:
    return monthly(effort).groupBy("year").agg(F.count_distinct("grid_cell_id").alias("active_pixels"), F.sum("total_distance_km").alias("total_distance_km"))

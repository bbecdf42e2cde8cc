"""Results that combine several operators: activity, tiles of parks, place counts, and a park's figures in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acacia import schemas
from acacia.functions import geo
from acacia.operators import fires, loss, narrative, spatial


def recent_activity(uploads: DataFrame, points: DataFrame, areas: DataFrame, most: int = 10) -> DataFrame:
    """The latest uploads (upload_id, uploaded_at) with the mean of their points (upload_id, lat, lon) and the area in which it lies."""
    latest = uploads.orderBy(F.desc("uploaded_at"), F.desc("upload_id")).limit(most)
    center = points.join(latest.select("upload_id"), "upload_id", "left_semi").groupBy("upload_id").agg(F.avg("lat").alias("latitude"), F.avg("lon").alias("longitude"))
    return spatial.first_area(latest.join(center, "upload_id", "left"), areas)


def with_centroids(uploads: DataFrame, points: DataFrame) -> DataFrame:
    """All uploads with the mean of their points, null if they have none."""
    center = points.groupBy("upload_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("points"))
    return uploads.join(center, "upload_id", "left")


def park_tiles(parks: DataFrame, origin_x: float, origin_y: float, size: float) -> DataFrame:
    """Every tile that a park's box (park_id, x_min ... y_max) overlaps."""
    tiles = geo.tile_range("x_min", "y_min", "x_max", "y_max", origin_x, origin_y, size)
    return parks.select("park_id", F.inline(tiles))


def required_tiles(tiles: DataFrame, have: DataFrame) -> DataFrame:
    """Tiles that any park needs and that are not there yet."""
    return tiles.select("tile_row", "tile_col").distinct().join(have, ["tile_row", "tile_col"], "left_anti")


def overlapping(parks: DataFrame, tiles: DataFrame, cell: float) -> DataFrame:
    """Parks and tiles (boxes) that overlap by more than an edge; both are spread over square cells to meet."""

    def spread(boxes: DataFrame, prefix: str) -> DataFrame:
        named = boxes.select(*[F.col(c).alias(f"{prefix}{c}") for c in boxes.columns])
        cells = [F.explode(F.sequence(F.floor(F.col(f"{prefix}{a}_min") / cell), F.floor(F.col(f"{prefix}{a}_max") / cell))) for a in "xy"]
        return named.withColumn("cx", cells[0]).withColumn("cy", cells[1])

    met = spread(parks, "p_").join(spread(tiles, "t_"), ["cx", "cy"])
    inside = (F.col("p_x_min") < F.col("t_x_max")) & (F.col("p_x_max") > F.col("t_x_min")) & (F.col("p_y_min") < F.col("t_y_max")) & (F.col("p_y_max") > F.col("t_y_min"))
    return met.where(inside).drop("cx", "cy").distinct()


def place_counts(places: DataFrame) -> DataFrame:
    """Places and parks by type, and of all types."""
    return places.groupingSets([["place_type"], []], "place_type").agg(F.count(F.lit(1)).alias("places"), F.count_distinct("park_id").alias("parks"))


def latest_trajectories(infractions: DataFrame) -> DataFrame:
    """Each park's trajectories of the latest year that has any."""
    have = infractions.where("trajectories is not null")
    return have.groupBy("park_id").agg(F.max("year").alias("year"), F.max_by("trajectories", "year").alias("trajectories"))


def first_with_outcome(trajectories, outcome: str):
    """The first trajectory of a list with an outcome, or null."""
    return F.get(F.filter(trajectories, lambda t: t["outcome"] == outcome), F.lit(0))


def trajectories_of(document) -> Column:
    """The trajectories in a JSON document; null, and so no trajectories, where it can't be read."""
    return F.from_json(document, f"array<{schemas.TRAJECTORY_DOCUMENT}>", {"mode": "PERMISSIVE"})


def inside_or_buffer(rows: DataFrame, year: int, box: tuple[float, float, float, float]) -> DataFrame:
    """Detections of a year in any area, and those in a box that lie in none; ``inside`` tells which."""
    inside = rows.where((F.year("acq_date") == year) & (F.coalesce("area_id", F.lit("")) != ""))
    return inside.withColumn("inside", F.lit(True)).unionByName(buffer_only(rows, year, box).withColumn("inside", F.lit(False)))


def buffer_only(rows: DataFrame, year: int, box: tuple[float, float, float, float]) -> DataFrame:
    """Detections of a year in a box that lie in no area."""
    outside = F.coalesce("area_id", F.lit("")) == ""
    return rows.where((F.year("acq_date") == year) & outside & F.col("latitude").between(box[0], box[1]) & F.col("longitude").between(box[2], box[3]))


def park_stats(parks: DataFrame, infractions: DataFrame, detections: DataFrame, events: DataFrame, roadless: DataFrame, years: tuple[int, int]) -> DataFrame:
    """One row for each park: fire groups, fires, peak month, loss and roads, with the sentences they give rise to."""
    rolled = fires.infraction_rollup(infractions, years)
    total = detections.groupBy("park_id").agg(F.count(F.lit(1)).alias("total_fires"))
    out = parks.join(rolled.drop("years"), "park_id", "left").join(total, "park_id", "left").join(fires.peak_month(detections), "park_id", "left")
    out = out.join(loss.loss_summary(events), "park_id", "left").join(loss.loss_trend_by_period(events).withColumnRenamed("trend", "loss_trend"), "park_id", "left").join(roadless, "park_id", "left")
    said = narrative.fire_insights("stopped_inside", "transited", "total_groups", "avg_days_burning", "name")
    roads = F.array_compact(F.array(narrative.roadless_insight("roadless_percentage")))
    turn = F.array_compact(F.array(F.when(F.col("loss_trend") == "worsening", F.lit("⚠️ Deforestation trend is worsening - recent years show higher loss than 2015-2019.")).when(F.col("loss_trend") == "improving", F.lit("✓ Deforestation trend is improving - recent years show lower loss than 2015-2019."))))
    return out.fillna(0, ["total_fires"]).withColumn("insights", F.concat(F.coalesce(said, F.array().cast("array<string>")), roads, turn))


def river_crossings(paths: DataFrame, places: DataFrame, max_km: float = 10.0) -> DataFrame:
    """Rivers near the middle of each step of a trajectory (park_id, traj_id, seq, lat, lon), each once."""
    order = Window.partitionBy("park_id", "traj_id").orderBy("seq")
    steps = paths.withColumn("lat1", F.lead("lat").over(order)).withColumn("lon1", F.lead("lon").over(order)).where("lat1 is not null")
    middle = steps.select("park_id", "traj_id", "seq", ((F.col("lat") + F.col("lat1")) / 2).alias("lat"), ((F.col("lon") + F.col("lon1")) / 2).alias("lon"))
    near = spatial.nearest_places(middle, places, ["park_id", "traj_id", "seq"], 1, 1.0, ["river"], max_km, False, "equirect")
    return near.groupBy("park_id", "traj_id").agg(F.array_sort(F.collect_set("place_name")).alias("rivers"))

"""Patrol tracks: splits by duration, segment statistics, movement analysis and effort by grid cell."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acacia.functions import classify, geo, text

SEGMENT = ["file", "track_no", "seg_no"]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _parts(times: pd.Series, limit: pd.Series) -> pd.Series:
    """The part of each time (microseconds, null where unknown) of a row."""
    out = []
    for row, most in zip(times, limit, strict=True):
        part, since, own = 0, None, []
        for now in row:
            if now is not None and now == now:
                if since is None:
                    since = now
                elif now - since > most:
                    part, since = part + 1, now
            own.append(part)
        out.append(own)
    return pd.Series(out)


def split_by_duration(points: DataFrame, minutes: float = 30.0, key: list[str] = SEGMENT) -> DataFrame:
    """Adds ``part``: a new one begins at a point more than ``minutes`` after the first timed point of its part.

    This is no gap rule: where a part begins depends on where the last one did, so the times of one segment are
    walked in order, in one pass over a row of Arrow data. A segment is one receiver's log and fits in a row.
    """
    rest = [c for c in points.columns if c not in key]
    rows = F.array_sort(F.collect_list(F.struct("pt_no", *[c for c in rest if c != "pt_no"])))
    folded = points.groupBy(*key).agg(rows.alias("rows"))
    times = F.transform("rows", lambda p: F.unix_micros(p["ts"].cast("timestamp")))
    numbered = folded.withColumn("parts", _parts(times, F.lit(int(minutes * 60_000_000))))
    zipped = numbered.select(*key, F.explode(F.arrays_zip("rows", F.col("parts").alias("part"))).alias("x"))
    return zipped.select(*key, F.col("x.part").alias("part"), "x.rows.*")


def _steps(points: DataFrame, key: list[str]) -> DataFrame:
    """Each point with the one before it in its part."""
    order = Window.partitionBy(*key).orderBy("pt_no")
    return (
        points.withColumn("lat0", F.lag("lat").over(order)).withColumn("lon0", F.lag("lon").over(order)).withColumn("ts0", F.lag("ts").over(order))
        .withColumn("step_km", geo.haversine_km("lat0", "lon0", "lat", "lon"))
    )


def _hours(a, b) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 3_600_000_000


def segments(points: DataFrame, key: list[str]) -> DataFrame:
    """Distance, first and last time, mean speed and movement type of each part."""
    stats = _steps(points, key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("step_km"), F.lit(0.0)).alias("distance_km"),
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("pt_no"))).alias("start_time"), F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("pt_no"))).alias("end_time"),
        F.min_by(F.struct("lat", "lon"), "pt_no").alias("first_point"),
    )
    hours = _hours(F.col("start_time"), F.col("end_time"))
    speed = F.when((F.col("points") > 1) & (hours > 0), F.col("distance_km") / F.when(hours > 0, hours)).otherwise(0.0)
    return stats.withColumn("avg_speed_kmh", speed).withColumn("movement_type", classify.segment_movement("avg_speed_kmh"))


def kept_segments(stats: DataFrame) -> DataFrame:
    return stats.where("points >= 2 and distance_km >= 0.001")


def circles(bearings, window: int = 5, threshold: float = 270.0) -> Column:
    """How many windows of bearings turn by more than the threshold; after a hit the next window starts behind it."""
    b = F.col(bearings) if isinstance(bearings, str) else bearings

    def turn(i: Column) -> Column:
        change = F.abs(b[i + 1] - b[i])
        return F.when(change > 180, 360 - change).otherwise(change)

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("from"))

    def step(state: Column, i: Column) -> Column:
        total = F.aggregate(F.sequence(i, i + (window - 2)), F.lit(0.0), lambda s, j: s + turn(j))
        hit = (i >= state["from"]) & (total > threshold)
        return F.when(hit, F.struct((state["n"] + 1).alias("n"), (i + window).alias("from"))).otherwise(F.struct(state["n"].alias("n"), state["from"].alias("from")))

    return F.when(F.size(b) >= 10, F.aggregate(F.sequence(F.lit(0), F.size(b) - window), start, step)["n"]).otherwise(0)


def analysis(points: DataFrame, key: list[str]) -> DataFrame:
    """Speeds, sinuosity, circles, messages and quality of each part."""
    hours = _hours(F.col("ts0"), F.col("ts"))
    paired = F.col("lat0").isNotNull()
    steps = _steps(points, key).withColumn("speed", F.when((hours > 0) & (hours < 24), F.col("step_km") / F.when(hours > 0, hours)))
    steps = steps.withColumn("turn", F.when(paired, F.struct("pt_no", geo.bearing("lat0", "lon0", "lat", "lon").alias("b"))))
    stats = steps.groupBy(*key).agg(
        F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("step_km"), F.lit(0.0)).alias("distance_km"),
        F.coalesce(F.avg("speed"), F.lit(0.0)).alias("avg_speed_kmh"), F.coalesce(F.max("speed"), F.lit(0.0)).alias("max_speed_kmh"),
        F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["b"]).alias("bearings"),
        F.min_by(F.struct("lat", "lon"), "pt_no").alias("a"), F.max_by(F.struct("lat", "lon"), "pt_no").alias("z"),
        F.transform(F.array_sort(F.collect_list(F.when(text.own_message("description"), F.struct("pt_no", "description")))), lambda m: m["description"]).alias("all_messages"),
    ).where("points >= 2")
    direct = geo.haversine_km("a.lat", "a.lon", "z.lat", "z.lon")
    moved = F.col("distance_km") > 0
    out = stats.withColumn("sinuosity", F.when(moved & (direct > 0.1), F.col("distance_km") / F.when(direct > 0.1, direct)).otherwise(0.0))
    out = out.withColumn("is_straight", moved & (F.col("sinuosity") < 1.2)).withColumn("circles", circles("bearings"))
    out = out.withColumn("speed_category", classify.speed_category("avg_speed_kmh")).withColumn("movement_type", classify.analysis_movement("avg_speed_kmh"))
    out = out.withColumn("quality_score", classify.quality_score("speed_category", "sinuosity", "is_straight", "circles"))
    out = out.withColumn("quality", classify.quality_label("quality_score")).withColumn("message_count", F.size("all_messages"))
    return out.withColumn("messages", F.slice("all_messages", 1, 10)).drop("a", "z", "bearings", "all_messages")


def sampled(points: DataFrame, key: list[str], most: int = 1000) -> DataFrame:
    """At most ``most`` points of each key, evenly spread over it, first and last included."""
    order = Window.partitionBy(*key).orderBy("pt_no")
    numbered = points.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    # Point i is one of the picked ones if some k rounds to it; rounding is half away from zero.
    step = (F.col("n") - 1) / F.lit(float(most - 1))
    k = F.floor((F.col("i") + 0.5) / step)
    picked = F.exists(F.array(k - 1, k, k + 1), lambda j: (j >= 0) & (j <= most - 1) & (F.floor(j * step + 0.5) == F.col("i")))
    return numbered.where((F.col("n") <= most) | picked).drop("i", "n")


def cell_effort(points: DataFrame, key: list[str], movement: DataFrame) -> DataFrame:
    """Distance, points and uploads of each cell and movement type, and of each cell over all types.

    A step belongs to the cell of its midpoint and to its month. ``movement`` has key and movement_type.
    """
    steps = _steps(points, key).where("lat0 is not null").join(movement.select(*key, "movement_type"), key)
    when = F.coalesce("ts", "ts0")
    located = steps.select(
        "file", "movement_type", "step_km", geo.grid_cell_id((F.col("lat0") + F.col("lat")) / 2, (F.col("lon0") + F.col("lon")) / 2).alias("grid_cell_id"),
        F.year(when).alias("year"), F.month(when).alias("month"),
    )
    sums = located.groupingSets(
        [["grid_cell_id", "year", "month", "movement_type"], ["grid_cell_id", "year", "month"]], "grid_cell_id", "year", "month", "movement_type"
    ).agg(F.sum("step_km").alias("total_distance_km"), F.count(F.lit(1)).alias("total_points"), F.count_distinct("file").alias("unique_uploads"))
    return sums.withColumn("movement_type", F.coalesce("movement_type", F.lit("all")))


def subcell_visits(points: DataFrame) -> DataFrame:
    """One visit for each upload, subcell and day."""
    day = text.day_or_first("ts", F.coalesce(F.year("ts"), F.lit(1970)), F.coalesce(F.month("ts"), F.lit(1)))
    seen = points.select("file", geo.grid_cell_id("lat", "lon").alias("grid_cell_id"), geo.subcell_id("lat", "lon").alias("subcell_id"), day.alias("visit_date")).distinct()
    return seen.groupBy("grid_cell_id", "subcell_id", "visit_date").agg(F.count(F.lit(1)).alias("visit_count"))


def coverage(visits: DataFrame, start: str, end: str) -> DataFrame:
    """Covered subcells of each cell in a period, and their share of the cell's hundred."""
    inside = visits.where(F.col("visit_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.groupBy("grid_cell_id").agg(F.count_distinct("subcell_id").alias("covered")).withColumn("coverage_percent", F.col("covered").cast("double"))


def upload_totals(stats: DataFrame) -> DataFrame:
    """Of each file: points, distance, first and last time, and the last segment's movement type that is not empty."""
    place = F.when(F.coalesce(F.col("movement_type"), F.lit("")) != "", F.struct("track_no", "seg_no", "part"))
    return stats.groupBy("file").agg(
        F.sum("points").alias("total_points"), F.sum("distance_km").alias("total_distance_km"), F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"), F.max_by("movement_type", place).alias("movement_type"),
    )

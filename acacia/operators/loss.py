"""Forest loss, built-up pixels, settlements and roads, from pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acacia.functions import classify, geo


def zonal_built(pixels: DataFrame, least: int = 1) -> DataFrame:
    """Built-up area (values are m2) in km2 and pixels above the threshold, by park and zone."""
    on = F.col("value") >= least
    return pixels.groupBy("park_id", "zone").agg(
        (F.sum(F.when(on, F.col("value")).otherwise(0)).cast("double") / F.lit(1e6)).alias("built_up_km2"), F.count_if(on).alias("built_pixels"), F.count(F.lit(1)).alias("pixels")
    ).withColumn("built_up_percentage", F.col("built_pixels") / F.col("pixels") * 100)


def loss_by_year(pixels: DataFrame, base_year: int = 2000, years: int = 24) -> DataFrame:
    """Pixels (park_id, tile, lat, lon, code) to lost pixels and area by year code, with their centroid."""
    return pixels.where(F.col("code").between(1, years)).groupBy("park_id", "tile", (F.col("code") + base_year).alias("year")).agg(
        F.count(F.lit(1)).alias("pixel_count"), F.sum(geo.pixel_area_km2("lat")).alias("area_km2"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")
    )


def merged_tiles(stats: DataFrame) -> DataFrame:
    """Tiles of a park and year as one: sums, place and pattern of the first tile, the tiles' lists of clusters one after the other (if they have any), and the size class of the sum."""
    out = stats.groupBy("park_id", "year").agg(
        F.sum("pixel_count").alias("pixel_count"), F.sum("area_km2").alias("area_km2"), F.min_by("lat", "tile").alias("lat"), F.min_by("lon", "tile").alias("lon"), F.min_by("pattern_type", "tile").alias("pattern_type"),
        *([F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tile", "clusters"))), lambda t: t["clusters"])).alias("clusters")] if "clusters" in stats.columns else []),
    )
    return out.withColumn("event_type", classify.loss_event("area_km2"))


def component_metrics(labelled: DataFrame, by: list[str], least: int = 10, fast: bool = False) -> DataFrame:
    """Size, box, aspect, fill, centroid, sum and pattern of each component that is large enough."""
    out = labelled.groupBy(*by, "component").agg(
        F.count(F.lit(1)).alias("pixels"), (F.max("r") - F.min("r") + 1).alias("height"), (F.max("c") - F.min("c") + 1).alias("width"),
        F.avg("r").alias("center_r"), F.avg("c").alias("center_c"), F.sum("value").alias("total"),
    ).where(F.col("pixels") >= least)
    out = out.withColumn("aspect", F.greatest("height", "width") / F.least("height", "width")).withColumn("fill", F.col("pixels") / (F.col("height") * F.col("width")))
    return out.withColumn("pattern", classify.component_pattern("aspect", "fill", "pixels", fast))


def dominant_pattern(metrics: DataFrame, totals: DataFrame, by: list[str], least_pixels: int = 50) -> DataFrame:
    """The pattern with most pixels; minor below a number of lost pixels or without components. ``totals`` has by and lost."""
    votes = metrics.groupBy(*by, "pattern").agg(F.sum("pixels").alias("n"))
    best = votes.groupBy(*by).agg(F.min_by("pattern", F.struct(-F.col("n"), F.col("pattern"))).alias("best"))
    out = totals.join(best, by, "left")
    return out.select(*by, "lost", F.when(F.col("lost") < least_pixels, "minor").otherwise(F.coalesce("best", F.lit("minor"))).alias("pattern_type"))


def downsampled(pixels: DataFrame, step: int = 4) -> DataFrame:
    """Every ``step``-th row and column; ``weight`` says for how many pixels one stands."""
    return pixels.where((F.col("r") % step == 0) & (F.col("c") % step == 0)).withColumn("weight", F.lit(step * step))


def window_of(pixels: DataFrame, rows: tuple[int, int], columns: tuple[int, int], shape: tuple[int, int] | None = None) -> DataFrame:
    """A window of a raster, clamped to its shape (rows, columns) if that is given; positions are those of the raster."""
    if shape is not None:
        rows, columns = ((max(0, low), min(n - 1, high)) for (low, high), n in zip((rows, columns), shape, strict=True))
    return pixels.where(F.col("r").between(*rows) & F.col("c").between(*columns))


def loss_summary(events: DataFrame) -> DataFrame:
    """Total loss and worst year of each park; the first of equals."""
    return events.groupBy("park_id").agg(F.sum("area_km2").alias("total_loss"), F.max_by("year", F.struct("area_km2", (-F.col("year")).alias("y"))).alias("worst_year"), F.max("area_km2").alias("worst_loss"))


def loss_trend(events: DataFrame) -> DataFrame:
    """Mean of the first against the last five years; halves below ten years; nothing below five."""
    place = Window.partitionBy("park_id").orderBy("year")
    n = F.count(F.lit(1)).over(Window.partitionBy("park_id"))
    numbered = events.withColumn("i", F.row_number().over(place) - 1).withColumn("n", n)
    early_n = F.greatest(F.lit(2), F.when(F.col("n") < 10, F.floor(F.col("n") / 2)).otherwise(5))
    recent_n = F.greatest(F.lit(2), F.when(F.col("n") < 10, F.col("n") - early_n).otherwise(5))
    out = numbered.groupBy("park_id").agg(
        F.first("n").alias("years"), F.avg(F.when(F.col("i") < early_n, F.col("area_km2"))).alias("early_avg"), F.avg(F.when(F.col("i") >= F.col("n") - recent_n, F.col("area_km2"))).alias("recent_avg")
    )
    change = F.when(F.col("early_avg") > 0, (F.col("recent_avg") - F.col("early_avg")) / F.when(F.col("early_avg") > 0, F.col("early_avg")) * 100).otherwise(0.0)
    few = F.col("years") < 5
    out = out.withColumn("percent_change", F.when(few, 0.0).otherwise(change))
    trend = F.when(few, "insufficient_data").when(F.col("percent_change") > 10, "worsening").when(F.col("percent_change") < -10, "improving").otherwise("stable")
    return out.select("park_id", "years", F.when(few, 0.0).otherwise(F.col("early_avg")).alias("early_avg"), F.when(few, 0.0).otherwise(F.col("recent_avg")).alias("recent_avg"), "percent_change", trend.alias("trend"))


def loss_trend_by_period(events: DataFrame, split: int = 2020, since: int = 2015) -> DataFrame:
    """Mean from ``split`` on against the years from ``since`` to it, by a fifth."""
    recent, older = F.avg(F.when(F.col("year") >= split, F.col("area_km2"))), F.avg(F.when((F.col("year") >= since) & (F.col("year") < split), F.col("area_km2")))
    out = events.groupBy("park_id").agg(recent.alias("recent"), older.alias("older"))
    none = F.col("recent").isNull() | F.col("older").isNull()
    trend = F.when(none, "insufficient_data").when(F.col("recent") > F.col("older") * 1.2, "worsening").when(F.col("recent") < F.col("older") * 0.8, "improving").otherwise("stable")
    return out.select("park_id", trend.alias("trend"))


def cluster_spread(clusters: DataFrame, default: str = "scattered") -> DataFrame:
    """The pattern of each park's and year's clusters by their spread, else the stored pattern that is most frequent."""
    stored = clusters.where("pattern_type is not null").groupBy("park_id", "year", "pattern_type").agg(F.count(F.lit(1)).alias("n"))
    mode = stored.groupBy("park_id", "year").agg(F.min_by("pattern_type", F.struct(-F.col("n"), F.col("pattern_type"))).alias("stored"))
    spread = clusters.groupBy("park_id", "year").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("area_km2").alias("area_km2"), (F.max("lat") - F.min("lat")).alias("lat_span"), (F.max("lon") - F.min("lon")).alias("lon_span")
    )
    return spread.join(mode, ["park_id", "year"], "left").withColumn("pattern", classify.spread_pattern("clusters", "lat_span", "lon_span", "stored", F.lit(default)))


def largest_clusters(clusters: DataFrame, most: int = 5) -> DataFrame:
    order = Window.partitionBy("park_id").orderBy(F.desc("area_km2"), "year", "cluster_id")
    return clusters.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def settlement_estimates(settlements: DataFrame) -> DataFrame:
    """Adds people, households and size class to settlements (area_m2, pixels, pixel_population)."""
    out = settlements.withColumn("population_est", classify.population("pixel_population", "pixels", "area_m2"))
    return out.withColumn("households_est", classify.households("population_est")).withColumn("settlement_type", classify.settlement_size("area_m2"))


def settlement_stats(settlements: DataFrame, parks: DataFrame) -> DataFrame:
    """Settlements, people, density and conflict risk of every park (park_id, area_km2), none included."""
    n = settlements.groupBy("park_id").agg(F.count(F.lit(1)).alias("settlements"), F.coalesce(F.sum("population_est"), F.lit(0)).alias("people"), F.coalesce(F.sum("area_m2"), F.lit(0.0)).alias("built_m2"))
    out = parks.join(n, "park_id", "left").fillna(0, ["settlements", "people", "built_m2"])
    out = out.withColumn("density", F.when(F.col("area_km2") > 0, F.col("people") / F.when(F.col("area_km2") > 0, F.col("area_km2"))).otherwise(0.0))
    return out.withColumn("risk", classify.conflict_risk("settlements", "density"))


def by_quadrant(settlements: DataFrame) -> DataFrame:
    """Settlements and people by quadrant about the mean point of each park's settlements."""
    center = settlements.groupBy("park_id").agg(F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"))
    placed = settlements.join(center, "park_id").withColumn("region", geo.quadrant("lat", "lon", "center_lat", "center_lon"))
    return placed.groupBy("park_id", "region").agg(F.count(F.lit(1)).alias("settlements"), F.coalesce(F.sum("population_est"), F.lit(0)).alias("people"))


def road_stats(roads: DataFrame, parks: DataFrame, cell_km: float = 0.5, buffer_km: float = 1.0) -> DataFrame:
    """Length, density and roadless share of each park (park_id, area_km2).

    Roads (park_id, points: array of lat, lon) are walked in steps of half a cell; every cell within the
    buffer of a step is roaded. The area is right to about a cell along the buffer's edge.
    """
    legs = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(F.col("points")[i - 1].alias("q"), F.col("points")[i].alias("p")))
    steps = roads.where(F.size("points") > 1).select("park_id", F.explode(legs).alias("leg")).select("park_id", F.col("leg.p.lat").alias("lat"), F.col("leg.p.lon").alias("lon"), F.col("leg.q").alias("q"))
    steps = steps.withColumn("km", geo.haversine_km("q.lat", "q.lon", "lat", "lon"))
    length = steps.groupBy("park_id").agg(F.sum("km").alias("road_length_km"))
    n = F.ceil(F.col("km") / (cell_km / 2)).cast("int")
    walked = steps.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), n), lambda k: k / F.greatest(n, F.lit(1)))))
    walked = walked.select("park_id", (F.col("q.lat") + (F.col("lat") - F.col("q.lat")) * F.col("t")).alias("y"), (F.col("q.lon") + (F.col("lon") - F.col("q.lon")) * F.col("t")).alias("x"))
    step = cell_km / geo.KM_PER_DEGREE
    reach = int(buffer_km / cell_km) + 1
    offsets = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= (buffer_km / cell_km) ** 2]
    on = walked.select("park_id", F.floor(F.col("y") / step).alias("r"), F.floor(F.col("x") * F.cos(F.radians("y")) / step).alias("c")).distinct()
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])).alias("o")
    cells = on.select("park_id", "r", "c", near).select("park_id", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c")).distinct()
    roaded = cells.groupBy("park_id").agg((F.count(F.lit(1)) * (cell_km * cell_km)).alias("cells_km2"))
    out = parks.join(length, "park_id", "left").join(roaded, "park_id", "left").fillna(0.0, ["road_length_km", "cells_km2"])
    out = out.withColumn("roaded_area_km2", F.least("cells_km2", "area_km2")).drop("cells_km2")
    return out.withColumn("roadless_percentage", (1 - F.col("roaded_area_km2") / F.col("area_km2")) * 100).withColumn("road_density", F.col("road_length_km") / F.col("area_km2"))


def density(total: Column, area: Column) -> Column:
    return F.when(area > 0, total / F.when(area > 0, area)).otherwise(0.0)

"""Short texts about fires, forest loss and settlements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acacia.functions import geo, text
from acacia.operators import spatial

# The sentences in this module are fixed values: results have to have them word for word.

SETTLEMENTS, RIVERS = ["village", "hamlet", "town", "city"], ["river", "stream"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _nearest(points: DataFrame, places: DataFrame, types: list[str], name: str) -> DataFrame:
    found = spatial.nearest_places(points.select("point_id", "park_id", "lat", "lon"), places, ["point_id"], 1, 1.0, types)
    return found.select("point_id", F.struct("place_name", "distance_km", "place_lat", "place_lon").alias(name))


def located(points: DataFrame, places: DataFrame) -> DataFrame:
    """Points (point_id, park_id, lat, lon) with a description of where they lie."""
    out = points.join(_nearest(points, places, SETTLEMENTS, "town"), "point_id", "left").join(_nearest(points, places, RIVERS, "river"), "point_id", "left")

    def far(place: str, article: str) -> Column:
        p = F.col(place)
        heading = geo.compass_words(geo.bearing(p["place_lat"], p["place_lon"], F.col("lat"), F.col("lon")))
        return F.concat(text.fixed(p["distance_km"], 0), F.lit(" km "), heading, F.lit(f" of {article}"), p["place_name"])

    town = F.when(F.col("town.distance_km") < 5, F.concat(F.lit("near "), "town.place_name")).when(F.col("town.distance_km") < 30, far("town", ""))
    river = F.when(F.col("river.distance_km") < 3, F.concat(F.lit("along the "), "river.place_name")).when(F.col("river.distance_km") < 20, far("river", "the "))
    spot = F.concat(F.lit("at coordinates ("), text.fixed("lat", 3), F.lit("°, "), text.fixed("lon", 3), F.lit("°)"))
    known = F.concat_ws(", ", town, river)
    return out.withColumn("location", F.when(known == "", spot).otherwise(known)).drop("town", "river")


#: Sentences about a loss pattern; the year picks one.
PHRASES = {
    "scattered": (
        "The scattered pattern is consistent with smallholder agricultural expansion.",
        "Dispersed clearing suggests multiple small-scale farming operations.",
        "The diffuse pattern indicates gradual encroachment from various points.",
        "Multiple small clearings are typical of subsistence agriculture.",
    ),
    "cluster": (
        "The clustered pattern may indicate mining activity or localized clearing.",
        "Concentrated loss suggests organized clearing for commercial purposes.",
        "The tight cluster pattern is consistent with settlement expansion.",
        "Focused deforestation indicates a single major clearing event.",
    ),
    "strip": (
        "The linear pattern suggests road construction or logging track expansion.",
        "Linear clearing indicates infrastructure development or logging access.",
        "The strip pattern is consistent with road-building or utility corridors.",
    ),
    "edge": (
        "Loss concentrated along park boundaries indicates agricultural encroachment from surrounding communities.",
        "Edge-focused clearing reflects pressure from adjacent farming areas.",
        "Boundary-adjacent loss suggests expansion of neighboring settlements.",
    ),
}
LARGE_LOSS = "The significant loss area warrants investigation into underlying causes."
UNCLEAR_LOSS = "Further analysis needed to determine the cause of forest loss."


def pattern_phrase(pattern, area_km2, year) -> Column:
    out = F.when(_c(area_km2) > 5, LARGE_LOSS).otherwise(UNCLEAR_LOSS)
    for name, phrases in PHRASES.items():
        pick = F.element_at(F.array(*map(F.lit, phrases)), (_c(year) % 4 % len(phrases) + 1).cast("int"))
        out = F.when(_c(pattern) == name, pick).otherwise(out)
    return out


def trend_phrase(trend, percent) -> Column:
    trend, percent = _c(trend), _c(percent)
    tail = F.lit("% comparing recent years to earlier periods.")
    return (
        F.when(trend == "worsening", F.concat(F.lit("⚠️ TREND ALERT: Deforestation has increased by "), text.fixed(percent, 0), tail))
        .when(trend == "improving", F.concat(F.lit("✅ POSITIVE TREND: Deforestation has decreased by "), text.fixed(-percent, 0), tail))
        .when(trend == "stable", "Deforestation rates have remained relatively stable over the monitoring period.")
        .otherwise("Insufficient data to determine long-term trend.")
    )


def loss_stories(events: DataFrame, places: DataFrame) -> DataFrame:
    """A sentence on each park's and year's loss (park_id, year, area_km2, lat, lon, pattern)."""
    points = events.withColumn("point_id", F.concat_ws(":", "park_id", F.col("year").cast("string")))
    told = located(points, places)
    story = F.concat(F.lit("In "), F.col("year").cast("string"), F.lit(", "), text.fixed("area_km2", 2), F.lit(" km² of forest was lost "), "location", F.lit(". "), pattern_phrase("pattern", "area_km2", "year"))
    return told.withColumn("narrative", story)


def loss_summary(summary: DataFrame, trend: DataFrame) -> DataFrame:
    """A paragraph on each park's loss (total_loss, worst_year, worst_loss) and its trend."""
    joined = summary.join(trend, "park_id")
    told = F.concat(
        "park_id", F.lit(" has experienced "), text.fixed("total_loss", 2), F.lit(" km² of forest loss across "), F.col("years").cast("string"), F.lit(" recorded years. The worst year was "),
        F.col("worst_year").cast("string"), F.lit(" with "), text.fixed("worst_loss", 2), F.lit(" km² lost. "), trend_phrase("trend", "percent_change"),
    )
    none = F.concat(F.lit("No significant deforestation events recorded for "), "park_id", F.lit("."))
    return joined.select("park_id", F.when(F.col("total_loss") == 0, none).otherwise(told).alias("summary"))


#: What a pattern is called in an event's description.
PATTERN_NAMES = {
    "strip": "linear clearing suggesting road construction or infrastructure development",
    "cluster": "concentrated clearing suggesting mining activity or logging operation",
    "scattered": "dispersed clearing suggesting agricultural expansion or smallholder farming",
    "edge": "boundary clearing suggesting encroachment from surrounding areas",
    "minor": "minimal forest disturbance",
}


def loss_description(name, country, year, area_km2, pattern, lat, lon) -> Column:
    lat, lon = _c(lat), _c(lon)
    called = F.coalesce(F.create_map(*[F.lit(x) for kv in PATTERN_NAMES.items() for x in kv])[_c(pattern)], F.lit("forest disturbance"))
    return F.concat(
        F.lit("In "), _c(year).cast("string"), F.lit(", "), _c(name), F.lit(" ("), _c(country), F.lit(") experienced "), text.fixed(area_km2, 2), F.lit(" km² of forest loss. The pattern shows "), called,
        F.lit(". Centered at approximately "), text.fixed(F.abs(lat), 2), F.lit("°"), F.when(lat >= 0, "N").otherwise("S"), F.lit(", "), text.fixed(F.abs(lon), 2), F.lit("°"), F.when(lon >= 0, "E").otherwise("W"), F.lit(". "),
    )


def settlement_description(area_m2, people, place, km, heading, at_place: bool = False) -> Column:
    """A settlement's size and its nearest place; a place at the settlement's own spot, which it lies in no direction of, is named only with ``at_place``."""
    where = F.concat(F.lit(", "), text.fixed(km, 0), F.lit(" km "), _c(heading), F.lit(" of "), _c(place))
    named = _c(km) >= 0 if at_place else _c(km) > 0
    return F.concat(F.lit("Building cluster "), text.fixed(area_m2, 0), F.lit("m², ~"), _c(people).cast("string"), F.lit(" people"), F.coalesce(F.when(named, where), F.lit("")))


def settlement_summary(stats: DataFrame) -> DataFrame:
    """A paragraph on each park's settlements (settlements, built_m2, area_km2)."""
    some = F.concat("park_id", F.lit(" contains "), F.col("settlements").cast("string"), F.lit(" settlements with "), text.area_text("built_m2"), F.lit(" total built-up area."))
    size = F.when(
        F.col("area_km2") > 0,
        F.concat(F.lit("This "), text.fixed("area_km2", 0), F.lit(" km² protected area represents a pristine wilderness corridor with minimal direct human-wildlife interface. ")),
    ).otherwise("")
    none = F.concat(
        "park_id", F.lit(" shows no detectable human settlements within park boundaries. "), size,
        F.lit("Conservation priority: Maintain buffer zones and monitor boundary areas for encroachment. This intact habitat status is rare in the region and critical for wildlife movement corridors."),
    )
    return stats.withColumn("summary", F.when(F.col("settlements") == 0, none).otherwise(some))


def fire_summary(rollup: DataFrame, fires: DataFrame, peaks: DataFrame, period: str) -> DataFrame:
    """A paragraph on each park's fire groups of a period (rollup of infractions, fires by park, peak month)."""
    joined = rollup.join(fires, "park_id", "left").join(peaks, "park_id", "left").fillna(0, ["total_fires"])

    def n(c: str) -> Column:
        return F.col(c).cast("string")

    several = F.concat(F.lit(f"From {period}, "), "park_id", F.lit(" experienced "), n("total_fires"), F.lit(" fire detections across "), n("total_groups"), F.lit(" fire groups over "), n("years"), F.lit(" years."))
    single = F.concat(F.lit(f"In {period}, "), "park_id", F.lit(" experienced "), n("total_fires"), F.lit(" fire detections across "), n("total_groups"), F.lit(" distinct fire groups."))
    stopped = F.when(F.col("stopped_inside") > 0, F.concat(n("stopped_inside"), F.lit(" group(s) ("), text.fixed("response_rate", 0), F.lit("%) were stopped inside the park, suggesting effective ranger intervention.")))
    passed = F.when(F.col("transited") > 0, F.concat(n("transited"), F.lit(" group(s) transited through without being stopped.")))
    month = F.date_format(F.make_date(F.lit(2000), F.col("peak_month"), F.lit(1)), "MMMM")
    peak = F.when(F.col("peak_month").isNotNull(), F.concat(F.lit("Peak fire activity occurred in "), month, F.lit(".")))
    stayed = F.when(F.col("avg_days_burning") > 0, F.concat(F.lit("Fire groups burned inside the park for an average of "), text.fixed("avg_days_burning", 1), F.lit(" days.")))
    return joined.withColumn("summary", F.concat_ws(" ", F.when(F.col("years") > 1, several).otherwise(single), stopped, passed, peak, stayed))


def group_stories(response: DataFrame, places: DataFrame) -> DataFrame:
    """A story on each trajectory that was inside a park (origin, dest, entry_date, last_inside, days_inside, fires_inside, outcome)."""
    key = F.concat_ws(":", "park_id", F.col("year").cast("string"), F.col("traj_id").cast("string"))
    base = response.withColumn("story_id", key)
    ends = base.select("story_id", "park_id", F.explode(F.array(F.struct(F.lit("o").alias("e"), "origin.lat", "origin.lon"), F.struct(F.lit("d").alias("e"), "dest.lat", "dest.lon"))).alias("p"))
    spots = located(ends.select(F.concat_ws("/", "story_id", "p.e").alias("point_id"), "story_id", "park_id", F.col("p.e").alias("end"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon")), places)
    where = spots.groupBy("story_id").agg(F.max(F.when(F.col("end") == "o", F.col("location"))).alias("from_spot"), F.max(F.when(F.col("end") == "d", F.col("location"))).alias("to_spot"))
    middle = base.select("story_id", "park_id", ((F.col("origin.lat") + F.col("dest.lat")) / 2).alias("lat"), ((F.col("origin.lon") + F.col("dest.lon")) / 2).alias("lon"))
    rivers = spatial.nearest_places(middle, places, ["story_id"], 3, 1.0, ["river"]).where("distance_km < 15")
    crossed = rivers.groupBy("story_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place_rank", "place_name"))), lambda r: r["place_name"])).alias("rivers"))
    heading = F.concat(F.lit("moving "), geo.compass_described(geo.bearing(F.col("origin.lat"), F.col("origin.lon"), F.col("dest.lat"), F.col("dest.lon"))))
    start = F.concat(F.regexp_replace("from_spot", "^at coordinates ", ""), F.lit(", "), heading)
    days = F.concat(F.col("days_inside").cast("string"), F.when(F.col("days_inside") == 1, " day").otherwise(" days"))
    end = (
        F.when(F.col("outcome") == "STOPPED_INSIDE", F.concat(F.lit("Last detected "), "to_spot", F.lit(" - fire stopped, possibly due to ranger intervention.")))
        .when(F.col("outcome") == "TRANSITED", F.concat(F.lit("Exited the park "), "to_spot", F.lit(" on "), F.col("last_inside").cast("string"), F.lit(" - transited without being stopped.")))
        .otherwise(F.concat(F.lit("Last detected "), "to_spot", F.lit(".")))
    )
    river_text = F.when(F.size("rivers") > 0, F.concat(F.lit("The group crossed near the "), F.array_join("rivers", " and "), F.lit(". "))).otherwise("")
    told = base.join(where, "story_id").join(crossed, "story_id", "left").withColumn("rivers", F.coalesce("rivers", F.array().cast("array<string>")))
    story = F.concat(
        F.lit("Fire group "), (F.col("traj_id") + 1).cast("string"), F.lit(" originated "), start, F.lit(" on "), F.col("entry_date").cast("string"), F.lit(". "), river_text,
        F.lit("Burned inside the park for "), days, F.lit(" ("), F.col("fires_inside").cast("string"), F.lit(" fire detections). "), end,
    )
    return told.withColumn("narrative", story)


def path_descriptions(paths: DataFrame, places: DataFrame) -> DataFrame:
    """A description of each path (path_id, park_id, points: array of lat and lon, two or more): start, rivers, end, heading and length."""
    a, z = F.element_at("points", 1), F.element_at("points", -1)
    ends = paths.select("path_id", "park_id", F.explode(F.array(F.struct(F.lit("a").alias("e"), a["lat"].alias("lat"), a["lon"].alias("lon")), F.struct(F.lit("z").alias("e"), z["lat"].alias("lat"), z["lon"].alias("lon")))).alias("p"))
    near = spatial.nearest_places(ends.select(F.concat_ws("/", "path_id", "p.e").alias("point_id"), "path_id", "park_id", F.col("p.e").alias("e"), "p.lat", "p.lon"), places, ["point_id"], 1, 1.0, ["village", "town"], 50.0, True, "equirect")

    def of(end: str, kind: str) -> Column:
        return F.max(F.when((F.col("e") == end) & (F.col("place_type") == kind), F.struct("place_name", "distance_km")))

    towns = near.groupBy("path_id").agg(of("a", "village").alias("village"), of("a", "town").alias("town"), of("z", "village").alias("last"))
    steps = paths.select("path_id", "park_id", "points", F.explode(F.sequence(F.lit(1), F.size("points") - 1)).alias("i"))
    middle = steps.select(
        F.concat_ws("/", "path_id", F.col("i").cast("string")).alias("point_id"), "path_id", "park_id", "i",
        ((F.element_at("points", F.col("i"))["lat"] + F.element_at("points", F.col("i") + 1)["lat"]) / 2).alias("lat"), ((F.element_at("points", F.col("i"))["lon"] + F.element_at("points", F.col("i") + 1)["lon"]) / 2).alias("lon"),
    )
    rivers = spatial.nearest_places(middle, places, ["point_id"], 1, 1.0, ["river"], 10.0, False, "equirect")
    crossed = rivers.groupBy("path_id").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "place_name"))), lambda r: r["place_name"])), 1, 3).alias("rivers"))
    told = paths.join(towns, "path_id", "left").join(crossed, "path_id", "left")

    def from_(place: str) -> Column:
        return F.concat(F.lit("Fire group originated near "), F.col(f"{place}.place_name"), F.lit(" ("), text.fixed(f"{place}.distance_km", 0), F.lit("km away)"))

    spot = F.concat(F.lit("Fire group originated at coordinates ("), text.fixed(a["lat"], 3), F.lit(", "), text.fixed(a["lon"], 3), F.lit(")"))
    start = F.when(F.col("village").isNotNull(), from_("village")).when(F.col("town").isNotNull(), from_("town")).otherwise(spot)
    river = F.when(F.size("rivers") == 1, F.concat(F.lit("crossed "), F.col("rivers")[0], F.lit(" River"))).when(F.size("rivers") > 1, F.concat(F.lit("crossed "), text.listed("rivers"), F.lit(" rivers")))
    end = F.when(F.col("last").isNotNull(), F.concat(F.lit("and was last detected near "), "last.place_name"))
    y, x = (z["lat"] - a["lat"]) * geo.KM_PER_DEGREE, (z["lon"] - a["lon"]) * geo.KM_PER_DEGREE * F.cos(F.radians(a["lat"]))
    moved = F.concat(F.lit("moving "), geo.dominant_axis(a["lat"], a["lon"], z["lat"], z["lon"]), F.lit(" approximately "), text.fixed(F.sqrt(y * y + x * x), 0), F.lit("km"))
    return told.select("path_id", F.when(F.size("points") < 2, "Insufficient trajectory data").otherwise(F.concat(F.concat_ws(", ", start, river, end, moved), F.lit("."))).alias("description"))


def fire_log_message(level, fires, avg_frp, max_frp) -> Column:
    n = _c(fires)
    count = n.cast("string")
    return (
        F.when(n >= 100, F.concat(F.lit("🔥 Major fire event: "), count, F.lit(" active fires detected (avg intensity: "), text.fixed(avg_frp, 1), F.lit(" MW)")))
        .when(n >= 50, F.concat(F.lit("⚠️ Elevated fire activity: "), count, F.lit(" fires detected")))
        .when(n >= 20, F.concat(F.lit("Fire activity: "), count, F.lit(" detections")))
        .when(_c(max_frp) > 50, F.concat(F.lit("High-intensity fire detected ("), text.fixed(max_frp, 0), F.lit(" MW peak)")))
        .otherwise(F.concat(count, F.lit(" fire detections")))
    )


def roadless_insight(percent) -> Column:
    p = _c(percent)
    return (
        F.when(p >= 90, F.concat(F.lit("🌲 "), text.fixed(p, 0), F.lit("% roadless wilderness - exceptional intact habitat with minimal human access.")))
        .when(p >= 70, F.concat(F.lit("🌲 "), text.fixed(p, 0), F.lit("% roadless wilderness - good habitat connectivity.")))
        .when(p < 50, F.concat(F.lit("⚠️ Only "), text.fixed(p, 0), F.lit("% roadless - significant road network may fragment habitat.")))
    )


def fire_insights(stopped, transited, entered, avg_days, park_name) -> Column:
    """Sentences on a park's fire groups, by thresholds."""
    stopped, transited, entered, days = map(_c, (stopped, transited, entered, avg_days))
    rate = F.when(entered > 0, stopped / F.when(entered > 0, entered) * 100)
    return F.array_compact(
        F.array(
            F.when(transited > 1, F.concat(F.lit("Total: "), transited.cast("string"), F.lit(" fire groups transited through "), _c(park_name), F.lit(" without being stopped."))),
            F.when(stopped > 1, F.concat(F.lit("👍 "), stopped.cast("string"), F.lit(" groups total stopped inside - "), text.fixed(rate, 0), F.lit("% response rate."))),
            F.when(days > 7, F.concat(F.lit("🔥 Fire groups burned inside the park for an average of "), text.fixed(days, 1), F.lit(" days - indicating sustained presence."))),
            F.when(rate >= 70, F.lit("👍 High response rate suggests effective ranger patrol coverage.")).when((rate < 40) & (entered >= 5), F.lit("⚠️ Low response rate may indicate gaps in patrol coverage or resources.")),
        )
    )

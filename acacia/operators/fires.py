"""Fire analytics: counts, hotspots, fronts, trajectories inside parks, outcomes, and trends over years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acacia.functions import classify, geo


def with_enough(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows of groups that have ``least`` rows or more."""
    return rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("__n") >= least).drop("__n")


def in_period(fires: DataFrame, start: str, end: str) -> DataFrame:
    return fires.where(F.col("acq_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def period_trend(fires: DataFrame, start: str, end: str) -> DataFrame:
    """Fires of a period and of the one before, which is as long and ends the day before."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    before = F.col("acq_date").between(F.date_sub(a, F.datediff(b, a)), F.date_sub(a, 1))
    counts = fires.agg(F.count_if(F.col("acq_date").between(a, b)).alias("fires"), F.count_if(before).alias("fires_before"))
    return counts.withColumn("trend", classify.change_direction("fires", "fires_before"))


def daily_log(fires: DataFrame, days: int = 365) -> DataFrame:
    """Each park's last active days: count, mean and largest radiative power, and level."""
    daily = fires.groupBy("park_id", "acq_date").agg(F.count(F.lit(1)).alias("fires"), F.avg("frp").alias("avg_frp"), F.max("frp").alias("max_frp"))
    latest = Window.partitionBy("park_id").orderBy(F.desc("acq_date"))
    return daily.withColumn("n", F.row_number().over(latest)).where(F.col("n") <= days).drop("n").withColumn("level", classify.fire_level("fires", "max_frp"))


def peak_month(fires: DataFrame, dry_season: bool = False) -> DataFrame:
    """The month with most fires of each park, or of its dry season alone; the earliest of equals."""
    if dry_season:
        fires = fires.where(classify.dry_season_of("latitude", F.month("acq_date")))
    n = fires.groupBy("park_id", F.month("acq_date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("park_id").agg(F.max_by("month", F.struct(F.col("n"), -F.col("month"))).alias("peak_month"), F.max("n").alias("peak_fires"))


def hotspots(fires: DataFrame, least: int = 10, most: int = 10) -> DataFrame:
    """Each park's tenth-degree cells with most fires, and their share of the park's fires."""
    cells = fires.groupBy("park_id", F.round("latitude", 1).alias("lat_bucket"), F.round("longitude", 1).alias("lon_bucket")).agg(
        F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.count(F.lit(1)).alias("fires")
    )
    park = Window.partitionBy("park_id")
    order = park.orderBy(F.desc("fires"), "lat_bucket", "lon_bucket")
    ranked = cells.withColumn("park_fires", F.sum("fires").over(park)).where(F.col("fires") >= least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return ranked.withColumn("percentage", F.col("fires") / F.col("park_fires") * 100)


def weekly_front(fires: DataFrame) -> DataFrame:
    return fires.groupBy("park_id", F.weekofyear("acq_date").alias("week")).agg(F.avg("latitude").alias("avg_lat"), F.avg("longitude").alias("avg_lon"))


def front_movement(fires: DataFrame) -> DataFrame:
    """How far the front moved south from the first week to the last, in all and by day of the whole span."""
    weeks = weekly_front(fires)
    span = fires.groupBy("park_id").agg(F.datediff(F.max("acq_date"), F.min("acq_date")).alias("days"))
    ends = weeks.groupBy("park_id").agg(F.min_by("avg_lat", "week").alias("first_lat"), F.max_by("avg_lat", "week").alias("last_lat"))
    south = (F.col("first_lat") - F.col("last_lat")) * geo.KM_PER_DEGREE
    return ends.join(span, "park_id").select("park_id", south.alias("net_south_km"), (south / F.greatest(F.col("days"), F.lit(1))).alias("km_per_day"))


def monthly_stats(fires: DataFrame, months: tuple[int, ...] | None = None) -> DataFrame:
    """Fires, fires inside and their rate by month; given months appear even without fires."""
    n = fires.groupBy("park_id", F.month("acq_date").alias("month")).agg(
        F.count(F.lit(1)).alias("total_fires"), F.count_if("inside").alias("infractions"), F.avg("latitude").alias("avg_lat")
    )
    if months is not None:
        wanted = fires.select("park_id").distinct().withColumn("month", F.explode(F.array(*map(F.lit, months))))
        n = wanted.join(n, ["park_id", "month"], "left").fillna(0, ["total_fires", "infractions"])
    rate = F.when(F.col("total_fires") > 0, F.round(F.col("infractions") / F.when(F.col("total_fires") > 0, F.col("total_fires")) * 100, 1)).otherwise(0.0)
    return n.withColumn("buffer_fires", F.col("total_fires") - F.col("infractions")).withColumn("infraction_rate", rate)


def infraction_days(fires: DataFrame) -> DataFrame:
    return fires.where("inside").groupBy("park_id", "acq_date").agg(
        F.count(F.lit(1)).alias("fires"), F.sum("frp").alias("total_frp"), F.avg("latitude").alias("avg_lat"), F.avg("longitude").alias("avg_lon")
    )


def peak_day(fires: DataFrame) -> DataFrame:
    days = infraction_days(fires)
    return days.groupBy("park_id").agg(F.max_by("acq_date", F.struct(F.col("fires"), -F.unix_date("acq_date"))).alias("peak_day"), F.max("fires").alias("peak_fires"))


def with_moves(nodes: DataFrame, keys: tuple[str, ...] = ("park_id", "year", "traj_id")) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("seq")
    return nodes.withColumn("lat0", F.lag("lat").over(order)).withColumn("lon0", F.lag("lon").over(order)).withColumn("move_km", geo.equirect_km("lat0", "lon0", "lat", "lon"))


def trajectory_metrics(nodes: DataFrame, keys: tuple[str, ...] = ("park_id", "year", "traj_id")) -> DataFrame:
    """Speed, spread, net movement and type of each trajectory."""
    out = with_moves(nodes, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.sum("fires").alias("fires"), F.coalesce(F.avg("move_km"), F.lit(0.0)).alias("avg_speed"),
        F.coalesce(F.max("move_km"), F.lit(0.0)).alias("max_speed"), F.avg("spread_km").alias("avg_spread"),
        F.min_by(F.struct("lat", "lon", "acq_date"), "seq").alias("origin"), F.max_by(F.struct("lat", "lon", "acq_date"), "seq").alias("dest"),
    )
    south = (F.col("origin.lat") - F.col("dest.lat")) * geo.KM_PER_DEGREE
    east = (F.col("dest.lon") - F.col("origin.lon")) * geo.KM_PER_DEGREE
    return out.withColumn("net_south_km", south).withColumn("net_east_km", east).withColumn("kind", classify.trajectory_type("days", "avg_speed", "avg_spread", "net_south_km"))


def trajectory_response(nodes: DataFrame, keys: tuple[str, ...] = ("park_id", "year", "traj_id"), least: int = 3) -> DataFrame:
    """What became of each trajectory that was inside: entry, days, distance and speed inside, and the outcome. Nodes have ``inside``."""
    whole = Window.partitionBy(*keys)
    seq_in = F.when(F.col("inside"), F.col("seq"))
    marked = with_moves(nodes, keys).withColumn("first_in", F.min(seq_in).over(whole)).withColumn("last_in", F.max(seq_in).over(whole))
    between = (F.col("seq") > F.col("first_in")) & (F.col("seq") <= F.col("last_in"))
    after = F.col("seq") > F.col("last_in")
    node = F.struct("lat", "lon", F.col("acq_date").cast("string").alias("date"))
    path = F.struct("seq", F.col("acq_date").cast("string").alias("date"), "lat", "lon", "fires")
    out = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trajectory_days"), F.sum("fires").alias("total_fires"), F.count_if("inside").alias("days_inside"),
        F.sum(F.when(F.col("inside"), F.col("fires")).otherwise(0)).alias("fires_inside"), F.coalesce(F.sum(F.when(between, F.col("move_km"))), F.lit(0.0)).alias("distance_inside_km"),
        F.count_if(F.col("seq") < F.col("first_in")).alias("days_before"), F.count_if(after).alias("days_after"), F.count_if(after & ~F.col("inside")).alias("outside_after"),
        F.min(F.when(F.col("inside"), F.col("acq_date"))).alias("entry_date"), F.max(F.when(F.col("inside"), F.col("acq_date"))).alias("last_inside"),
        F.max("acq_date").alias("last_date"), F.min_by(node, "seq").alias("origin"), F.max_by(node, "seq").alias("dest"),
        F.array_sort(F.collect_list(path)).alias("path"),
    ).where((F.col("days_inside") > 0) & (F.col("trajectory_days") >= least))
    return (
        out.withColumn("speed_inside", F.col("distance_inside_km") / F.col("days_inside"))
        .withColumn("outcome", classify.outcome_three_way("days_after", "outside_after"))
        .withColumn("outcome_by_index", F.when(F.col("days_after") == 0, "STOPPED_INSIDE").otherwise("TRANSITED"))
        .withColumn("outcome_by_date", classify.outcome_by_date("last_inside", "last_date"))
    )


def documents(response: DataFrame, most: int = 20) -> DataFrame:
    """Each park's and year's trajectories as an array of documents, paths cut to their first points."""
    point = F.transform(F.slice("path", 1, most), lambda p: F.struct(p["date"].alias("date"), p["lat"].alias("lat"), p["lon"].alias("lon"), p["fires"].cast("int").alias("fires")))
    one = F.struct(
        "origin", "dest", F.col("entry_date").cast("string").alias("entry_date"), F.col("last_inside").cast("string").alias("last_inside"),
        F.col("days_inside").cast("int").alias("days_inside"), F.col("fires_inside").cast("int").alias("fires_inside"), "outcome", point.alias("path"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("traj_id", one.alias("document")))), lambda x: x["document"])
    return response.groupBy("park_id", "year").agg(ordered.alias("trajectories"))


def group_summary(response: DataFrame, kinds: DataFrame) -> DataFrame:
    """Of each park and year: groups, outcomes, types, and days and fires inside. Implausible groups are left out."""
    joined = response.join(kinds.select("park_id", "year", "traj_id", "kind", "avg_speed"), ["park_id", "year", "traj_id"])
    return joined.where(classify.plausible("avg_speed", "kind")).groupBy("park_id", "year").agg(
        F.count(F.lit(1)).alias("total_groups"), F.count_if(F.col("outcome") == "STOPPED_INSIDE").alias("groups_stopped_inside"),
        F.count_if(F.col("outcome") == "TRANSITED").alias("groups_transited"), F.count_if(F.col("outcome") == "STOPPED_AFTER_EXIT").alias("groups_stopped_after"),
        F.count_if(F.col("kind").startswith("transhumance")).alias("transhumance_groups"), F.count_if(F.col("kind").startswith("herder")).alias("herder_groups"),
        F.avg("days_inside").alias("avg_days_burning"), F.percentile("days_inside", F.lit(0.5)).alias("median_days_burning"),
        F.max("days_inside").alias("max_days_burning"), F.sum("fires_inside").alias("total_fires_inside"),
    )


def kind_summary(metrics: DataFrame) -> DataFrame:
    """Of each park and year: trajectories and fires of the four type families, and the herds' mean speed."""
    def family(prefix: str) -> Column:
        return F.col("kind").startswith(prefix)

    return metrics.groupBy("park_id", "year").agg(
        F.count(F.lit(1)).alias("trajectories"), F.count_if(family("transhumance")).alias("transhumance"), F.count_if(family("herder")).alias("herder"),
        F.count_if(family("management")).alias("management"), F.count_if(family("village") | family("local")).alias("village"),
        F.coalesce(F.sum(F.when(family("transhumance"), F.col("fires"))), F.lit(0)).alias("transhumance_fires"), F.avg(F.when(family("transhumance"), F.col("avg_speed"))).alias("transhumance_speed"),
    )


def infraction_rollup(infractions: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Of each park over some years with groups; the response rate is the share that was stopped inside."""
    rows = infractions.where(F.col("year").between(*years) & (F.col("total_groups") > 0))
    out = rows.groupBy("park_id").agg(
        F.count_distinct("year").alias("years"), F.sum("total_groups").alias("total_groups"), F.sum("groups_stopped_inside").alias("stopped_inside"),
        F.sum("groups_transited").alias("transited"), F.avg("avg_days_burning").alias("avg_days_burning"),
    )
    return out.withColumn("response_rate", F.col("stopped_inside") / F.col("total_groups") * 100)


def yearly_fires(infractions: DataFrame, fires: DataFrame) -> DataFrame:
    """Infractions of each park and year with the park's fires of that year, 0 if none."""
    n = fires.groupBy("park_id", F.year("acq_date").alias("year")).agg(F.count(F.lit(1)).alias("total_fires"))
    out = infractions.join(n, ["park_id", "year"], "left").fillna(0, ["total_fires"])
    return out.withColumn("response_rate", F.when(F.col("total_groups") > 0, F.col("groups_stopped_inside") / F.when(F.col("total_groups") > 0, F.col("total_groups")) * 100))


def response_trend(yearly: DataFrame) -> DataFrame:
    """Worst and best year (the first of equals), mean response rate, and direction of the later half against the earlier."""
    place = Window.partitionBy("park_id").orderBy("year")
    numbered = yearly.withColumn("i", F.row_number().over(place) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("park_id")))
    early = F.col("i") < F.floor(F.col("n") / 2)
    groups = F.when(F.col("total_groups") > 0, F.col("total_groups"))
    out = numbered.groupBy("park_id").agg(
        F.count(F.lit(1)).alias("years"), F.max_by("year", F.when(groups.isNotNull(), F.struct(groups.alias("g"), (-F.col("year")).alias("y")))).alias("worst_year"),
        F.max_by("year", F.when(groups.isNotNull(), F.struct("response_rate", (-F.col("year")).alias("y")))).alias("best_year"), F.avg("response_rate").alias("avg_response_rate"),
        F.avg(F.when(early, F.col("total_groups").cast("double"))).alias("early"), F.avg(F.when(~early, F.col("total_groups").cast("double"))).alias("recent"),
    )
    direction = F.when(F.col("years") < 3, F.lit(None).cast("string")).when(F.col("recent") > F.col("early") * 1.2, "increasing").when(F.col("recent") < F.col("early") * 0.8, "decreasing").otherwise("stable")
    return out.withColumn("trend", direction).drop("early", "recent")

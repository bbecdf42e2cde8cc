"""Registered queries of the conservation operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acacia.functions import classify, geo, projection, text
from acacia.operators.work import written
from acacia.operators import clusters, components, effort, fires, loss, marts, merge, narrative, search, spatial, tracks
from acacia.plans import views
from acacia.plans.views import view
from acacia.sources import fires as fire_sources
from acacia.sources import geodata, sinks
from acacia.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _d(*names: str) -> list:
    """Doubles of a result, rounded beyond what engines can differ in."""
    return [F.round(F.col(n), 6).alias(n) for n in names]


DET = views.cte("detections")


# --- Areas and places ----------------------------------------------------------------------------

_FLAG = f"""WITH {DET}, {views.cte("places")}, {views.IN_AREAS},
spots AS (
  SELECT area_id, round(latitude, 1) AS lat_bucket, round(longitude, 1) AS lon_bucket, avg(latitude) AS lat, avg(longitude) AS lon, count(*) AS fires,
    sum(count(*)) OVER (PARTITION BY area_id) AS area_fires
  FROM located WHERE area_id IS NOT NULL GROUP BY 1, 2, 3
),
near AS (
  SELECT s.area_id, s.lat_bucket, s.lon_bucket, p.name, row_number() OVER (PARTITION BY s.area_id, s.lat_bucket, s.lon_bucket ORDER BY {views.haversine("s.lat", "s.lon", "p.lat", "p.lon")}, p.id) AS place
  FROM spots s JOIN places p ON abs(p.lat - s.lat) <= 1 AND abs(p.lon - s.lon) <= 1 WHERE s.fires >= 10
)
SELECT area_id, lat_bucket, lon_bucket, fires, round(fires * 100e0 / CAST(area_fires AS DOUBLE), 6) AS percentage, name AS nearest_place
FROM spots LEFT JOIN (SELECT * FROM near WHERE place = 1) USING (area_id, lat_bucket, lon_bucket) WHERE fires >= 10"""


@query(_FLAG)
def flagship_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tenth-degree cells of each area have ten fires or more, their share, and the nearest named place."""
    found = spatial.first_area(view(spark, sf_dir, "detections"), views.areas(spark)).where("area_id is not null")
    key = ["area_id", "lat_bucket", "lon_bucket"]
    spots = found.groupBy("area_id", F.round("latitude", 1).alias("lat_bucket"), F.round("longitude", 1).alias("lon_bucket")).agg(
        F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.count(F.lit(1)).alias("fires")
    ).withColumn("area_fires", F.sum("fires").over(Window.partitionBy("area_id"))).where("fires >= 10")
    near = spatial.nearest_places(spots, view(spark, sf_dir, "places"), key, same_park=False, outer=True)
    return near.select(*key, "fires", F.round(F.col("fires") * 100.0 / F.col("area_fires"), 6).alias("percentage"), F.col("place_name").alias("nearest_place"))


@query(f"WITH {DET}, {views.IN_AREAS} SELECT event_id, area_id FROM located")
def area_first_match(spark, sf_dir):
    return spatial.first_area(view(spark, sf_dir, "detections"), views.areas(spark)).select("event_id", "area_id")


@query(f"WITH {DET}, {views.IN_AREAS} SELECT event_id, id AS area_id FROM strict")
def area_exact_members(spark, sf_dir):
    return spatial.all_areas(view(spark, sf_dir, "detections"), views.areas(spark)).select("event_id", "area_id")


@query(f"WITH {DET}, {views.IN_AREAS} SELECT coalesce(area_id, 'outside') AS area_id, count(*) AS points FROM located GROUP BY 1")
def area_assignment(spark, sf_dir):
    found = spatial.first_area(view(spark, sf_dir, "detections"), views.areas(spark))
    return found.groupBy(F.coalesce("area_id", F.lit("outside")).alias("area_id")).agg(F.count(F.lit(1)).alias("points"))


_WORDS = "[" + ", ".join(f"'{w}'" for w in geo.WORDS) + "]"
_LETTERS = "[" + ", ".join(f"'{w}'" for w in geo.LETTERS) + "]"
_BEARING = "(degrees(atan2(sin(radians(21.5e0 - longitude)) * cos(radians(6.25e0)), cos(radians(latitude)) * sin(radians(6.25e0)) - sin(radians(latitude)) * cos(radians(6.25e0)) * cos(radians(21.5e0 - longitude)))) + 360)"


@query(
    f"""WITH {DET} SELECT event_id, round({views.haversine("latitude", "longitude", "6.25e0", "21.5e0")}, 5) AS haversine,
  round(sqrt(power((6.25e0 - latitude) * 111, 2) + power((21.5e0 - longitude) * 111 * cos(radians((6.25e0 + latitude) / 2)), 2)), 5) AS equirect,
  round(sqrt(power(6.25e0 - latitude, 2) + power(21.5e0 - longitude, 2)) * 111, 5) AS planar,
  round(({_BEARING}) - 360 * floor(({_BEARING}) / 360), 5) AS bearing,
  {_WORDS}[CAST(floor((({_BEARING}) + 11.25) / 22.5) AS INT) % 16 + 1] AS words, {_LETTERS}[CAST(floor((({_BEARING}) + 11.25) / 22.5) AS INT) % 16 + 1] AS letters,
  printf('%.1f_%.1f', floor(latitude / 0.1e0) * 0.1e0, floor(longitude / 0.1e0) * 0.1e0) AS cell,
  round(floor(latitude / 0.1e0) * 0.1e0 + 0.05e0, 6) AS cell_lat,
  CASE WHEN latitude >= 0 THEN printf('%02dN', CAST(floor(latitude / 10) * 10 + 10 AS INT)) WHEN latitude > -10 THEN '00N' END || printf('_%03dE', CAST(floor(longitude / 10) * 10 AS INT)) AS tile,
  CAST(floor((longitude + 180) / 6) + 1 AS INT) + 32600 AS epsg, round(110.574e0 * 0.00025e0 * (111.32e0 * cos(radians(latitude)) * 0.00025e0), 10) AS pixel_km2,
  CASE WHEN 6.25e0 - latitude < -0.1e0 THEN 'southward' WHEN 6.25e0 - latitude > 0.1e0 THEN 'northward' ELSE 'stationary' END AS drift,
  CASE WHEN abs(6.25e0 - latitude) > abs(21.5e0 - longitude) THEN CASE WHEN 6.25e0 - latitude < 0 THEN 'southward' ELSE 'northward' END ELSE CASE WHEN 21.5e0 - longitude < 0 THEN 'westward' ELSE 'eastward' END END AS axis
FROM detections"""
)
def geo_scalars(spark, sf_dir):
    lat, lon, y, x = F.col("latitude"), F.col("longitude"), F.lit(6.25), F.lit(21.5)
    b = geo.bearing(lat, lon, y, x)
    return view(spark, sf_dir, "detections").select(
        "event_id", F.round(geo.haversine_km(lat, lon, y, x), 5).alias("haversine"), F.round(geo.equirect_km(lat, lon, y, x), 5).alias("equirect"), F.round(geo.planar_km(lat, lon, y, x), 5).alias("planar"),
        F.round(b, 5).alias("bearing"), geo.compass_words(b).alias("words"), geo.compass_letters(b).alias("letters"), geo.grid_cell_id(lat, lon).alias("cell"), F.round(geo.cell_center(lat), 6).alias("cell_lat"),
        geo.forest_tile(lat, lon).alias("tile"), geo.utm_epsg(lat, lon).alias("epsg"), F.round(geo.pixel_area_km2(lat), 10).alias("pixel_km2"), geo.drift(lat, y).alias("drift"), geo.dominant_axis(lat, lon, y, x).alias("axis"),
    )


_KM = views.haversine("q.latitude", "q.longitude", "p.lat", "p.lon")


@query(
    f"""WITH {DET}, {views.cte("places")}, met AS (
  SELECT event_id, p.id AS place_id, p.name AS place_name, p.place_type, {_KM} AS km FROM detections q JOIN places p ON p.park_id = q.park_id AND abs(p.lat - latitude) <= 1 AND abs(p.lon - longitude) <= 1
  WHERE p.place_type IN ('village', 'hamlet', 'town', 'city')
)
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY km, place_id) AS INT) AS place_rank, place_name, round(km, 6) AS distance_km FROM met QUALIFY place_rank <= 3"""
)
def nearest_settlements(spark, sf_dir):
    q = view(spark, sf_dir, "detections").select("event_id", "park_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    near = spatial.nearest_places(q, view(spark, sf_dir, "places"), ["event_id"], 3, 1.0, narrative.SETTLEMENTS)
    return near.select("event_id", "place_rank", "place_name", *_d("distance_km"))


@query(
    f"""WITH {DET}, {views.cte("places")}, met AS (
  SELECT event_id, p.id AS place_id, p.name AS place_name, p.place_type,
    sqrt(power((p.lat - latitude) * 111, 2) + power((p.lon - longitude) * 111 * cos(radians((p.lat + latitude) / 2)), 2)) AS km
  FROM detections q JOIN places p ON abs(p.lat - latitude) <= 1 AND abs(p.lon - longitude) <= 1
)
SELECT event_id, place_type, place_name, round(km, 6) AS distance_km FROM met WHERE km <= 50 QUALIFY row_number() OVER (PARTITION BY event_id, place_type ORDER BY km, place_id) = 1"""
)
def nearest_of_each_type(spark, sf_dir):
    q = view(spark, sf_dir, "detections").select("event_id", "park_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    near = spatial.nearest_places(q, view(spark, sf_dir, "places"), ["event_id"], 1, 1.0, None, 50.0, True, "equirect", False)
    return near.select("event_id", "place_type", "place_name", *_d("distance_km"))


# --- Fires ---------------------------------------------------------------------------------------


@query(
    f"""WITH {DET}, n AS (SELECT count(*) FILTER (acq_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-24') AS fires, count(*) FILTER (acq_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-15') AS fires_before FROM detections)
SELECT fires, fires_before, CASE WHEN fires_before > 0 AND (fires - fires_before) * 100e0 / fires_before > 10 THEN 'up' WHEN fires_before > 0 AND (fires - fires_before) * 100e0 / fires_before < -10 THEN 'down' ELSE 'stable' END AS trend FROM n"""
)
def fire_period_trend(spark, sf_dir):
    return fires.period_trend(view(spark, sf_dir, "detections"), "2024-01-16", "2024-01-24")


@query(
    f"""WITH {DET}, d AS (SELECT park_id, acq_date, count(*) AS fires, avg(frp) AS avg_frp, max(frp) AS max_frp FROM detections GROUP BY 1, 2)
SELECT park_id, acq_date, fires, round(avg_frp, 6) AS avg_frp, round(max_frp, 6) AS max_frp,
  CASE WHEN fires >= 100 THEN 'critical' WHEN fires >= 50 THEN 'warning' WHEN fires >= 20 THEN 'info' WHEN max_frp > 50 THEN 'warning' ELSE 'info' END AS level
FROM d QUALIFY row_number() OVER (PARTITION BY park_id ORDER BY acq_date DESC) <= 20"""
)
def fire_daily_log(spark, sf_dir):
    log = fires.daily_log(view(spark, sf_dir, "detections"), 20)
    return log.select("park_id", "acq_date", "fires", *_d("avg_frp", "max_frp"), "level")


@query(f"WITH {DET}, n AS (SELECT park_id, month(acq_date) AS m, count(*) AS n FROM detections GROUP BY 1, 2) SELECT park_id, CAST(arg_max(m, n * 100 - m) AS INT) AS peak_month, max(n) AS peak_fires FROM n GROUP BY 1")
def fire_peak_month(spark, sf_dir):
    return fires.peak_month(view(spark, sf_dir, "detections"))


@query(
    f"""WITH {DET}, c AS (
  SELECT park_id, round(latitude, 1) AS lat_bucket, round(longitude, 1) AS lon_bucket, avg(latitude) AS lat, avg(longitude) AS lon, count(*) AS fires, CAST(sum(count(*)) OVER (PARTITION BY park_id) AS DOUBLE) AS total FROM detections GROUP BY 1, 2, 3)
SELECT park_id, lat_bucket, lon_bucket, round(lat, 6) AS lat, round(lon, 6) AS lon, fires, round(fires / total * 100, 6) AS percentage
FROM c WHERE fires >= 10 QUALIFY row_number() OVER (PARTITION BY park_id ORDER BY fires DESC, lat_bucket, lon_bucket) <= 10"""
)
def fire_hotspots(spark, sf_dir):
    return fires.hotspots(view(spark, sf_dir, "detections")).select("park_id", "lat_bucket", "lon_bucket", *_d("lat", "lon"), "fires", *_d("percentage"))


@query(f"WITH {DET} SELECT park_id, CAST(week(acq_date) AS INT) AS week, round(avg(latitude), 6) AS avg_lat, round(avg(longitude), 6) AS avg_lon FROM detections GROUP BY 1, 2")
def fire_weekly_front(spark, sf_dir):
    return fires.weekly_front(view(spark, sf_dir, "detections")).select("park_id", "week", *_d("avg_lat", "avg_lon"))


@query(
    f"""WITH {DET}, w AS (SELECT park_id, week(acq_date) AS week, avg(latitude) AS lat FROM detections GROUP BY 1, 2),
s AS (SELECT park_id, date_diff('day', min(acq_date), max(acq_date)) AS days FROM detections GROUP BY 1)
SELECT park_id, round((arg_min(lat, week) - arg_max(lat, week)) * 111, 6) AS net_south_km, round((arg_min(lat, week) - arg_max(lat, week)) * 111 / greatest(max(days), 1), 6) AS km_per_day FROM w JOIN s USING (park_id) GROUP BY 1"""
)
def fire_front_movement(spark, sf_dir):
    return fires.front_movement(view(spark, sf_dir, "detections")).select("park_id", *_d("net_south_km", "km_per_day"))


@query(
    f"""WITH {DET}, n AS (SELECT park_id, month(acq_date) AS month, count(*) AS total, count(*) FILTER (inside) AS inside, avg(latitude) AS lat FROM detections GROUP BY 1, 2),
w AS (SELECT DISTINCT park_id, unnest([11, 12, 1, 2, 3]) AS month FROM detections)
SELECT park_id, CAST(month AS INT) AS month, coalesce(total, 0) AS total_fires, coalesce(inside, 0) AS infractions, coalesce(total, 0) - coalesce(inside, 0) AS buffer_fires, round(lat, 6) AS avg_lat,
  CASE WHEN total > 0 THEN round(inside / total * 100, 1) ELSE 0e0 END AS infraction_rate FROM w LEFT JOIN n USING (park_id, month)"""
)
def fire_monthly_stats(spark, sf_dir):
    stats = fires.monthly_stats(view(spark, sf_dir, "detections"), (11, 12, 1, 2, 3))
    return stats.select("park_id", "month", "total_fires", "infractions", "buffer_fires", *_d("avg_lat"), "infraction_rate")


@query(f"WITH {DET} SELECT park_id, acq_date, count(*) AS fires, round(sum(frp), 4) AS total_frp, round(avg(latitude), 6) AS avg_lat FROM detections WHERE inside GROUP BY 1, 2")
def fire_infraction_days(spark, sf_dir):
    return fires.infraction_days(view(spark, sf_dir, "detections")).select("park_id", "acq_date", "fires", F.round("total_frp", 4).alias("total_frp"), *_d("avg_lat"))


@query(f"WITH {DET}, n AS (SELECT park_id, acq_date, count(*) AS n FROM detections WHERE inside GROUP BY 1, 2) SELECT park_id, arg_max(acq_date, n * 100000 - date_diff('day', DATE '1970-01-01', acq_date)) AS peak_day, max(n) AS peak_fires FROM n GROUP BY 1")
def fire_peak_day(spark, sf_dir):
    return fires.peak_day(view(spark, sf_dir, "detections"))


@query(f"WITH {DET} SELECT event_id, CASE WHEN latitude > 0 THEN month(acq_date) IN (1, 2, 3, 11, 12) ELSE month(acq_date) BETWEEN 5 AND 10 END AS dry, month(acq_date) IN (11, 12, 1, 2, 3) AS herding, CASE WHEN month(acq_date) >= 11 OR month(acq_date) <= 4 THEN 'dry' ELSE 'rainy' END AS season FROM detections WHERE latitude BETWEEN 4 AND 7 AND longitude BETWEEN 20 AND 22")
def fire_seasons_in_box(spark, sf_dir):
    month = F.month("acq_date")
    rows = fire_sources.in_box(view(spark, sf_dir, "detections"), (4, 7, 20, 22))
    return rows.select("event_id", classify.dry_season_of("latitude", month).alias("dry"), classify.transhumance_season(month).alias("herding"), classify.season(month).alias("season"))


@query(
    f"""WITH {views.INFRACTIONS}, r AS (SELECT * FROM infractions WHERE year BETWEEN 1996 AND 2000 AND total_groups > 0)
SELECT park_id, count(DISTINCT year) AS years, CAST(sum(total_groups) AS BIGINT) AS total_groups, CAST(sum(groups_stopped_inside) AS BIGINT) AS stopped_inside, CAST(sum(groups_transited) AS BIGINT) AS transited,
  round(avg(avg_days_burning), 6) AS avg_days_burning, round(sum(groups_stopped_inside) / sum(total_groups) * 100, 6) AS response_rate FROM r GROUP BY 1"""
)
def infraction_rollup(spark, sf_dir):
    out = fires.infraction_rollup(views.infractions(spark, sf_dir), (1996, 2000))
    return out.select("park_id", "years", "total_groups", "stopped_inside", "transited", *_d("avg_days_burning", "response_rate"))


_YEARLY = f"""WITH {views.INFRACTIONS}, {DET}, f AS (SELECT park_id, CAST(year(acq_date) AS INT) - 24 AS year, count(*) AS n FROM detections GROUP BY 1, 2),
yearly AS (SELECT i.*, coalesce(n, 0) AS total_fires, CASE WHEN total_groups > 0 THEN groups_stopped_inside / total_groups * 100 END AS response_rate FROM infractions i LEFT JOIN f USING (park_id, year))"""


@query(_YEARLY + " SELECT park_id, year, total_groups, total_fires, round(response_rate, 6) AS response_rate FROM yearly")
def infraction_years(spark, sf_dir):
    moved = view(spark, sf_dir, "detections").withColumn("acq_date", F.add_months("acq_date", -24 * 12))
    return fires.yearly_fires(views.infractions(spark, sf_dir), moved).select("park_id", "year", "total_groups", "total_fires", *_d("response_rate"))


@query(
    _YEARLY
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY park_id ORDER BY year) - 1 AS i, count(*) OVER (PARTITION BY park_id) AS n FROM yearly),
s AS (SELECT park_id, max(n) AS years, arg_max(year, total_groups * 10000 - year) FILTER (total_groups > 0) AS worst_year, min_by(year, (-response_rate, year)) FILTER (total_groups > 0) AS best_year, avg(response_rate) AS r,
  avg(total_groups) FILTER (i < n // 2) AS early, avg(total_groups) FILTER (i >= n // 2) AS recent FROM o GROUP BY 1)
SELECT park_id, years, worst_year, best_year, round(r, 6) AS avg_response_rate, CASE WHEN years < 3 THEN NULL WHEN recent > early * 1.2e0 THEN 'increasing' WHEN recent < early * 0.8e0 THEN 'decreasing' ELSE 'stable' END AS trend FROM s"""
)
def infraction_trend(spark, sf_dir):
    out = fires.response_trend(fires.yearly_fires(views.infractions(spark, sf_dir), view(spark, sf_dir, "detections")))
    return out.select("park_id", "years", "worst_year", "best_year", *_d("avg_response_rate"), "trend")


def _nodes(spark, sf_dir, clustering=clusters.STREAMED, linking=clusters.NEAREST):
    return clusters.trajectories(clusters.daily_clusters(view(spark, sf_dir, "detections"), clustering), linking)


_CLUSTER_ROWS = """ SELECT park_id, acq_date, cid, CAST(count(*) AS INT) AS fires, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon, {} FROM clustered GROUP BY 1, 2, 3"""
_SPREAD = "round(greatest(max(latitude) - min(latitude), max(longitude) - min(longitude)) * 111e0, 6) AS spread_km"


@query(
    f"WITH RECURSIVE {DET}, {views.density_clusters(15.0, 4, 8)}"
    + _CLUSTER_ROWS.format(f"round(min(latitude), 6) AS lat_min, round(max(latitude), 6) AS lat_max, round(sum(coalesce(frp, 0)), 6) AS frp, {_SPREAD}")
)
def daily_fire_groups(spark, sf_dir):
    return clusters.daily_clusters(view(spark, sf_dir, "detections"), clusters.GROUPS).select("park_id", "acq_date", "cid", "fires", *_d("lat", "lon", "lat_min", "lat_max", "frp", "spread_km"))


@query(
    f"WITH RECURSIVE {DET}, {views.density_clusters(5.0, 3, 1)}" + _CLUSTER_ROWS.format(f"round(avg(coalesce(frp, 0)), 6) AS avg_frp, {_SPREAD}")
)
def daily_fire_clusters_streamed(spark, sf_dir):
    return clusters.daily_clusters(view(spark, sf_dir, "detections"), clusters.STREAMED).select("park_id", "acq_date", "cid", "fires", *_d("lat", "lon", "avg_frp", "spread_km"))


@query(
    f"WITH RECURSIVE {DET}, {views.density_clusters(5.0, 1, 1)} SELECT park_id, acq_date, cid, CAST(count(*) AS INT) AS fires, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon FROM clustered GROUP BY 1, 2, 3"
)
def daily_fire_clusters_linked(spark, sf_dir):
    return clusters.daily_clusters(view(spark, sf_dir, "detections"), clusters.LINKED).select("park_id", "acq_date", "cid", "fires", *_d("lat", "lon"))


@query()
def trajectories_scored(spark, sf_dir):
    nodes = _nodes(spark, sf_dir, clusters.GROUPS, clusters.SCORED)
    return fires.trajectory_metrics(nodes).select("park_id", "year", "traj_id", "days", "fires", *_d("avg_speed", "max_speed", "avg_spread", "net_south_km", "net_east_km"), "kind")


@query()
def trajectories_by_move(spark, sf_dir):
    return _nodes(spark, sf_dir, clusters.GROUPS, clusters.SCORED_BY_MOVE).select("park_id", "year", "traj_id", "seq", "acq_date", "fires", *_d("lat", "lon"))


@query()
def trajectories_day_by_day(spark, sf_dir):
    return _nodes(spark, sf_dir, clusters.LINKED, clusters.DAY_BY_DAY).select("park_id", "year", "traj_id", "seq", "acq_date", "fires", *_d("lat", "lon"))


def _response(spark, sf_dir, nodes=None):
    nodes = (_nodes(spark, sf_dir) if nodes is None else nodes).withColumnRenamed("lat", "latitude").withColumnRenamed("lon", "longitude")
    placed = spatial.first_area(nodes, views.areas(spark), buffered=False).withColumn("inside", F.col("area_id").isNotNull())
    return fires.trajectory_response(placed.withColumnRenamed("latitude", "lat").withColumnRenamed("longitude", "lon"))


@query()
def trajectory_outcomes(spark, sf_dir):
    return _response(spark, sf_dir).select("park_id", "year", "traj_id", "trajectory_days", "days_inside", "fires_inside", "days_before", "days_after", "entry_date", "last_inside", "outcome", "outcome_by_index", "outcome_by_date", *_d("distance_inside_km", "speed_inside"))


@query()
def group_infractions(spark, sf_dir):
    nodes = written(_nodes(spark, sf_dir), "nodes")  # outcomes and metrics read them
    response = _response(spark, sf_dir, nodes)
    out = fires.group_summary(response, fires.trajectory_metrics(nodes))
    documents = fires.documents(response).select("park_id", "year", F.to_json("trajectories").alias("trajectories"))
    return out.join(documents, ["park_id", "year"], "left").withColumn("avg_days_burning", F.round("avg_days_burning", 6))


@query()
def trajectory_kinds(spark, sf_dir):
    return fires.kind_summary(fires.trajectory_metrics(_nodes(spark, sf_dir, clusters.GROUPS, clusters.SCORED))).withColumn("transhumance_speed", F.round("transhumance_speed", 6))


@query(
    f"""WITH RECURSIVE {DET}, pts AS (
  SELECT *, CAST(year(acq_date) AS INT) AS year, dayofyear(acq_date) * 0.3e0 AS t, latitude * 10 AS y, longitude * 10 AS x, row_number() OVER (ORDER BY park_id, acq_date, latitude, longitude, frp, event_id) AS i
  FROM detections QUALIFY count(*) OVER (PARTITION BY park_id, year(acq_date)) >= 100
),
near AS (SELECT a.i, b.i AS j FROM pts a JOIN pts b ON a.park_id = b.park_id AND a.year = b.year AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 WHERE (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) + (a.t - b.t) * (a.t - b.t) <= 9),
core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 20),
linked AS (SELECT i, j FROM near JOIN core USING (i) JOIN (SELECT i AS j FROM core) USING (j)),
reach(i, j) AS (SELECT i, i FROM core UNION SELECT r.i, l.j FROM reach r JOIN linked l ON l.i = r.j),
label AS (SELECT i, min(j) AS first FROM reach GROUP BY i),
members AS (SELECT i, first FROM label UNION ALL SELECT n.i, min(first) FROM near n JOIN label l ON l.i = n.j WHERE n.i NOT IN (SELECT i FROM core) GROUP BY n.i),
herds AS (SELECT p.*, CAST(dense_rank() OVER (PARTITION BY park_id, year ORDER BY first) - 1 AS INT) AS herd FROM pts p JOIN members USING (i)),
daily AS (SELECT park_id, year, herd, acq_date, avg(latitude) AS lat, avg(longitude) AS lon, count(*) AS fires, count(*) FILTER (inside) AS infractions FROM herds GROUP BY ALL),
whole AS (SELECT park_id, year, herd, count(*) AS days, CAST(sum(fires) AS BIGINT) AS fires, CAST(sum(infractions) AS BIGINT) AS infractions, arg_min(lat, acq_date) AS a, arg_max(lat, acq_date) AS z,
  string_agg('[' || CAST(CAST(round(CAST(lon AS DECIMAL(18, 9)), 6) AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(round(CAST(lat AS DECIMAL(18, 9)), 6) AS DOUBLE) AS VARCHAR) || ']', ',' ORDER BY acq_date) AS line FROM daily GROUP BY ALL)
SELECT park_id, year, herd, days, fires, infractions, CASE WHEN z - a < -0.1e0 THEN 'southward' WHEN z - a > 0.1e0 THEN 'northward' ELSE 'stationary' END AS direction,
  '{{"type":"LineString","coordinates":[' || line || ']}}' AS trajectory FROM whole WHERE days >= 3"""
)
def herd_movements(spark, sf_dir):
    """Space-time clusters with their days, direction and line."""
    rows = view(spark, sf_dir, "detections").withColumn("inside", F.col("inside").cast("int"))
    members = clusters.herds(rows)
    daily = members.groupBy("park_id", "year", "herd", "acq_date").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.count(F.lit(1)).alias("fires"), F.sum("frp").alias("frp"), F.sum("inside").alias("infractions"))
    point = F.struct("acq_date", "lat", "lon")
    out = daily.groupBy("park_id", "year", "herd").agg(F.count(F.lit(1)).alias("days"), F.sum("fires").alias("fires"), F.sum("infractions").alias("infractions"), F.min(point).alias("a"), F.max(point).alias("z"), F.array_sort(F.collect_list(point)).alias("line"))

    def six(x):
        # Means of a few coordinates often lie halfway; decimals keep the sum's last bits from deciding.
        return F.round(x.cast("decimal(18, 9)"), 6).cast("double")

    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform("line", lambda p: F.array(six(p["lon"]), six(p["lat"]))).alias("coordinates")))
    return out.where("days >= 3").select("park_id", "year", "herd", "days", "fires", "infractions", geo.drift("a.lat", "z.lat").alias("direction"), line.alias("trajectory"))


# --- Patrol effort -------------------------------------------------------------------------------

EFFORT = views.cte("effort")
_MONTHLY = f"WITH {EFFORT}, m AS (SELECT * FROM effort WHERE day IS NULL AND movement_type = 'all')"


@query(
    _MONTHLY
    + """, s AS (SELECT grid_cell_id, sum(total_distance_km) AS d, CAST(sum(total_points) AS BIGINT) AS p, max(unique_uploads) AS u, max(coverage_percent) AS c,
  (SELECT string_agg(x, ',' ORDER BY x) FROM unnest(list_distinct(list(CAST(month AS VARCHAR)))) t(x)) AS months_visited, count(DISTINCT month) AS month_count,
  count(DISTINCT CASE WHEN month IN (11, 12, 1, 2, 3, 4) THEN month END) AS dry_months, count(DISTINCT CASE WHEN month BETWEEN 5 AND 10 THEN month END) AS rainy_months FROM m WHERE year BETWEEN 1996 AND 1997 GROUP BY 1)
SELECT grid_cell_id, d AS total_distance_km, p AS total_points, u AS unique_uploads, c AS coverage_percent, months_visited, month_count, dry_months, rainy_months,
  round(least(1.5e0, CASE WHEN dry_months > 0 OR rainy_months > 0 THEN (dry_months + rainy_months * 0.3e0) / 6 WHEN c > 0 THEN c / 80 ELSE d / 80 END), 6) AS intensity FROM s"""
)
def effort_by_season(spark, sf_dir):
    return effort.grid_intensity(effort.by_season(view(spark, sf_dir, "effort"), (1996, 1997))).withColumn("intensity", F.round("intensity", 6))


@query(_MONTHLY + " SELECT count(DISTINCT grid_cell_id) AS active_pixels, coalesce(sum(total_distance_km), 0) AS total_distance_km, CAST(coalesce(sum(total_points), 0) AS BIGINT) AS total_points, CAST(coalesce(sum(unique_uploads), 0) AS BIGINT) AS total_uploads FROM m")
def effort_totals(spark, sf_dir):
    return effort.totals(view(spark, sf_dir, "effort"))


@query(_MONTHLY + " SELECT CAST(year AS INT) AS year, count(DISTINCT grid_cell_id) AS active_pixels, sum(total_distance_km) AS total_distance_km FROM m GROUP BY 1")
def effort_by_year(spark, sf_dir):
    return effort.by_year(view(spark, sf_dir, "effort"))


@query(_MONTHLY + " SELECT grid_cell_id, sum(total_distance_km) AS total_distance_km, CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(unique_uploads) AS BIGINT) AS unique_uploads, max(coverage_percent) AS coverage_percent, 'rainy' AS season FROM m WHERE month = 6 AND year BETWEEN 1995 AND 1999 GROUP BY 1")
def effort_of_month(spark, sf_dir):
    return effort.month_over_years(view(spark, sf_dir, "effort"), 6, (1995, 1999))


@query(f"WITH {EFFORT}, {views.cte('cells')} SELECT upload_id, grid_cell_id, lat_center, lon_center, total_distance_km FROM effort JOIN cells ON grid_cell_id = id WHERE year BETWEEN 1996 AND 1998 AND lat_center BETWEEN 0.5 AND 1.5 AND lon_center BETWEEN 0.2 AND 2")
def effort_in_bounds(spark, sf_dir):
    out = effort.in_bounds(view(spark, sf_dir, "effort"), view(spark, sf_dir, "cells"), (0.5, 1.5, 0.2, 2.0), (1996, 1998))
    return out.select("upload_id", "grid_cell_id", "lat_center", "lon_center", "total_distance_km")


@query(f"WITH {EFFORT} SELECT grid_cell_id, CAST(year AS INT) AS year, CAST(month AS INT) AS month, CAST(day AS INT) AS day, movement_type, sum(total_distance_km) AS total_distance_km, CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(unique_uploads) AS BIGINT) AS unique_uploads FROM effort GROUP BY ALL")
def merge_effort(spark, sf_dir):
    rows = view(spark, sf_dir, "effort")
    old, new = rows.where("upload_id % 2 = 0"), rows.where("upload_id % 2 = 1")
    return merge.add_up(old, new, ["grid_cell_id", "year", "month", "day", "movement_type"], ["total_distance_km", "total_points", "unique_uploads"])


@query(f"WITH {EFFORT} SELECT grid_cell_id, CAST(year AS INT) AS year, arg_min(upload_id, (CASE WHEN upload_id % 2 = 0 THEN 0 ELSE 1 END, upload_id)) AS upload_id FROM effort GROUP BY 1, 2")
def merge_insert_new(spark, sf_dir):
    rows = view(spark, sf_dir, "effort").select("grid_cell_id", "year", "upload_id")
    key, order = ["grid_cell_id", "year"], [F.col("upload_id")]
    old = merge.insert_new(rows.limit(0), rows.where("upload_id % 2 = 0"), key, order)
    return merge.insert_new(old, rows.where("upload_id % 2 = 1"), key, order)


@query(f"WITH {EFFORT} SELECT grid_cell_id, CAST(year AS INT) AS year, arg_max(upload_id, (CASE WHEN upload_id % 2 = 1 THEN 1 ELSE 0 END, upload_id)) AS upload_id FROM effort GROUP BY 1, 2")
def merge_replace(spark, sf_dir):
    rows = view(spark, sf_dir, "effort").select("grid_cell_id", "year", "upload_id")
    key, order = ["grid_cell_id", "year"], [F.desc("upload_id")]
    old = merge.replace(rows.limit(0), rows.where("upload_id % 2 = 0"), key, order)
    return merge.replace(old, rows.where("upload_id % 2 = 1"), key, order)


# --- Tracks --------------------------------------------------------------------------------------

_STEP = views.haversine("lat0", "lon0", "lat", "lon")
_STEPS = f"WITH {views.TRACKS}, steps AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(s) OVER w AS s0 FROM track_points WINDOW w AS (PARTITION BY file ORDER BY pt_no))"


@query(
    _STEPS
    + f""", t AS (SELECT file, count(*) AS points, sum({_STEP}) AS km, (max(s) - min(s)) / 3600e0 AS h FROM steps GROUP BY 1)
SELECT file, points, round(coalesce(km, 0), 5) AS distance_km, round(CASE WHEN h > 0 THEN km / h ELSE 0 END, 5) AS avg_speed_kmh, CASE WHEN coalesce(CASE WHEN h > 0 THEN km / h END, 0) < 8 THEN 'foot' WHEN km / h <= 120 THEN 'vehicle' ELSE 'aircraft' END AS movement_type FROM t"""
)
def track_statistics(spark, sf_dir):
    out = tracks.segments(views.track_points(spark, sf_dir), ["file"])
    return out.select("file", "points", F.round("distance_km", 5).alias("distance_km"), F.round("avg_speed_kmh", 5).alias("avg_speed_kmh"), "movement_type")


@query(
    f"""WITH RECURSIVE {views.TRACKS}, walk(file, pt_no, part, since) AS (
  SELECT file, pt_no, 0, s FROM track_points WHERE pt_no = 1
  UNION ALL
  SELECT p.file, p.pt_no, CASE WHEN p.s - w.since > 1800 THEN w.part + 1 ELSE w.part END, CASE WHEN w.since IS NULL OR p.s - w.since > 1800 THEN p.s ELSE w.since END
  FROM walk w JOIN track_points p ON p.file = w.file AND p.pt_no = w.pt_no + 1
) SELECT file, pt_no, CAST(part AS INT) AS part FROM walk"""
)
def track_split(spark, sf_dir):
    return tracks.split_by_duration(views.track_points(spark, sf_dir)).select("file", "pt_no", "part")


@query(
    f"""WITH RECURSIVE {views.TRACKS}, walk(file, pt_no, part, since) AS (
  SELECT file, pt_no, 0, s FROM track_points WHERE pt_no = 1
  UNION ALL
  SELECT p.file, p.pt_no, CASE WHEN p.s - w.since > 1800 THEN w.part + 1 ELSE w.part END, CASE WHEN w.since IS NULL OR p.s - w.since > 1800 THEN p.s ELSE w.since END
  FROM walk w JOIN track_points p ON p.file = w.file AND p.pt_no = w.pt_no + 1
),
before AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(s) OVER w AS s0 FROM walk JOIN track_points USING (file, pt_no) WINDOW w AS (PARTITION BY file, part ORDER BY pt_no)),
steps AS (SELECT *, {views.haversine("lat0", "lon0", "lat", "lon")} AS km, (s - s0) / 3600e0 AS h, {views.bearing("lat0", "lon0", "lat", "lon")} AS b, row_number() OVER (PARTITION BY file, part ORDER BY pt_no) - 2 AS k FROM before),
turns AS (SELECT file, part, k, CASE WHEN abs(lead(b) OVER w - b) > 180 THEN 360 - abs(lead(b) OVER w - b) ELSE abs(lead(b) OVER w - b) END AS turn, count(*) OVER (PARTITION BY file, part) AS n FROM steps WHERE lat0 IS NOT NULL WINDOW w AS (PARTITION BY file, part ORDER BY k)),
hits AS (SELECT file, part, k FROM (SELECT *, sum(turn) OVER (PARTITION BY file, part ORDER BY k ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS total FROM turns) WHERE n >= 10 AND k <= n - 5 AND total > 270),
c1 AS (SELECT file, part, min(k) AS k FROM hits GROUP BY 1, 2), c2 AS (SELECT file, part, min(h.k) AS k FROM c1 JOIN hits h USING (file, part) WHERE h.k >= c1.k + 5 GROUP BY 1, 2),
c3 AS (SELECT file, part, min(h.k) AS k FROM c2 JOIN hits h USING (file, part) WHERE h.k >= c2.k + 5 GROUP BY 1, 2), c4 AS (SELECT file, part, min(h.k) AS k FROM c3 JOIN hits h USING (file, part) WHERE h.k >= c3.k + 5 GROUP BY 1, 2),
circled AS (SELECT file, part, CAST(count(*) AS INT) AS circles FROM (FROM c1 UNION ALL FROM c2 UNION ALL FROM c3 UNION ALL FROM c4) GROUP BY 1, 2),
a AS (SELECT file, part, count(*) AS points, coalesce(sum(km), 0) AS d, coalesce(avg(CASE WHEN h > 0 AND h < 24 THEN km / h END), 0) AS v, coalesce(max(CASE WHEN h > 0 AND h < 24 THEN km / h END), 0) AS top,
  arg_min(lat, pt_no) AS y1, arg_min(lon, pt_no) AS x1, arg_max(lat, pt_no) AS y2, arg_max(lon, pt_no) AS x2, CAST(count(*) FILTER (description NOT IN ('', 'Tracking', 'Waypoint')) AS INT) AS message_count FROM steps GROUP BY 1, 2 HAVING count(*) >= 2),
m AS (SELECT *, CASE WHEN d > 0 AND direct > 0.1e0 THEN d / direct ELSE 0e0 END AS bend FROM (SELECT *, {views.haversine("y1", "x1", "y2", "x2")} AS direct FROM a)),
c AS (SELECT m.*, d > 0 AND bend < 1.2e0 AS is_straight, coalesce(circles, 0) AS circles, CASE WHEN v < 1 THEN 'stationary' WHEN v < 3 THEN 'slow_patrol' WHEN v < 6 THEN 'fast_patrol' WHEN v < 30 THEN 'slow_vehicle' WHEN v < 80 THEN 'fast_vehicle' WHEN v < 150 THEN 'low_altitude' ELSE 'high_altitude' END AS speed_category FROM m LEFT JOIN circled USING (file, part)),
q AS (SELECT *, CAST(greatest(0, least(100, 50 + CASE speed_category WHEN 'slow_patrol' THEN 30 WHEN 'fast_patrol' THEN 20 WHEN 'slow_vehicle' THEN 15 WHEN 'fast_vehicle' THEN 5 WHEN 'low_altitude' THEN 20 WHEN 'high_altitude' THEN -10 ELSE 0 END
  + CASE WHEN bend > 2 THEN 15 WHEN bend > 1.5e0 THEN 10 WHEN is_straight THEN -15 ELSE 0 END + 3 * circles)) AS DOUBLE) AS quality_score FROM c)
SELECT file, CAST(part AS INT) AS part, points, round(d, 6) AS distance_km, round(v, 6) AS avg_speed_kmh, round(top, 6) AS max_speed_kmh, round(bend, 6) AS sinuosity, is_straight, circles, speed_category, CASE WHEN v < 6 THEN 'foot' WHEN v < 80 THEN 'vehicle' ELSE 'aircraft' END AS movement_type,
  quality_score, CASE WHEN quality_score >= 80 THEN 'excellent' WHEN quality_score >= 60 THEN 'good' WHEN quality_score >= 40 THEN 'moderate' ELSE 'poor' END AS quality, message_count FROM q"""
)
def track_analysis(spark, sf_dir):
    parts = tracks.split_by_duration(views.track_points(spark, sf_dir))
    return tracks.analysis(parts, ["file", "part"]).select("file", "part", "points", *_d("distance_km", "avg_speed_kmh", "max_speed_kmh", "sinuosity"), "is_straight", "circles", "speed_category", "movement_type", "quality_score", "quality", "message_count")


_CELL = "printf('%.1f_%.1f', floor((lat0 + lat) / 2 / 0.1e0) * 0.1e0, floor((lon0 + lon) / 2 / 0.1e0) * 0.1e0)"


@query(
    _STEPS
    + f""", m AS (SELECT file, CASE WHEN sum({_STEP}) / ((max(s) - min(s)) / 3600e0) < 8 THEN 'foot' WHEN sum({_STEP}) / ((max(s) - min(s)) / 3600e0) <= 120 THEN 'vehicle' ELSE 'aircraft' END AS movement_type FROM steps GROUP BY 1),
c AS (SELECT file, movement_type, {_CELL} AS grid_cell_id, {_STEP} AS km, CAST(year(to_timestamp(coalesce(s, s0))) AS INT) AS year, CAST(month(to_timestamp(coalesce(s, s0))) AS INT) AS month FROM steps JOIN m USING (file) WHERE lat0 IS NOT NULL)
SELECT grid_cell_id, year, month, coalesce(movement_type, 'all') AS movement_type, round(sum(km), 5) AS total_distance_km, count(*) AS total_points, count(DISTINCT file) AS unique_uploads FROM c GROUP BY GROUPING SETS ((grid_cell_id, year, month, movement_type), (grid_cell_id, year, month))"""
)
def track_cell_effort(spark, sf_dir):
    points = views.track_points(spark, sf_dir)
    return tracks.cell_effort(points, ["file"], tracks.segments(points, ["file"])).withColumn("total_distance_km", F.round("total_distance_km", 5))


@query(
    f"""WITH {views.TRACKS}, t AS (SELECT file, pt_no - 1 AS i, count(*) OVER (PARTITION BY file) AS n, pt_no FROM track_points),
k AS (SELECT DISTINCT file, CAST(floor(j * (n - 1) / 99e0 + 0.5e0) AS BIGINT) AS i FROM (SELECT DISTINCT file, n FROM t), range(100) r(j))
SELECT file, pt_no FROM t JOIN k USING (file, i)"""
)
def track_sample(spark, sf_dir):
    return tracks.sampled(views.track_points(spark, sf_dir), ["file"], 100).select("file", "pt_no")


@query(
    f"""WITH {views.TRACKS}, seen AS (
  SELECT DISTINCT file, printf('%.1f_%.1f', floor(lat / 0.1e0) * 0.1e0, floor(lon / 0.1e0) * 0.1e0) AS grid_cell_id,
    concat(CAST(greatest(0, least(9, CAST(floor((lat - floor(lat / 0.1e0) * 0.1e0) / 0.01e0) AS INT))) AS VARCHAR), '_', CAST(greatest(0, least(9, CAST(floor((lon - floor(lon / 0.1e0) * 0.1e0) / 0.01e0) AS INT))) AS VARCHAR)) AS subcell_id,
    coalesce(CAST(to_timestamp(s) AS DATE), DATE '1970-01-01') AS visit_date FROM track_points
),
v AS (SELECT grid_cell_id, subcell_id, visit_date, count(*) AS visit_count FROM seen GROUP BY ALL),
c AS (SELECT grid_cell_id, count(DISTINCT subcell_id) AS covered FROM v WHERE visit_date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' GROUP BY 1)
SELECT grid_cell_id, subcell_id, visit_date, visit_count, covered, CAST(covered AS DOUBLE) AS coverage_percent FROM v LEFT JOIN c USING (grid_cell_id)"""
)
def track_subcell_visits(spark, sf_dir):
    visits = tracks.subcell_visits(views.track_points(spark, sf_dir))
    return visits.join(tracks.coverage(visits, "2024-01-01", "2024-12-31"), "grid_cell_id", "left")


# --- Forest loss and settlements -----------------------------------------------------------------

PIX = views.cte("pixels")


@query(
    f"""WITH {PIX} SELECT park_id, zone, CAST(sum(CASE WHEN value >= 20 THEN value ELSE 0 END) AS DOUBLE) / 1e6 AS built_up_km2, count(*) FILTER (value >= 20) AS built_pixels, count(*) AS pixels,
  round(count(*) FILTER (value >= 20) / count(*) * 100, 6) AS built_up_percentage FROM pixels GROUP BY 1, 2"""
)
def zonal_built_up(spark, sf_dir):
    return loss.zonal_built(view(spark, sf_dir, "pixels"), 20).withColumn("built_up_percentage", F.round("built_up_percentage", 6))


@query(
    f"""WITH {PIX}, t AS (SELECT park_id, tile, code + 2000 AS year, count(*) AS n, sum(110.574e0 * 0.00025e0 * (111.32e0 * cos(radians(lat)) * 0.00025e0)) AS km2, avg(lat) AS lat FROM pixels WHERE code BETWEEN 1 AND 24 GROUP BY 1, 2, 3)
SELECT park_id, CAST(year AS INT) AS year, CAST(sum(n) AS BIGINT) AS pixel_count, round(sum(km2), 8) AS area_km2, round(arg_min(lat, tile), 6) AS lat, CASE WHEN sum(km2) > 10 THEN 'major' WHEN sum(km2) > 1 THEN 'moderate' ELSE 'minor' END AS event_type FROM t GROUP BY 1, 2"""
)
def loss_events(spark, sf_dir):
    tiles = loss.loss_by_year(view(spark, sf_dir, "pixels")).withColumn("pattern_type", F.lit("scattered"))
    return loss.merged_tiles(tiles).select("park_id", "year", "pixel_count", F.round("area_km2", 8).alias("area_km2"), *_d("lat"), "event_type")


_COMPONENTS = f"""WITH RECURSIVE {PIX}, p AS (SELECT r, c, value, r * 1000 + c AS n FROM pixels WHERE value > 30),
reach(n, m) AS (SELECT n, n FROM p UNION SELECT a.n, b.n FROM reach x JOIN p a ON a.n = x.n JOIN p y ON y.n = x.m JOIN p b ON abs(b.r - y.r) + abs(b.c - y.c) = 1),
labelled AS (SELECT n, min(m) AS root FROM reach GROUP BY 1)"""


@query(
    _COMPONENTS
    + """ SELECT root AS first_pixel, count(*) AS pixels, CAST(max(r) - min(r) + 1 AS INT) AS height, CAST(max(c) - min(c) + 1 AS INT) AS width, CAST(sum(value) AS BIGINT) AS total FROM labelled JOIN p USING (n) GROUP BY 1 HAVING count(*) >= 3"""
)
def pixel_components(spark, sf_dir):
    """Edge-connected components of the raster, labelled in blocks and joined across their borders."""
    grid = view(spark, sf_dir, "pixels").where("value > 30").select(F.lit("all").alias("park_id"), "r", "c", "value")
    labelled = components.large_raster(grid, ["park_id"], 16)
    first = labelled.groupBy("component").agg(F.min(F.col("r") * 1000 + F.col("c")).alias("first_pixel"))
    return loss.component_metrics(labelled, ["park_id"], 3).join(first, "component").select("first_pixel", "pixels", "height", "width", "total")


@query(
    f"""WITH RECURSIVE {PIX}, p AS (SELECT park_id, tile, CAST(code % 3 + 2020 AS INT) AS year, r, c, row_number() OVER () AS n FROM pixels WHERE code > 0),
touch AS (SELECT a.n, b.n AS m FROM p a JOIN p b ON a.park_id = b.park_id AND a.tile = b.tile AND a.year = b.year AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
reach(n, m) AS (SELECT n, n FROM p UNION SELECT x.n, t.m FROM reach x JOIN touch t ON t.n = x.m),
k AS (SELECT park_id, tile, year, count(*) AS pixels, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM (SELECT n, min(m) AS root FROM reach GROUP BY 1) JOIN p USING (n) GROUP BY park_id, tile, year, root HAVING count(*) >= 3),
v AS (SELECT park_id, tile, year, CASE WHEN greatest(h, w) / least(h, w) > 5 THEN 'strip' WHEN pixels / (h * w) > 0.5e0 AND pixels > 100 THEN 'cluster' ELSE 'scattered' END AS pattern, sum(pixels) AS n FROM k GROUP BY ALL),
b AS (SELECT park_id, tile, year, pattern FROM v QUALIFY row_number() OVER (PARTITION BY park_id, tile, year ORDER BY n DESC, pattern) = 1),
t AS (SELECT park_id, tile, year, count(*) AS lost FROM p GROUP BY ALL)
SELECT park_id, tile, year, lost, CASE WHEN lost < 50 THEN 'minor' ELSE coalesce(pattern, 'minor') END AS pattern_type FROM t LEFT JOIN b USING (park_id, tile, year)"""
)
def loss_patterns(spark, sf_dir):
    lost = view(spark, sf_dir, "pixels").where("code > 0").withColumn("year", F.col("code") % 3 + 2020)
    by = ["park_id", "tile", "year"]
    labelled = components.large_raster(lost.select(*by, "r", "c", "value"), by, corners=True)
    totals = lost.groupBy(*by).agg(F.count(F.lit(1)).alias("lost"))
    return loss.dominant_pattern(loss.component_metrics(labelled, by, 3), totals, by)


@query(f"WITH {views.LOSSES} SELECT park_id, sum(area_km2) AS total_loss, arg_max(year, area_km2 * 1e6 - year) AS worst_year, max(area_km2) AS worst_loss FROM losses GROUP BY 1")
def loss_summary(spark, sf_dir):
    return loss.loss_summary(views.losses(spark, sf_dir))


@query(
    f"""WITH {views.LOSSES}, o AS (SELECT *, row_number() OVER (PARTITION BY park_id ORDER BY year) - 1 AS i, count(*) OVER (PARTITION BY park_id) AS n FROM losses),
e AS (SELECT *, greatest(2, CASE WHEN n < 10 THEN n // 2 ELSE 5 END) AS en FROM o), x AS (SELECT *, greatest(2, CASE WHEN n < 10 THEN n - en ELSE 5 END) AS rn FROM e),
s AS (SELECT park_id, max(n) AS years, avg(area_km2) FILTER (i < en) AS a, avg(area_km2) FILTER (i >= n - rn) AS b FROM x GROUP BY 1),
c AS (SELECT *, CASE WHEN years < 5 THEN 0 WHEN a > 0 THEN (b - a) / a * 100 ELSE 0 END AS p FROM s)
SELECT park_id, years, round(CASE WHEN years < 5 THEN 0 ELSE a END, 6) AS early_avg, round(CASE WHEN years < 5 THEN 0 ELSE b END, 6) AS recent_avg, round(p, 6) AS percent_change,
  CASE WHEN years < 5 THEN 'insufficient_data' WHEN p > 10 THEN 'worsening' WHEN p < -10 THEN 'improving' ELSE 'stable' END AS trend FROM c"""
)
def loss_trend(spark, sf_dir):
    return loss.loss_trend(views.losses(spark, sf_dir)).select("park_id", "years", *_d("early_avg", "recent_avg", "percent_change"), "trend")


@query(
    f"""WITH {views.LOSSES}, s AS (SELECT park_id, avg(area_km2) FILTER (year >= 2020) AS a, avg(area_km2) FILTER (year BETWEEN 2015 AND 2019) AS b FROM losses GROUP BY 1)
SELECT park_id, CASE WHEN a IS NULL OR b IS NULL THEN 'insufficient_data' WHEN a > b * 1.2e0 THEN 'worsening' WHEN a < b * 0.8e0 THEN 'improving' ELSE 'stable' END AS trend FROM s"""
)
def loss_trend_by_period(spark, sf_dir):
    return loss.loss_trend_by_period(views.losses(spark, sf_dir))


_CLUSTERS = "k AS (SELECT concat('p', CAST(p_partkey % 5 AS VARCHAR)) AS park_id, CAST(2010 + p_size AS INT) AS year, p_partkey AS cluster_id, CAST(p_retailprice AS DOUBLE) / 1000e0 AS area_km2, CAST(p_partkey * 7 % 64 AS DOUBLE) / 64e0 AS lat, CAST(p_partkey * 11 % 64 AS DOUBLE) / 16e0 AS lon, CASE WHEN p_partkey % 3 = 0 THEN 'edge' WHEN p_partkey % 3 = 1 THEN 'strip' END AS pattern_type FROM part)"


def _loss_clusters(spark, sf_dir):
    return views.read(spark, sf_dir, "part").selectExpr(
        "concat('p', CAST(p_partkey % 5 AS STRING)) AS park_id", "2010 + p_size AS year", "p_partkey AS cluster_id", "p_retailprice / 1000e0 AS area_km2", "CAST(p_partkey * 7 % 64 AS DOUBLE) / 64e0 AS lat",
        "CAST(p_partkey * 11 % 64 AS DOUBLE) / 16e0 AS lon", "CASE WHEN p_partkey % 3 = 0 THEN 'edge' WHEN p_partkey % 3 = 1 THEN 'strip' END AS pattern_type",
    )


@query(
    f"""WITH {_CLUSTERS}, m AS (SELECT park_id, year, pattern_type AS stored FROM (SELECT park_id, year, pattern_type, row_number() OVER (PARTITION BY park_id, year ORDER BY count(*) DESC, pattern_type) AS i FROM k WHERE pattern_type IS NOT NULL GROUP BY 1, 2, 3) WHERE i = 1),
s AS (SELECT park_id, year, count(*) AS n, max(lat) - min(lat) AS y, max(lon) - min(lon) AS x FROM k GROUP BY 1, 2)
SELECT park_id, year, n AS clusters, CASE WHEN n = 1 THEN 'cluster' WHEN y > 0 AND x > 0 AND greatest(x, y) / least(x, y) > 3 THEN 'strip' WHEN y * x > 0 AND n / (y * x * 111 * 111) > 0.5e0 THEN 'cluster' WHEN n > 5 THEN 'scattered' ELSE coalesce(stored, 'scattered') END AS pattern
FROM s LEFT JOIN m USING (park_id, year)"""
)
def loss_spread_patterns(spark, sf_dir):
    return loss.cluster_spread(_loss_clusters(spark, sf_dir)).select("park_id", "year", "clusters", "pattern")


@query(f"WITH {_CLUSTERS} SELECT park_id, year, cluster_id, round(area_km2, 6) AS area_km2 FROM k QUALIFY row_number() OVER (PARTITION BY park_id ORDER BY area_km2 DESC, year, cluster_id) <= 5")
def loss_largest_clusters(spark, sf_dir):
    return loss.largest_clusters(_loss_clusters(spark, sf_dir)).select("park_id", "year", "cluster_id", *_d("area_km2"))


SET = views.cte("settlements", "parks")


@query(
    f"""WITH {SET}, e AS (SELECT id, area_m2, CAST(round(CASE WHEN pixel_population > 0 THEN pixel_population * pixels ELSE area_m2 / 50e0 * 5.2e0 END) AS BIGINT) AS p FROM settlements)
SELECT id, p AS population_est, CAST(round(p / 5.2e0) AS BIGINT) AS households_est, CASE WHEN area_m2 < 200 THEN 'temporary' WHEN area_m2 < 1000 THEN 'small' WHEN area_m2 < 5000 THEN 'medium' ELSE 'large' END AS settlement_type FROM e"""
)
def settlement_estimates(spark, sf_dir):
    return loss.settlement_estimates(view(spark, sf_dir, "settlements").drop("population_est")).select("id", "population_est", "households_est", "settlement_type")


@query(
    f"""WITH {SET}, s AS (SELECT p.park_id, count(s.id) AS settlements, CAST(coalesce(sum(population_est), 0) AS BIGINT) AS people, max(area_km2) AS km2 FROM parks p LEFT JOIN settlements s USING (park_id) GROUP BY 1),
d AS (SELECT *, CASE WHEN km2 > 0 THEN people / km2 ELSE 0e0 END AS density FROM s)
SELECT park_id, settlements, people, round(density, 6) AS density, CASE WHEN settlements = 0 THEN 'minimal' WHEN density > 50 THEN 'critical' WHEN density > 20 OR settlements > 50 THEN 'high' WHEN density > 5 OR settlements > 20 THEN 'moderate' ELSE 'low' END AS risk FROM d"""
)
def settlement_risk(spark, sf_dir):
    out = loss.settlement_stats(view(spark, sf_dir, "settlements"), view(spark, sf_dir, "parks"))
    return out.select("park_id", "settlements", "people", *_d("density"), "risk")


@query(
    f"""WITH {SET}, c AS (SELECT park_id, avg(lat) AS a, avg(lon) AS b FROM settlements GROUP BY 1)
SELECT park_id, CASE WHEN lat >= a THEN 'North' ELSE 'South' END || CASE WHEN lon >= b THEN 'east' ELSE 'west' END AS region, count(*) AS settlements, CAST(sum(population_est) AS BIGINT) AS people FROM settlements JOIN c USING (park_id) GROUP BY 1, 2"""
)
def settlement_quadrants(spark, sf_dir):
    return loss.by_quadrant(view(spark, sf_dir, "settlements"))


# --- Knowledge, search and files -----------------------------------------------------------------


def _works(spark, sf_dir):
    return views.read(spark, sf_dir, "documents").select(
        F.concat(F.lit("pa"), (F.col("doc_id") % 7).cast("string")).alias("pa_id"), F.col("doc_id").alias("openalex_id"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("abstract"),
        (2000 + F.col("doc_id") % 25).cast("int").alias("year"), (F.col("n_chars") % 50).alias("cited_by_count"),
    )


_WORKS = "works AS (SELECT concat('pa', CAST(doc_id % 7 AS VARCHAR)) AS pa_id, doc_id AS openalex_id, substr(text, 1, 60) AS title, text AS abstract, CAST(2000 + doc_id % 25 AS INT) AS year, n_chars % 50 AS cited_by_count FROM documents)"


@query(f"WITH {_WORKS} SELECT pa_id, openalex_id, year, cited_by_count, CAST(row_number() OVER (PARTITION BY pa_id ORDER BY year DESC, cited_by_count DESC, openalex_id) AS INT) AS place FROM works QUALIFY place <= 50")
def publications_by_park(spark, sf_dir):
    return search.publications(_works(spark, sf_dir)).select("pa_id", "openalex_id", "year", "cited_by_count", "place")


@query(f"WITH {_WORKS} SELECT pa_id, openalex_id FROM works WHERE lower(title) LIKE '%license%' OR lower(abstract) LIKE '%license%'")
def publications_about_park(spark, sf_dir):
    works = _works(spark, sf_dir)
    parks = works.select(F.col("pa_id").alias("id")).distinct().withColumn("name", F.lit("License National Park"))
    return search.relevant_works(works, parks).select("pa_id", "openalex_id")


@query(f"WITH {_WORKS} SELECT pa_id, title, min(openalex_id) AS id FROM works GROUP BY 1, 2")
def documents_first_of_title(spark, sf_dir):
    rows = _works(spark, sf_dir).withColumnRenamed("openalex_id", "id")
    return search.first_of_title(rows).select("pa_id", "title", "id")


def _abstracts(docs: DataFrame) -> DataFrame:
    """doc_id and the text of each document's inverted index, which is made inside the document's row; no text gives null.

    Files may have few parts, so that documents are dealt to all tasks first; nothing else is shuffled.
    """
    dealt = docs.select("doc_id", "text").repartition(F.xxhash64("doc_id", "text"))
    return dealt.select("doc_id", F.when(F.col("text").isNotNull(), text.abstract_text(text.inverted_index("text"), 1000)).alias("abstract"))


@query()
def abstracts_of_documents(spark, sf_dir):
    """Every document as an inverted index and back; over 1,000 bytes it is cut there and marked, and without text it is empty.

    SQL has no byte cut inside a character, so that a unit test compares it with brute force.
    """
    return _abstracts(views.read(spark, sf_dir, "documents")).select("doc_id", F.coalesce("abstract", F.lit("")).alias("abstract"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(t)) > 1000 THEN NULL ELSE t END AS abstract FROM (SELECT doc_id, array_to_string(string_split(text, ' '), ' ') AS t FROM documents)")
def abstract_round_trip(spark, sf_dir):
    """Every document as an inverted index and back; long ones, null here, come whole from ``abstracts_of_documents``."""
    out = _abstracts(views.read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.when(F.octet_length("abstract") > 1000, F.lit(None).cast("string")).otherwise(F.col("abstract")).alias("abstract"))


@query("WITH a AS (SELECT 'area' AS kind, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier WHERE contains(lower(s_name), '#00000001') ORDER BY s_suppkey LIMIT 15) SELECT * FROM a UNION ALL (SELECT 'index', CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE contains(lower(c_name), '#00000001') AND c_custkey NOT IN (SELECT s_suppkey FROM supplier) ORDER BY c_custkey LIMIT 25)")
def area_search(spark, sf_dir):
    loaded = views.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_suppkey").cast("string").alias("wdpa_id"), F.col("s_name").alias("name"), F.lit("").alias("country"))
    index = views.read(spark, sf_dir, "customer").select(F.format_string("%d", "c_custkey").alias("wdpa_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("n")).drop("n")
    nation, region = views.read(spark, sf_dir, "nation"), views.read(spark, sf_dir, "region")
    countries = nation.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    regions = region.select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), F.lit("").alias("country"))
    index = index.withColumn("wdpa_id", F.col("wdpa_id"))
    return search.areas("#00000001", loaded, countries, regions, index)


@query("SELECT concat('pa', CAST(o_custkey % 4 AS VARCHAR)) AS pa_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus = 'O') AS in_progress, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1")
def checklist_counts(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("pending")
    rows = views.read(spark, sf_dir, "orders").select(F.concat(F.lit("pa"), (F.col("o_custkey") % 4).cast("string")).alias("pa_id"), status.alias("status"))
    return search.checklist_counts(rows)


@query("SELECT p.pa AS pa_id, r_name AS item_id, coalesce(s.status, 'pending') AS status FROM (SELECT DISTINCT concat('pa', CAST(n_nationkey AS VARCHAR)) AS pa FROM nation) p, region LEFT JOIN (SELECT concat('pa', CAST(n_nationkey AS VARCHAR)) AS pa, n_regionkey, n_name AS status FROM nation) s ON s.pa = p.pa AND s.n_regionkey = r_regionkey")
def checklist_items(spark, sf_dir):
    nation, region = views.read(spark, sf_dir, "nation"), views.read(spark, sf_dir, "region")
    schema = region.select(F.lit("legal").alias("category"), F.col("r_name").alias("item_id"))
    status = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("pa"), F.col("n_nationkey").cast("string")).alias("pa_id"), F.col("r_name").alias("item_id"), F.col("n_name").alias("status"))
    return search.checklist(schema, status).select("pa_id", "item_id", "status")


_LINES = f"WITH {DET} SELECT event_id, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude, acq_date, printf('%04d', CAST(hour(ts) AS INT) * 100 + CAST(minute(ts) AS INT)) AS acq_time, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 90 AS DOUBLE) END AS frp FROM detections WHERE event_id % 9 <> 0"


@query(_LINES)
def detection_lines(spark, sf_dir):
    """Detections as raw lines and back: blanks, short lines, and times without leading zeros."""
    rows = view(spark, sf_dir, "detections")
    time = (F.hour("ts") * 100 + F.minute("ts")).cast("string")
    frp = F.when(F.col("event_id") % 5 == 0, "").otherwise((F.col("event_id") % 90).cast("string"))
    fields = [F.round("latitude", 4).cast("string"), F.round("longitude", 4).cast("string"), F.lit("330.1"), F.lit("0.4"), F.lit("0.4"), F.col("acq_date").cast("string"), time, F.lit("N"), F.lit("VIIRS"), F.lit("n"), F.col("event_id").cast("string"), F.lit("290"), frp, F.lit("D")]
    whole, short = F.concat_ws(",", *fields), F.concat_ws(",", *fields[:13])
    lines = rows.select(F.when(F.col("event_id") % 9 == 0, short).otherwise(whole).alias("value"))
    return fire_sources.read_lines(lines).select(F.col("version").cast("long").alias("event_id"), "latitude", "longitude", "acq_date", "acq_time", "frp")


@query("SELECT p_partkey, CAST(p_partkey % 18 AS INT) AS tile_row, CAST(p_size AS INT) AS tile_col, 'BUILT_S' AS product, 100 AS resolution, 'Dem_Rep_' || CAST(p_size AS VARCHAR) AS country FROM part")
def file_names(spark, sf_dir):
    """Tile numbers, products and countries from file names."""
    rows = views.read(spark, sf_dir, "part").select(
        "p_partkey", F.format_string("in/GHS_BUILT_S_E2020_54009_100_V1_0_R%d_C%d.zip", F.col("p_partkey") % 18, F.col("p_size")).alias("name"), F.format_string("2023/viirs_2023_Dem_Rep_%d.csv", "p_size").alias("path")
    )
    index = geodata.tile_index(rows.select("name").distinct())
    return rows.join(index, "name").select("p_partkey", "tile_row", "tile_col", "product", "resolution", text.country_of_file("path").alias("country"))


@query(
    "SELECT s_suppkey AS osm_id, CASE s_suppkey % 4 WHEN 0 THEN 'village' WHEN 1 THEN 'river' WHEN 2 THEN 'lake' END AS place_type, s_name AS name, CAST(s_suppkey AS DOUBLE) / 8e0 AS lat FROM supplier WHERE s_suppkey % 4 < 3 AND s_suppkey % 7 <> 0"
)
def places_from_responses(spark, sf_dir):
    """Map-service elements: first tag that fits, centre of ways, nameless ones dropped."""
    tag = F.when(F.col("s_suppkey") % 4 == 0, '"place":"village"').when(F.col("s_suppkey") % 4 == 1, '"waterway":"river"').when(F.col("s_suppkey") % 4 == 2, '"natural":"water"').otherwise('"shop":"bakery"')
    name = F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.concat(F.lit(',"name":"'), "s_name", F.lit('"')))
    at = F.format_string('"lat":%s,"lon":1.5', (F.col("s_suppkey") / F.lit(8.0)).cast("string"))
    place = F.when(F.col("s_suppkey") % 2 == 0, at).otherwise(F.concat(F.lit('"center":{'), at, F.lit("}")))
    json = F.concat(F.lit('{"elements":[{"type":"node","id":'), F.col("s_suppkey").cast("string"), F.lit(","), place, F.lit(',"tags":{'), tag, name, F.lit("}}]}"))
    return geodata.places(views.read(spark, sf_dir, "supplier").select(F.lit("p").alias("park_id"), json.alias("json"))).select("osm_id", "place_type", "name", "lat")


@query(
    f"""WITH {SET}, {DET}, f AS (SELECT park_id, count(*) AS n FROM detections GROUP BY 1), s AS (SELECT park_id, count(*) AS n FROM settlements GROUP BY 1)
SELECT park_id, name, 'x' AS country, printf('%.2f', area_km2) AS area_km2, CAST(coalesce(f.n, 0) AS VARCHAR) AS fire_count, CAST(coalesce(s.n, 0) AS VARCHAR) AS settlement_count, '0.0000' AS deforestation_km2, '0.00' AS roadless_pct FROM parks LEFT JOIN f USING (park_id) LEFT JOIN s USING (park_id)"""
)
def parks_export(spark, sf_dir):
    areas = view(spark, sf_dir, "parks").select(F.col("park_id").alias("id"), "name", F.lit("x").alias("country"), "area_km2")

    def counted(name: str, column: str) -> DataFrame:
        return view(spark, sf_dir, name).groupBy("park_id").agg(F.count(F.lit(1)).alias(column))

    none = view(spark, sf_dir, "parks").where("false").select("park_id", F.lit(0.0).alias("deforestation_km2"), F.lit(0.0).alias("roadless_pct"))
    return sinks.parks_export(areas, counted("detections", "fire_count"), counted("settlements", "settlement_count"), none, none)


# --- Texts ---------------------------------------------------------------------------------------

_ROLLED = f"""{views.INFRACTIONS}, rolled AS (
  SELECT park_id, count(DISTINCT year) AS years, CAST(sum(total_groups) AS BIGINT) AS n, CAST(sum(groups_stopped_inside) AS BIGINT) AS stopped, CAST(sum(groups_transited) AS BIGINT) AS passed, avg(avg_days_burning) AS days,
    sum(groups_stopped_inside) / sum(total_groups) * 100 AS rate FROM infractions WHERE year BETWEEN 1995 AND 2001 AND total_groups > 0 GROUP BY 1
)"""


def _insights(name: str) -> str:
    """Sentences on fire groups, by thresholds; nulls drop out where they are joined."""
    return f"""CASE WHEN passed > 1 THEN 'Total: ' || passed || ' fire groups transited through ' || {name} || ' without being stopped.' END,
  CASE WHEN stopped > 1 THEN '👍 ' || stopped || ' groups total stopped inside - ' || printf('%.0f', stopped / n * 100) || '% response rate.' END,
  CASE WHEN days > 7 THEN '🔥 Fire groups burned inside the park for an average of ' || printf('%.1f', days) || ' days - indicating sustained presence.' END,
  CASE WHEN stopped / n * 100 >= 70 THEN '👍 High response rate suggests effective ranger patrol coverage.' WHEN stopped / n * 100 < 40 AND n >= 5 THEN '⚠️ Low response rate may indicate gaps in patrol coverage or resources.' END"""


_PEAKS = "peaks AS (SELECT park_id, arg_max(m, n * 100 - m) AS peak_month FROM (SELECT park_id, month(acq_date) AS m, count(*) AS n FROM detections GROUP BY 1, 2) GROUP BY 1)"
_TREND = ORACLES["loss_trend"].split("FROM c")[0].rsplit("SELECT park_id, years", 1)[0]


def _phrases(pattern: str, area: str, year: str) -> str:
    cases = []
    for name, phrases in narrative.PHRASES.items():
        texts = ", ".join("'" + p.replace("'", "''") + "'" for p in phrases)
        cases.append(f"WHEN {pattern} = '{name}' THEN [{texts}][{year} % 4 % {len(phrases)} + 1]")
    return f"CASE {' '.join(cases)} WHEN {area} > 5 THEN '{narrative.LARGE_LOSS}' ELSE '{narrative.UNCLEAR_LOSS}' END"


def _area_text(m2: str) -> str:
    return f"CASE WHEN {m2} >= 1000000 THEN printf('%.1f', {m2} / 1000000) || ' km²' WHEN {m2} >= 10000 THEN printf('%.1f', {m2} / 10000) || ' ha' ELSE printf('%.0f', {m2}) || ' m²' END"


def _stories(spark, sf_dir):
    events = views.losses(spark, sf_dir).withColumn("pattern", F.element_at(F.array(*map(F.lit, ("strip", "cluster", "scattered", "edge"))), (F.col("year") % 4 + 1).cast("int")))
    return narrative.loss_stories(events, view(spark, sf_dir, "places"))


@query(
    f"""WITH {views.LOSSES}, {views.cte("places")}, spots AS (SELECT *, park_id || ':' || year AS point_id, ['strip', 'cluster', 'scattered', 'edge'][year % 4 + 1] AS pattern FROM losses), {views.located("spots", "told")}
SELECT park_id, year, 'In ' || year || ', ' || printf('%.2f', area_km2) || ' km² of forest was lost ' || location || '. ' || {_phrases("pattern", "area_km2", "year")} AS narrative FROM told"""
)
def loss_narrative(spark, sf_dir):
    return _stories(spark, sf_dir).select("park_id", "year", "narrative")


@query(
    _TREND + """, s2 AS (SELECT park_id, sum(area_km2) AS total, arg_max(year, area_km2 * 1e6 - year) AS worst, max(area_km2) AS worst_loss FROM losses GROUP BY 1)
SELECT park_id, CASE WHEN total = 0 THEN 'No significant deforestation events recorded for ' || park_id || '.' ELSE park_id || ' has experienced ' || printf('%.2f', total) || ' km² of forest loss across ' || years || ' recorded years. The worst year was ' || worst || ' with '
  || printf('%.2f', worst_loss) || ' km² lost. ' || CASE WHEN years < 5 THEN 'Insufficient data to determine long-term trend.' WHEN p > 10 THEN '⚠️ TREND ALERT: Deforestation has increased by ' || printf('%.0f', p) || '% comparing recent years to earlier periods.'
  WHEN p < -10 THEN '✅ POSITIVE TREND: Deforestation has decreased by ' || printf('%.0f', -p) || '% comparing recent years to earlier periods.' ELSE 'Deforestation rates have remained relatively stable over the monitoring period.' END END AS summary FROM c JOIN s2 USING (park_id)"""
)
def loss_narrative_summary(spark, sf_dir):
    events = views.losses(spark, sf_dir)
    return narrative.loss_summary(loss.loss_summary(events), loss.loss_trend(events))


@query(
    ORACLES["settlement_risk"].split("SELECT park_id, settlements, people, round")[0]
    + f""", b AS (SELECT park_id, sum(area_m2) AS m2 FROM settlements GROUP BY 1), r AS ({"SELECT park_id, settlements, people, round" + ORACLES["settlement_risk"].split("SELECT park_id, settlements, people, round")[1]})
SELECT park_id, risk, CASE WHEN settlements = 0 THEN park_id || ' shows no detectable human settlements within park boundaries. ' || CASE WHEN area_km2 > 0 THEN 'This ' || printf('%.0f', area_km2) || ' km² protected area represents a pristine wilderness corridor with minimal direct human-wildlife interface. ' ELSE '' END
  || 'Conservation priority: Maintain buffer zones and monitor boundary areas for encroachment. This intact habitat status is rare in the region and critical for wildlife movement corridors.'
  ELSE park_id || ' contains ' || settlements || ' settlements with ' || {_area_text("m2")} || ' total built-up area.' END AS summary FROM r LEFT JOIN b USING (park_id) JOIN parks USING (park_id)"""
)
def settlement_narrative(spark, sf_dir):
    return narrative.settlement_summary(loss.settlement_stats(view(spark, sf_dir, "settlements"), view(spark, sf_dir, "parks"))).select("park_id", "risk", "summary")


@query(
    f"""WITH {_ROLLED}, {DET}, {_PEAKS}, t AS (SELECT park_id, count(*) AS fires FROM detections GROUP BY 1)
SELECT park_id, concat_ws(' ', CASE WHEN years > 1 THEN 'From 1995-2001, ' || park_id || ' experienced ' || coalesce(fires, 0) || ' fire detections across ' || n || ' fire groups over ' || years || ' years.' ELSE 'In 1995-2001, ' || park_id || ' experienced ' || coalesce(fires, 0) || ' fire detections across ' || n || ' distinct fire groups.' END,
  CASE WHEN stopped > 0 THEN stopped || ' group(s) (' || printf('%.0f', rate) || '%) were stopped inside the park, suggesting effective ranger intervention.' END, CASE WHEN passed > 0 THEN passed || ' group(s) transited through without being stopped.' END,
  CASE WHEN peak_month IS NOT NULL THEN 'Peak fire activity occurred in ' || monthname(make_date(2000, peak_month, 1)) || '.' END, CASE WHEN days > 0 THEN 'Fire groups burned inside the park for an average of ' || printf('%.1f', days) || ' days.' END) AS summary FROM rolled LEFT JOIN t USING (park_id) LEFT JOIN peaks USING (park_id)"""
)
def fire_narrative(spark, sf_dir):
    rows = view(spark, sf_dir, "detections")
    total = rows.groupBy("park_id").agg(F.count(F.lit(1)).alias("total_fires"))
    return narrative.fire_summary(fires.infraction_rollup(views.infractions(spark, sf_dir), (1995, 2001)), total, fires.peak_month(rows), "1995-2001").select("park_id", "summary")


@query()
def fire_group_stories(spark, sf_dir):
    return narrative.group_stories(_response(spark, sf_dir), view(spark, sf_dir, "places")).select("park_id", "year", "traj_id", "narrative")


@query(
    f"""WITH {DET}, d AS (SELECT park_id, acq_date, count(*) AS n, avg(frp) AS a, max(frp) AS m FROM detections GROUP BY 1, 2)
SELECT park_id, strftime(acq_date, '%b %d, %Y') AS date, CASE WHEN n >= 100 THEN 'critical' WHEN n >= 50 THEN 'warning' WHEN n >= 20 THEN 'info' WHEN m > 50 THEN 'warning' ELSE 'info' END AS level,
  CASE WHEN n >= 100 THEN '🔥 Major fire event: ' || n || ' active fires detected (avg intensity: ' || printf('%.1f', a) || ' MW)' WHEN n >= 50 THEN '⚠️ Elevated fire activity: ' || n || ' fires detected' WHEN n >= 20 THEN 'Fire activity: ' || n || ' detections'
    WHEN m > 50 THEN 'High-intensity fire detected (' || printf('%.0f', m) || ' MW peak)' ELSE n || ' fire detections' END AS message FROM d QUALIFY row_number() OVER (PARTITION BY park_id ORDER BY acq_date DESC) <= 365"""
)
def fire_log_messages(spark, sf_dir):
    log = fires.daily_log(view(spark, sf_dir, "detections"))
    return log.select("park_id", text.day_text("acq_date").alias("date"), "level", narrative.fire_log_message("level", "fires", "avg_frp", "max_frp").alias("message"))


@query(
    f"WITH {_ROLLED} SELECT park_id, concat_ws(' | ', {_insights('park_id')}) AS insights FROM rolled"
)
def park_insights(spark, sf_dir):
    rolled = fires.infraction_rollup(views.infractions(spark, sf_dir), (1995, 2001))
    return rolled.select("park_id", F.array_join(narrative.fire_insights("stopped_inside", "transited", "total_groups", "avg_days_burning", "park_id"), " | ").alias("insights"))


@query()
def trajectory_descriptions(spark, sf_dir):
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    paths = _nodes(spark, sf_dir).groupBy("park_id", F.concat_ws(":", "park_id", F.col("year").cast("string"), F.col("traj_id").cast("string")).alias("path_id")).agg(points.alias("points"))
    return narrative.path_descriptions(paths, view(spark, sf_dir, "places"))


# --- Batch twins of the streams ------------------------------------------------------------------

_TENTH = "CAST(CAST(round_even(x * 10, 0) / 10 AS DECIMAL(9, 1)) AS VARCHAR)"


@query(
    f"WITH {DET} SELECT {_TENTH.replace('x *', 'latitude *')} || '_' || {_TENTH.replace('x *', 'longitude *')} AS grid_cell_id, acq_date AS date, count(*) AS fire_count, round(sum(frp), 4) AS total_frp FROM detections GROUP BY 1, 2"
)
def fire_daily_grid(spark, sf_dir):
    return streams.daily_grid(view(spark, sf_dir, "detections")).withColumn("total_frp", F.round("total_frp", 4))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, count(*) AS points, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts) + INTERVAL 30 MINUTES) AS BIGINT) AS end_us FROM s GROUP BY user_id, n"""
)
def patrol_sessions(spark, sf_dir):
    out = streams.patrol_sessions(views.read(spark, sf_dir, "events").select("user_id", "ts"))
    return out.select("user_id", "points", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"))


# --- Combined results ----------------------------------------------------------------------------


@query(
    f"""WITH {views.TRACKS}, c AS (SELECT file, avg(lat) AS lat, avg(lon) AS lon, count(*) AS points FROM track_points GROUP BY 1)
SELECT 'f' || CAST(s_suppkey * 2 AS VARCHAR) AS upload_id, round(lat, 6) AS lat, round(lon, 6) AS lon, points FROM supplier LEFT JOIN c ON file = 'f' || CAST(s_suppkey * 2 AS VARCHAR)"""
)
def uploads_with_centroids(spark, sf_dir):
    uploads = views.read(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), (F.col("s_suppkey") * 2).cast("string")).alias("upload_id"))
    out = marts.with_centroids(uploads, views.track_points(spark, sf_dir).withColumnRenamed("file", "upload_id"))
    return out.select("upload_id", *_d("lat", "lon"), "points")


@query(f"WITH {views.cte('places')} SELECT place_type, count(*) AS places, count(DISTINCT park_id) AS parks FROM places GROUP BY GROUPING SETS ((place_type), ())")
def place_counts(spark, sf_dir):
    return marts.place_counts(view(spark, sf_dir, "places"))


@query(
    """WITH b AS (SELECT s_suppkey AS park_id, CAST(s_suppkey % 37 AS DOUBLE) * 3e0 AS x, CAST(s_suppkey % 23 AS DOUBLE) * 5e0 AS y FROM supplier),
t AS (SELECT DISTINCT r AS tile_row, c AS tile_col FROM b, range(0, 60) q(r), range(0, 60) w(c)
  WHERE r BETWEEN CAST(trunc((200e0 - (y + 12)) / 20) AS INT) AND CAST(trunc((200e0 - y) / 20) AS INT) AND c BETWEEN CAST(trunc((x + 100) / 20) AS INT) AND CAST(trunc((x + 125) / 20) AS INT))
SELECT CAST(tile_row AS INT) AS tile_row, CAST(tile_col AS INT) AS tile_col FROM t WHERE (tile_row + tile_col) % 3 <> 0"""
)
def missing_tiles(spark, sf_dir):
    x, y = (F.col("s_suppkey") % 37).cast("double") * 3.0, (F.col("s_suppkey") % 23).cast("double") * 5.0
    parks = views.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("park_id"), x.alias("x_min"), y.alias("y_min"), (x + 25).alias("x_max"), (y + 12).alias("y_max"))
    tiles = marts.park_tiles(parks, -100.0, 200.0, 20.0)
    have = tiles.select("tile_row", "tile_col").distinct().where((F.col("tile_row") + F.col("tile_col")) % 3 == 0)
    return marts.required_tiles(tiles, have)


@query(
    """WITH p AS (SELECT s_suppkey AS p_id, CAST(s_suppkey % 37 AS DOUBLE) * 3e0 AS x, CAST(s_suppkey % 23 AS DOUBLE) * 5e0 AS y FROM supplier), t AS (SELECT n_nationkey AS t_id, CAST(n_nationkey % 5 AS DOUBLE) * 25e0 AS x, CAST(n_nationkey // 5 AS DOUBLE) * 25e0 AS y FROM nation)
SELECT p_id, t_id FROM p JOIN t ON p.x < t.x + 25 AND p.x + 10 > t.x AND p.y < t.y + 25 AND p.y + 7 > t.y"""
)
def parks_of_tiles(spark, sf_dir):
    def box(rows: DataFrame, i: str, x, y, w: float, h: float) -> DataFrame:
        return rows.select(F.col(i).alias("id"), x.alias("x_min"), y.alias("y_min"), (x + w).alias("x_max"), (y + h).alias("y_max"))

    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    parks = box(views.read(spark, sf_dir, "supplier"), "s_suppkey", (s % 37).cast("double") * 3.0, (s % 23).cast("double") * 5.0, 10.0, 7.0)
    tiles = box(views.read(spark, sf_dir, "nation"), "n_nationkey", (n % 5).cast("double") * 25.0, F.floor(n / 5).cast("double") * 25.0, 25.0, 25.0)
    return marts.overlapping(parks, tiles, 25.0).select("p_id", "t_id")


@query(f"WITH {DET}, {views.IN_AREAS} SELECT event_id FROM located WHERE area_id IS NULL AND year(acq_date) = 2024 AND latitude BETWEEN 3 AND 8 AND longitude BETWEEN 20 AND 24")
def fires_in_buffer(spark, sf_dir):
    rows = spatial.first_area(view(spark, sf_dir, "detections"), views.areas(spark))
    return marts.buffer_only(rows, 2024, (3, 8, 20, 24)).select("event_id")


@query(
    f"""WITH {views.cte("places")}, {views.LOSSES}, met AS (
  SELECT l.park_id, year, p.name, power(p.lat - l.lat, 2) + power(p.lon - l.lon, 2) AS d, {views.haversine("l.lat", "l.lon", "p.lat", "p.lon")} AS km, p.id FROM losses l JOIN places p ON p.park_id = l.park_id AND abs(p.lat - l.lat) <= 3 AND abs(p.lon - l.lon) <= 3)
SELECT park_id, year, name, round(km, 5) AS km FROM met QUALIFY row_number() OVER (PARTITION BY park_id, year ORDER BY d, id) = 1"""
)
def nearest_by_degrees(spark, sf_dir):
    near = spatial.nearest_places(views.losses(spark, sf_dir), view(spark, sf_dir, "places"), ["park_id", "year"], 1, 3.0, by="degrees")
    return near.select("park_id", "year", F.col("place_name").alias("name"), F.round("distance_km", 5).alias("km"))


@query(
    f"""WITH {_ROLLED}, {DET}, {views.LOSSES}, {views.cte("parks")}, {_PEAKS}, t AS (SELECT park_id, count(*) AS fires FROM detections GROUP BY 1), w AS (SELECT park_id, arg_max(year, area_km2 * 1e6 - year) AS worst_year FROM losses GROUP BY 1),
s AS (SELECT park_id, avg(area_km2) FILTER (year >= 2020) AS a, avg(area_km2) FILTER (year BETWEEN 2015 AND 2019) AS b FROM losses GROUP BY 1),
l AS (SELECT park_id, CASE WHEN a IS NULL OR b IS NULL THEN 'insufficient_data' WHEN a > b * 1.2e0 THEN 'worsening' WHEN a < b * 0.8e0 THEN 'improving' ELSE 'stable' END AS loss_trend FROM s)
SELECT park_id, n AS total_groups, coalesce(fires, 0) AS total_fires, CAST(peak_month AS INT) AS peak_month, worst_year, loss_trend, concat_ws(' | ', {_insights('name')},
  CASE WHEN area_km2 / 28 >= 90 THEN '🌲 ' || printf('%.0f', area_km2 / 28) || '% roadless wilderness - exceptional intact habitat with minimal human access.' WHEN area_km2 / 28 >= 70 THEN '🌲 ' || printf('%.0f', area_km2 / 28) || '% roadless wilderness - good habitat connectivity.'
    WHEN area_km2 / 28 < 50 THEN '⚠️ Only ' || printf('%.0f', area_km2 / 28) || '% roadless - significant road network may fragment habitat.' END,
  CASE loss_trend WHEN 'worsening' THEN '⚠️ Deforestation trend is worsening - recent years show higher loss than 2015-2019.' WHEN 'improving' THEN '✓ Deforestation trend is improving - recent years show lower loss than 2015-2019.' END) AS insights
FROM parks LEFT JOIN rolled USING (park_id) LEFT JOIN t USING (park_id) LEFT JOIN peaks USING (park_id) LEFT JOIN w USING (park_id) LEFT JOIN l USING (park_id)"""
)
def park_stats(spark, sf_dir):
    roadless = view(spark, sf_dir, "parks").select("park_id", (F.col("area_km2") / 28).alias("roadless_percentage"))
    out = marts.park_stats(view(spark, sf_dir, "parks"), views.infractions(spark, sf_dir), view(spark, sf_dir, "detections"), views.losses(spark, sf_dir), roadless, (1995, 2001))
    return out.select("park_id", "total_groups", "total_fires", "peak_month", "worst_year", "loss_trend", F.array_join("insights", " | ").alias("insights"))


@query(
    f"""WITH {views.TRACKS}, uploads AS (SELECT 'f' || (o_orderkey % 100) AS upload_id, max(o_orderdate) AS uploaded_at FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 10),
centers AS (SELECT upload_id, uploaded_at, avg(lat) AS latitude, avg(lon) AS longitude FROM uploads LEFT JOIN track_points ON file = upload_id GROUP BY 1, 2), detections AS (SELECT *, upload_id AS event_id FROM centers), {views.IN_AREAS}
SELECT upload_id, uploaded_at, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, area_id FROM located"""
)
def recent_activity(spark, sf_dir):
    uploads = views.read(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 100).cast("string")).alias("upload_id"), F.col("o_orderdate").alias("uploaded_at"))
    uploads = uploads.groupBy("upload_id").agg(F.max("uploaded_at").alias("uploaded_at"))
    return marts.recent_activity(uploads, views.track_points(spark, sf_dir).withColumnRenamed("file", "upload_id"), views.areas(spark)).select("upload_id", "uploaded_at", *_d("latitude", "longitude"), "area_id")


@query(f"WITH {DET} SELECT event_id, round(latitude, 6) AS lat, round(longitude, 6) AS lon FROM detections")
def equal_area_round_trip(spark, sf_dir):
    """Detections to equal-area metres and back."""
    xy = view(spark, sf_dir, "detections").select("event_id", projection.to_equal_area("latitude", "longitude").alias("p"))
    back = xy.select("event_id", projection.from_equal_area("p.x", "p.y").alias("q"))
    return back.select("event_id", F.round("q.lat", 6).alias("lat"), F.round("q.lon", 6).alias("lon"))


@query()
def track_lines(spark, sf_dir):
    """Each track as a line: its length on the ellipsoid, and its points and length after simplification."""
    out = projection.lines(views.track_points(spark, sf_dir), 0.01)
    return out.select("file", "points", F.round("km", 5).alias("km"), "points_left", F.round("km_left", 5).alias("km_left"))

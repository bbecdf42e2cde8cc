"""Further registered queries: given paths and their outcomes, stories, records kept up to date, responses, boxes and lists."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acacia.functions import classify, geo, text
from acacia.operators import fires, loss, marts, merge, narrative, search, spatial, tracks, work
from acacia.plans import views
from acacia.plans.catalog import DET, PIX, SET, _d, query
from acacia.plans.views import read, view
from acacia.sources import fires as fire_sources
from acacia.sources import geodata, sinks

# --- Given paths: a node for each day of a group of detections, so that what follows linking has a SQL twin ---

_PATHS = f"""{DET}, day_ AS (SELECT park_id, CAST(year(acq_date) AS INT) AS year, CAST(user_id % 20 AS INT) AS traj_id, acq_date, avg(latitude) AS lat, avg(longitude) AS lon, count(*) AS fires, sum(frp) AS frp,
  greatest(max(latitude) - min(latitude), max(longitude) - min(longitude)) * 111e0 AS spread_km, count(*) FILTER (inside) * 2 >= count(*) AS inside FROM detections GROUP BY ALL),
nodes AS (SELECT *, CAST(row_number() OVER (PARTITION BY park_id, year, traj_id ORDER BY acq_date) - 1 AS INT) AS seq FROM day_),
moves AS (SELECT *, sqrt(power((lat - lat0) * 111, 2) + power((lon - lon0) * 111 * cos(radians((lat + lat0) / 2)), 2)) AS move
  FROM (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM nodes WINDOW w AS (PARTITION BY park_id, year, traj_id ORDER BY seq)))"""
_METRICS = """metrics AS (SELECT *, CASE WHEN days < 3 THEN 'unknown' WHEN speed > 30 THEN 'management_fast' WHEN speed > 15 AND spread > 30 THEN 'management_vehicle' WHEN speed > 15 THEN 'herder_fast' WHEN speed > 5 AND south > 20 THEN 'transhumance'
    WHEN speed > 5 THEN 'herder_local' WHEN speed > 2 AND days > 10 AND south > 15 THEN 'transhumance_slow' WHEN speed > 2 THEN 'local_burning' WHEN days > 7 THEN 'village_persistent' ELSE 'local_stationary' END AS kind
  FROM (SELECT park_id, year, traj_id, count(*) AS days, CAST(sum(fires) AS BIGINT) AS fires, coalesce(avg(move), 0) AS speed, coalesce(max(move), 0) AS top, avg(spread_km) AS spread, (arg_min(lat, seq) - arg_max(lat, seq)) * 111e0 AS south,
    (arg_max(lon, seq) - arg_min(lon, seq)) * 111e0 AS east FROM moves GROUP BY ALL))"""
_RESPONSE = """marked AS (SELECT *, min(seq) FILTER (inside) OVER w AS first_in, max(seq) FILTER (inside) OVER w AS last_in FROM moves WINDOW w AS (PARTITION BY park_id, year, traj_id)),
response AS (SELECT park_id, year, traj_id, count(*) AS trajectory_days, count(*) FILTER (inside) AS days_inside, CAST(coalesce(sum(fires) FILTER (inside), 0) AS BIGINT) AS fires_inside, coalesce(sum(move) FILTER (seq > first_in AND seq <= last_in), 0) AS km_inside,
  count(*) FILTER (seq < first_in) AS days_before, count(*) FILTER (seq > last_in) AS days_after, count(*) FILTER (seq > last_in AND NOT inside) AS outside_after, min(acq_date) FILTER (inside) AS entry_date, max(acq_date) FILTER (inside) AS last_inside,
  max(acq_date) AS last_date, arg_min(lat, seq) AS lat1, arg_min(lon, seq) AS lon1, arg_max(lat, seq) AS lat2, arg_max(lon, seq) AS lon2 FROM marked GROUP BY ALL HAVING count(*) FILTER (inside) > 0 AND count(*) >= 3),
outcomes AS (SELECT *, CASE WHEN days_after = 0 THEN 'STOPPED_INSIDE' WHEN outside_after > 0 THEN 'TRANSITED' ELSE 'STOPPED_AFTER_EXIT' END AS outcome FROM response)"""


def _nodes(spark, sf_dir):
    rows = view(spark, sf_dir, "detections").withColumn("year", F.year("acq_date")).withColumn("traj_id", (F.col("user_id") % 20).cast("int"))
    spread = F.greatest(F.max("latitude") - F.min("latitude"), F.max("longitude") - F.min("longitude")) * geo.KM_PER_DEGREE
    days = rows.groupBy("park_id", "year", "traj_id", "acq_date").agg(
        F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.count(F.lit(1)).alias("fires"), F.sum("frp").alias("frp"), spread.alias("spread_km"), (F.count_if("inside") * 2 >= F.count(F.lit(1))).alias("inside")
    )
    return days.withColumn("seq", F.row_number().over(Window.partitionBy("park_id", "year", "traj_id").orderBy("acq_date")) - 1)


@query(
    f"WITH {_PATHS}, {_METRICS} SELECT park_id, year, traj_id, days, fires, round(speed, 6) AS avg_speed, round(top, 6) AS max_speed, round(spread, 6) AS avg_spread, round(south, 6) AS net_south_km, round(east, 6) AS net_east_km, kind FROM metrics"
)
def path_metrics(spark, sf_dir):
    return fires.trajectory_metrics(_nodes(spark, sf_dir)).select("park_id", "year", "traj_id", "days", "fires", *_d("avg_speed", "max_speed", "avg_spread", "net_south_km", "net_east_km"), "kind")


@query(
    f"""WITH {_PATHS}, {_RESPONSE} SELECT park_id, year, traj_id, trajectory_days, days_inside, fires_inside, round(km_inside, 6) AS distance_inside_km, round(km_inside / days_inside, 6) AS speed_inside, days_before, days_after, entry_date, last_inside, outcome,
  CASE WHEN days_after = 0 THEN 'STOPPED_INSIDE' ELSE 'TRANSITED' END AS outcome_by_index, CASE WHEN last_inside < last_date THEN 'TRANSITED' ELSE 'STOPPED_INSIDE' END AS outcome_by_date FROM outcomes"""
)
def path_outcomes(spark, sf_dir):
    out = fires.trajectory_response(_nodes(spark, sf_dir))
    return out.select("park_id", "year", "traj_id", "trajectory_days", "days_inside", "fires_inside", *_d("distance_inside_km", "speed_inside"), "days_before", "days_after", "entry_date", "last_inside", "outcome", "outcome_by_index", "outcome_by_date")


@query(
    f"""WITH {_PATHS}, {_METRICS}, {_RESPONSE} SELECT park_id, year, count(*) AS total_groups, count(*) FILTER (outcome = 'STOPPED_INSIDE') AS groups_stopped_inside, count(*) FILTER (outcome = 'TRANSITED') AS groups_transited, count(*) FILTER (outcome = 'STOPPED_AFTER_EXIT') AS groups_stopped_after,
  count(*) FILTER (starts_with(kind, 'transhumance')) AS transhumance_groups, count(*) FILTER (starts_with(kind, 'herder')) AS herder_groups, round(avg(days_inside), 6) AS avg_days_burning, CAST(median(days_inside) AS DOUBLE) AS median_days_burning, max(days_inside) AS max_days_burning,
  CAST(sum(fires_inside) AS BIGINT) AS total_fires_inside FROM outcomes JOIN metrics USING (park_id, year, traj_id) WHERE speed BETWEEN 0.5e0 AND 30 AND NOT contains(kind, 'management') GROUP BY 1, 2"""
)
def path_groups(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return fires.group_summary(fires.trajectory_response(nodes), fires.trajectory_metrics(nodes)).withColumn("avg_days_burning", F.round("avg_days_burning", 6))


@query(
    f"""WITH {_PATHS}, {_METRICS} SELECT park_id, year, count(*) AS trajectories, count(*) FILTER (starts_with(kind, 'transhumance')) AS transhumance, count(*) FILTER (starts_with(kind, 'herder')) AS herder, count(*) FILTER (starts_with(kind, 'management')) AS management,
  count(*) FILTER (starts_with(kind, 'village') OR starts_with(kind, 'local')) AS village, CAST(coalesce(sum(fires) FILTER (starts_with(kind, 'transhumance')), 0) AS BIGINT) AS transhumance_fires, round(avg(speed) FILTER (starts_with(kind, 'transhumance')), 6) AS transhumance_speed FROM metrics GROUP BY 1, 2"""
)
def path_kinds(spark, sf_dir):
    return fires.kind_summary(fires.trajectory_metrics(_nodes(spark, sf_dir))).withColumn("transhumance_speed", F.round("transhumance_speed", 6))


@query(
    f"""WITH {_PATHS}, {_RESPONSE}, n AS (SELECT park_id, year, count(*) AS trajectories, arg_min(entry_date, traj_id) FILTER (outcome = 'STOPPED_INSIDE') AS stopped, arg_min(trajectory_days, traj_id) AS days FROM outcomes GROUP BY 1, 2)
SELECT park_id, year, CASE WHEN park_id <> 'p1' THEN CAST(trajectories AS INT) END AS trajectories, CASE WHEN park_id <> 'p1' THEN CAST(stopped AS VARCHAR) END AS first_stopped, CASE WHEN park_id <> 'p1' THEN CAST(least(days, 20) AS INT) END AS path_points FROM n"""
)
def trajectory_documents(spark, sf_dir):
    """Documents written as JSON and read back; one park's document is broken and gives no trajectories."""
    written = fires.documents(fires.trajectory_response(_nodes(spark, sf_dir))).select("park_id", "year", F.to_json("trajectories").alias("json"))
    broken = written.withColumn("json", F.when(F.col("park_id") == "p1", F.concat(F.lit("{"), F.col("json"))).otherwise(F.col("json")))
    out = broken.withColumn("t", marts.trajectories_of("json"))
    return out.select("park_id", "year", F.size("t").alias("n"), marts.first_with_outcome("t", "STOPPED_INSIDE")["entry_date"].alias("first_stopped"), F.size(F.col("t")[0]["path"]).alias("path_points")).select(
        "park_id", "year", F.when(F.col("n") >= 0, F.col("n")).alias("trajectories"), "first_stopped", F.when(F.col("path_points") >= 0, F.col("path_points")).alias("path_points")
    )


@query("SELECT concat('p', CAST(o_custkey % 6 AS VARCHAR)) AS park_id, CAST(max(year(o_orderdate)) FILTER (o_orderstatus = 'F') AS INT) AS year, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'F') AS trajectories FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 0")
def latest_trajectories(spark, sf_dir):
    """Each park's trajectories of the latest year that has any."""
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("p"), (F.col("o_custkey") % 6).cast("string")).alias("park_id"), F.year("o_orderdate").alias("year"), "o_orderstatus", "o_orderdate", "o_orderkey")
    value = F.max_by(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), F.when(F.col("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey")))
    return marts.latest_trajectories(rows.groupBy("park_id", "year").agg(value.alias("trajectories")))


_STORY = "park_id || ':' || year || ':' || traj_id"


@query(
    f"""WITH {_PATHS}, {_RESPONSE}, {views.cte("places")}, base AS (SELECT *, {_STORY} AS story_id FROM outcomes),
ends AS (SELECT story_id || '/o' AS point_id, park_id, lat1 AS lat, lon1 AS lon FROM base UNION ALL SELECT story_id || '/d', park_id, lat2, lon2 FROM base), {views.located("ends", "spots")},
near_rivers AS (SELECT b.story_id, p.name, {views.haversine("(lat1 + lat2) / 2", "(lon1 + lon2) / 2", "p.lat", "p.lon")} AS km, p.id FROM base b JOIN places p ON p.park_id = b.park_id AND abs(p.lat - (lat1 + lat2) / 2) <= 1 AND abs(p.lon - (lon1 + lon2) / 2) <= 1
  WHERE p.place_type = 'river' QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY km, p.id) <= 3),
crossed AS (SELECT story_id, string_agg(name, ' and ' ORDER BY km, id) AS rivers FROM near_rivers WHERE km < 15 GROUP BY 1)
SELECT base.park_id, year, traj_id, 'Fire group ' || (traj_id + 1) || ' originated ' || regexp_replace(o.location, '^at coordinates ', '') || ', moving ' || {views.words(views.bearing("lat1", "lon1", "lat2", "lon2"))} || ' (bearing ' || printf('%03.0f', {views.bearing("lat1", "lon1", "lat2", "lon2")}) || '°)'
  || ' on ' || entry_date || '. ' || CASE WHEN rivers IS NOT NULL THEN 'The group crossed near the ' || rivers || '. ' ELSE '' END || 'Burned inside the park for ' || days_inside || CASE WHEN days_inside = 1 THEN ' day' ELSE ' days' END || ' (' || fires_inside || ' fire detections). '
  || CASE outcome WHEN 'STOPPED_INSIDE' THEN 'Last detected ' || d.location || ' - fire stopped, possibly due to ranger intervention.' WHEN 'TRANSITED' THEN 'Exited the park ' || d.location || ' on ' || last_inside || ' - transited without being stopped.' ELSE 'Last detected ' || d.location || '.' END AS narrative
FROM base LEFT JOIN crossed USING (story_id) JOIN spots o ON o.point_id = story_id || '/o' JOIN spots d ON d.point_id = story_id || '/d'"""
)
def path_stories(spark, sf_dir):
    return narrative.group_stories(fires.trajectory_response(_nodes(spark, sf_dir)), view(spark, sf_dir, "places")).select("park_id", "year", "traj_id", "narrative")


_EQUIRECT = "sqrt(power((p.lat - q.lat) * 111, 2) + power((p.lon - q.lon) * 111 * cos(radians((p.lat + q.lat) / 2)), 2))"
_MIDDLE = f"""steps AS (SELECT park_id, year, traj_id, seq, (lat + lead(lat) OVER w) / 2 AS lat, (lon + lead(lon) OVER w) / 2 AS lon FROM nodes WINDOW w AS (PARTITION BY park_id, year, traj_id ORDER BY seq)),
wet AS (SELECT q.*, p.name, {_EQUIRECT} AS km FROM steps q JOIN places p ON {{on}}abs(p.lat - q.lat) <= 1 AND abs(p.lon - q.lon) <= 1 WHERE p.place_type = 'river' QUALIFY row_number() OVER (PARTITION BY q.park_id, year, traj_id, seq ORDER BY km, p.id) = 1)"""


@query(f"WITH {_PATHS}, {views.cte('places')}, {_MIDDLE.format(on='p.park_id = q.park_id AND ')} SELECT park_id, traj_id, array_to_string(list_sort(list_distinct(list(name))), ',') AS rivers FROM wet WHERE km <= 25 GROUP BY 1, 2")
def river_crossings(spark, sf_dir):
    """Rivers within 25 km of the middle of a path's steps."""
    near = view(spark, sf_dir, "places").where("place_type = 'river'")
    return marts.river_crossings(_nodes(spark, sf_dir), near, 25.0).select("park_id", "traj_id", F.array_join("rivers", ",").alias("rivers"))


@query(
    f"""WITH {_PATHS}, {views.cte("places")}, ends AS (SELECT park_id, traj_id, 'a' AS e, arg_min(lat, seq) AS lat, arg_min(lon, seq) AS lon FROM nodes GROUP BY ALL UNION ALL SELECT park_id, traj_id, 'z', arg_max(lat, seq), arg_max(lon, seq) FROM nodes GROUP BY ALL),
town AS (SELECT q.park_id, traj_id, e, place_type, name, {_EQUIRECT} AS km FROM ends q JOIN places p ON p.park_id = q.park_id AND abs(p.lat - q.lat) <= 1 AND abs(p.lon - q.lon) <= 1 WHERE place_type IN ('village', 'town') AND km <= 50 QUALIFY row_number() OVER (PARTITION BY q.park_id, traj_id, e, place_type ORDER BY km, p.id) = 1),
{_MIDDLE.format(on="p.park_id = q.park_id AND ")},
w AS (SELECT park_id, traj_id, name, min(seq) AS seq FROM wet WHERE km <= 10 GROUP BY park_id, traj_id, name QUALIFY row_number() OVER (PARTITION BY park_id, traj_id ORDER BY min(seq)) <= 3),
r AS (SELECT park_id, traj_id, list(name ORDER BY seq) AS rivers FROM w GROUP BY 1, 2),
p2 AS (SELECT a.park_id, a.traj_id, a.lat AS lat1, a.lon AS lon1, z.lat AS lat2, z.lon AS lon2 FROM ends a JOIN ends z USING (park_id, traj_id) WHERE a.e = 'a' AND z.e = 'z'),
n AS (SELECT park_id, traj_id, count(*) AS n FROM nodes GROUP BY ALL)
SELECT park_id || ':' || traj_id AS path_id, CASE WHEN n < 2 THEN 'Insufficient trajectory data' ELSE concat_ws(', ', CASE WHEN v.name IS NOT NULL THEN 'Fire group originated near ' || v.name || ' (' || printf('%.0f', v.km) || 'km away)' WHEN t.name IS NOT NULL THEN 'Fire group originated near ' || t.name || ' (' || printf('%.0f', t.km) || 'km away)'
    ELSE 'Fire group originated at coordinates (' || printf('%.3f', lat1) || ', ' || printf('%.3f', lon1) || ')' END,
  CASE WHEN len(rivers) = 1 THEN 'crossed ' || rivers[1] || ' River' WHEN len(rivers) = 2 THEN 'crossed ' || rivers[1] || ' and ' || rivers[2] || ' rivers' WHEN len(rivers) = 3 THEN 'crossed ' || rivers[1] || ', ' || rivers[2] || ' and ' || rivers[3] || ' rivers' END,
  CASE WHEN l.name IS NOT NULL THEN 'and was last detected near ' || l.name END,
  'moving ' || CASE WHEN abs(lat2 - lat1) > abs(lon2 - lon1) THEN CASE WHEN lat2 < lat1 THEN 'southward' ELSE 'northward' END ELSE CASE WHEN lon2 < lon1 THEN 'westward' ELSE 'eastward' END END || ' approximately '
    || printf('%.0f', sqrt(power((lat2 - lat1) * 111, 2) + power((lon2 - lon1) * 111 * cos(radians(lat1)), 2))) || 'km') || '.' END AS description
FROM p2 JOIN n USING (park_id, traj_id) LEFT JOIN r USING (park_id, traj_id) LEFT JOIN town v ON v.park_id = p2.park_id AND v.traj_id = p2.traj_id AND v.e = 'a' AND v.place_type = 'village'
LEFT JOIN town t ON t.park_id = p2.park_id AND t.traj_id = p2.traj_id AND t.e = 'a' AND t.place_type = 'town' LEFT JOIN town l ON l.park_id = p2.park_id AND l.traj_id = p2.traj_id AND l.e = 'z' AND l.place_type = 'village'"""
)
def path_texts(spark, sf_dir):
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    paths = _nodes(spark, sf_dir).groupBy("park_id", F.concat_ws(":", "park_id", F.col("traj_id").cast("string")).alias("path_id")).agg(points.alias("points"))
    return narrative.path_descriptions(paths, view(spark, sf_dir, "places"))


# --- Tracks and uploads --------------------------------------------------------------------------


@query(
    f"""WITH {views.TRACKS}, parts AS (SELECT *, (pt_no - 1) // 40 AS part FROM track_points), steps AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM parts WINDOW w AS (PARTITION BY file, part ORDER BY pt_no)),
t AS (SELECT file, part, count(*) AS points, coalesce(sum({views.haversine("lat0", "lon0", "lat", "lon")}), 0) AS km, arg_min(s, pt_no) FILTER (s IS NOT NULL) AS a, arg_max(s, pt_no) FILTER (s IS NOT NULL) AS z FROM steps GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN v < 8 THEN 'foot' WHEN v <= 120 THEN 'vehicle' ELSE 'aircraft' END AS kind FROM (SELECT *, CASE WHEN points > 1 AND z > a THEN km / ((z - a) / 3600e0) ELSE 0 END AS v FROM t))
SELECT file, CAST(sum(points) AS BIGINT) AS total_points, round(sum(km), 5) AS total_distance_km, CAST(min(a) AS BIGINT) AS start_s, CAST(max(z) AS BIGINT) AS end_s, arg_max(kind, part) AS movement_type FROM m WHERE points >= 2 AND km >= 0.001e0 GROUP BY 1"""
)
def upload_totals(spark, sf_dir):
    """Totals of each upload over its segments of two points and a metre or more."""
    parts = views.track_points(spark, sf_dir).withColumn("part", F.floor((F.col("pt_no") - 1) / 40).cast("int"))
    totals = tracks.upload_totals(tracks.kept_segments(tracks.segments(parts, ["file", "track_no", "seg_no", "part"])))
    return totals.select("file", "total_points", F.round("total_distance_km", 5).alias("total_distance_km"), F.unix_seconds("start_time").alias("start_s"), F.unix_seconds("end_time").alias("end_s"), "movement_type")


@query("SELECT o_orderkey AS upload_id, o_orderdate AS uploaded_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def uploads_page(spark, sf_dir):
    """The third page of fifty uploads, newest first."""
    return search.page(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("upload_id"), F.col("o_orderdate").alias("uploaded_at")), [F.desc("uploaded_at"), F.desc("upload_id")], 50, 2)


# --- Boxes, tiles and rings ----------------------------------------------------------------------


@query(
    f"""WITH {DET} SELECT event_id, {views.words(views.bearing("latitude", "longitude", "6.25e0", "21.5e0"))} || ' (bearing ' || printf('%03.0f', {views.bearing("latitude", "longitude", "6.25e0", "21.5e0")}) || '°)' AS heading,
  CAST(greatest(0, least(9, CAST(floor((latitude - floor(latitude / 0.1e0) * 0.1e0) / 0.01e0) AS INT))) AS VARCHAR) || '_' || CAST(greatest(0, least(9, CAST(floor((longitude - floor(longitude / 0.1e0) * 0.1e0) / 0.01e0) AS INT))) AS VARCHAR) AS subcell_id,
  round(latitude - 50 / 111e0, 6) AS south, round(longitude + 50 / 111e0, 6) AS east, round(2 * sqrt((abs(frp) + 1) / pi()) / 111, 9) AS circle_height, round(2 * sqrt((abs(frp) + 1) / pi()) / 111 / cos(radians(latitude)), 9) AS circle_width,
  CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN inside THEN 'infraction' ELSE 'buffer' END AS location FROM detections"""
)
def boxes_and_headings(spark, sf_dir):
    rows = view(spark, sf_dir, "detections")
    b, around = geo.bearing("latitude", "longitude", F.lit(6.25), F.lit(21.5)), geo.bbox_around("latitude", "longitude", 50.0)
    circle = geo.ring_bbox(geo.circle_ring("latitude", "longitude", F.abs("frp") + 1))
    return rows.select(
        "event_id", geo.compass_described(b).alias("heading"), geo.subcell_id("latitude", "longitude").alias("subcell_id"), F.round(around["lat_min"], 6).alias("south"), F.round(around["lon_max"], 6).alias("east"),
        F.round(circle["lat_max"] - circle["lat_min"], 9).alias("circle_height"), F.round(circle["lon_max"] - circle["lon_min"], 9).alias("circle_width"), geo.fire_location(F.col("inside"), F.col("event_id") % 7 != 0).alias("location"),
    )


_CORNERS = f"{views.EDGES}, box_ AS (SELECT id, min(y1) AS south, max(y1) AS north, min(x1) AS west, max(x1) AS east FROM edges WHERE ring = 0 GROUP BY 1)"


@query(
    f"""WITH {_CORNERS}, t AS (SELECT id, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM box_, range(-90, 90, 10) a(r), range(-180, 180, 10) b(c) WHERE r BETWEEN floor(south / 10) * 10 AND floor(north / 10) * 10 AND c BETWEEN floor(west / 10) * 10 AND floor(east / 10) * 10)
SELECT n_nationkey, id AS area_id, round(south - 200 / 111e0 - n_nationkey, 6) AS lat_min, round(east + 200 / 111e0, 6) AS lon_max, round((north - south) * (east - west), 6) AS box_area,
  (SELECT string_agg(printf('%02dN', r + 10) || printf('_%03dE', c), ',' ORDER BY printf('%02dN', r + 10) || printf('_%03dE', c)) FROM t WHERE t.id = box_.id) AS tiles FROM box_, nation"""
)
def area_boxes(spark, sf_dir):
    """Boxes of areas, wider by 200 km, shifted for each nation, and the forest tiles they touch."""
    ring = F.col("rings")[0]
    areas = views.areas(spark).select(F.col("id").alias("area_id"), geo.bbox_around_ring(ring, 200.0).alias("wide"), geo.ring_bbox(ring).alias("box"))
    rows = areas.join(F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*[F.lit(name) for name, *_ in views.AREAS])).alias("area_id"))), "area_id")
    return rows.select("n_nationkey", "area_id", F.round(F.col("wide.lat_min") - F.col("n_nationkey"), 6).alias("lat_min"), F.round("wide.lon_max", 6).alias("lon_max"), F.round(geo.bbox_area(F.col("box")), 6).alias("box_area"), F.array_join(geo.forest_tiles(F.col("box")), ",").alias("tiles"))


@query(f"WITH {DET}, {views.IN_AREAS} SELECT b.event_id, b.id AS area_id FROM buffered b LEFT JOIN strict s ON s.event_id = b.event_id AND s.id = b.id WHERE s.id IS NULL")
def ring_members(spark, sf_dir):
    """Detections in an area's buffer but not in the area."""
    return spatial.ring_members(view(spark, sf_dir, "detections"), views.areas(spark)).select("event_id", "area_id")


@query(f"WITH {DET}, {views.IN_AREAS} SELECT event_id, area_id IS NOT NULL AS inside FROM located WHERE year(acq_date) = 2024 AND (area_id IS NOT NULL OR latitude BETWEEN 3 AND 8 AND longitude BETWEEN 20 AND 24)")
def fires_inside_or_near(spark, sf_dir):
    rows = spatial.first_area(view(spark, sf_dir, "detections").drop("inside"), views.areas(spark))
    return marts.inside_or_buffer(rows, 2024, (3, 8, 20, 24)).select("event_id", "inside")


@query(f"WITH {DET}, p AS (SELECT id, avg(x1) AS lon, avg(y1) AS lat FROM ({'WITH ' + views.EDGES + ' SELECT * FROM edges'}) GROUP BY 1) SELECT DISTINCT event_id FROM detections JOIN p ON latitude BETWEEN lat - 0.5e0 AND lat + 0.5e0 AND longitude BETWEEN lon - 0.5e0 AND lon + 0.5e0")
def detections_near_parks(spark, sf_dir):
    """Detections within half a degree of the mean corner of any area, once each."""
    edges = spatial.with_edges(views.areas(spark)).select("id", F.explode("edges").alias("e"))
    parks = edges.groupBy(F.col("id").alias("park_id")).agg(F.avg("e.y1").alias("lat"), F.avg("e.x1").alias("lon"))
    return fire_sources.near_parks(view(spark, sf_dir, "detections").select("event_id", "latitude", "longitude"), parks).select("event_id")


@query(f"WITH {DET} SELECT event_id FROM detections QUALIFY count(*) OVER (PARTITION BY park_id, acq_date) >= 50")
def detections_of_busy_days(spark, sf_dir):
    return fires.with_enough(view(spark, sf_dir, "detections"), ["park_id", "acq_date"], 50).select("event_id")


@query(f"WITH {DET}, n AS (SELECT park_id, month(acq_date) AS m, count(*) AS n FROM detections WHERE CASE WHEN latitude > 0 THEN month(acq_date) IN (1, 2, 3, 11, 12) ELSE month(acq_date) BETWEEN 5 AND 10 END GROUP BY 1, 2) SELECT park_id, CAST(arg_max(m, n * 100 - m) AS INT) AS peak_month, max(n) AS peak_fires FROM n GROUP BY 1")
def dry_season_peak(spark, sf_dir):
    return fires.peak_month(view(spark, sf_dir, "detections"), dry_season=True)


# --- Rasters -------------------------------------------------------------------------------------


@query(f"WITH {PIX} SELECT park_id, CAST(count(*) * 4 AS BIGINT) AS pixels, CAST(sum(value) * 4 AS BIGINT) AS total FROM pixels WHERE r % 2 = 0 AND c % 2 = 0 AND r BETWEEN 0 AND 39 AND c BETWEEN 5 AND 44 GROUP BY 1")
def raster_window(spark, sf_dir):
    """A clamped window of the raster, every other row and column, with counts scaled back."""
    rows = loss.downsampled(loss.window_of(view(spark, sf_dir, "pixels"), (-7, 80), (5, 44), (40, 50)), 2)
    return rows.groupBy("park_id").agg(F.sum("weight").cast("long").alias("pixels"), F.sum(F.col("value") * F.col("weight")).alias("total"))


@query(
    f"""WITH {PIX}, t AS (SELECT park_id, tile, CAST(code + 2000 AS INT) AS year, count(*) AS n, list_sort(list(DISTINCT r)) AS rows_ FROM pixels WHERE code > 0 GROUP BY ALL)
SELECT park_id, year, CAST(sum(n) AS BIGINT) AS pixel_count, array_to_string(flatten(list(rows_ ORDER BY tile)), ',') AS clusters FROM t GROUP BY 1, 2"""
)
def merged_tile_clusters(spark, sf_dir):
    """Tiles of a park and year as one, their lists one after the other."""
    pixels = view(spark, sf_dir, "pixels").where("code > 0")
    lists = pixels.groupBy("park_id", "tile", (F.col("code") + 2000).alias("year")).agg(F.array_sort(F.collect_set("r")).alias("clusters"))
    tiles = loss.loss_by_year(pixels).withColumn("pattern_type", F.lit("scattered")).join(lists, ["park_id", "tile", "year"])
    return loss.merged_tiles(tiles).select("park_id", "year", "pixel_count", F.array_join("clusters", ",").alias("clusters"))


# --- Records kept up to date ---------------------------------------------------------------------

_KEYED = "SELECT o_orderkey AS k, concat('p', CAST(o_custkey % 9 AS VARCHAR)) AS park_id, o_orderstatus AS status, o_orderdate AS happened FROM orders"


def _records(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("p"), (F.col("o_custkey") % 9).cast("string")).alias("park_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"))


@query(f"WITH t AS ({_KEYED}) SELECT k, park_id FROM t WHERE k % 3 = 0 AND park_id NOT IN (SELECT park_id FROM t WHERE k % 100 = 1) UNION ALL SELECT k, park_id FROM t WHERE k % 100 = 1")
def replaced_parks(spark, sf_dir):
    """All rows of a batch's parks give way to the batch."""
    rows = _records(spark, sf_dir).select("k", "park_id")
    return merge.replace_partition(rows.where("k % 3 = 0"), rows.where("k % 100 = 1"), "park_id")


@query(f"WITH t AS ({_KEYED}) SELECT k, park_id FROM t WHERE NOT (k % 2 = 0 AND status = 'F')")
def unfinished_tasks(spark, sf_dir):
    """What a ledger of every other task does not have as completed."""
    rows = _records(spark, sf_dir)
    ledger = rows.where("k % 2 = 0").select("k", F.when(F.col("status") == "F", "completed").otherwise("failed").alias("status"))
    return merge.resumed(rows.select("k", "park_id"), ledger, ["k"])


@query(f"WITH t AS ({_KEYED}) SELECT k, CASE WHEN k % 4 = 0 AND k % 3 <> 0 THEN 'X' ELSE status END AS status, CASE WHEN k % 4 = 0 THEN k * 2 END AS twice FROM t")
def updated_records(spark, sf_dir):
    """Matching rows take the new values that are not null; a column that is new is added."""
    rows = _records(spark, sf_dir).select("k", "status")
    changes = rows.where("k % 4 = 0").select("k", F.when(F.col("k") % 3 != 0, "X").alias("status"), (F.col("k") * 2).alias("twice"))
    return merge.update(rows, changes, ["k"], ["status", "twice"]).select("k", "status", "twice")


@query(
    f"""WITH t AS (SELECT park_id, max(CAST(happened AS DATE)) FILTER (k % 8 <> 0) AS last_date FROM ({_KEYED}) WHERE park_id <> 'p0' GROUP BY 1 UNION ALL SELECT 'p0', NULL),
w AS (SELECT park_id, coalesce(last_date + 1, DATE '1998-01-01') AS a FROM t)
SELECT park_id, CAST(d AS DATE) AS chunk_start, least(CAST(d AS DATE) + 9, DATE '1998-10-01') AS chunk_end FROM (SELECT park_id, unnest(range(a, DATE '1998-10-02', INTERVAL 10 DAYS)) AS d FROM w WHERE a <= DATE '1998-10-01')"""
)
def sync_requests(spark, sf_dir):
    """From the day after each park's last one to a fixed day, in requests of ten days."""
    last = _records(spark, sf_dir).where("park_id <> 'p0'").groupBy("park_id").agg(F.max(F.when(F.col("k") % 8 != 0, F.col("at").cast("date"))).alias("last_date"))
    none = read(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("p0").alias("park_id"), F.lit(None).cast("date").alias("last_date"))
    windows = merge.sync_window(last.unionByName(none), "1998-10-01", "1998-01-01")
    return merge.date_chunks(windows, 10).select("park_id", "chunk_start", "chunk_end")


@query(f"WITH {views.cte('effort')} SELECT grid_cell_id, CAST(year AS INT) AS year, CAST(day AS INT) AS day, CAST(sum(total_points) AS BIGINT) AS total_points FROM effort WHERE day IS NOT NULL GROUP BY ALL UNION ALL SELECT grid_cell_id, CAST(year AS INT), NULL, total_points FROM effort WHERE day IS NULL")
def merge_effort_days(spark, sf_dir):
    """Like a unique index, nulls never match: rows without a day stay apart."""
    rows = view(spark, sf_dir, "effort")
    return merge.add_up_nulls_apart(rows.where("upload_id % 2 = 0"), rows.where("upload_id % 2 = 1"), ["grid_cell_id", "year", "day"], "day", ["total_points"])


@query(f"WITH t AS ({_KEYED}) SELECT park_id AS task, arg_max(status, (happened, k)) AS status, count(*) AS events, string_agg(CASE WHEN place <= 10 THEN k END, ',' ORDER BY happened DESC, k DESC) AS last_events FROM (SELECT *, row_number() OVER (PARTITION BY park_id ORDER BY happened DESC, k DESC) AS place FROM t) GROUP BY park_id")
def job_status(spark, sf_dir):
    """Each task's latest state with its last ten events."""
    rows = _records(spark, sf_dir).select(F.col("park_id").alias("task"), F.struct("at", "k").alias("at"), "status", F.col("k").cast("string").alias("details"))
    n = rows.groupBy("task").agg(F.count(F.lit(1)).alias("events"))
    return sinks.job_status(rows).join(n, "task").select("task", "status", "events", F.array_join(F.transform("history", lambda h: h["details"]), ",").alias("last_events"))


@query(f"WITH t AS ({_KEYED}) SELECT name AS dataset, count(k) AS n, max(strftime(happened, '%Y-%m-%d %H:%M:%S')) AS latest, CASE WHEN count(k) > 0 THEN 'ready' ELSE 'pending' END AS status FROM (VALUES ('F'), ('O'), ('none')) s(name) LEFT JOIN t ON t.status = s.name AND t.park_id = 'p3' GROUP BY 1")
def park_readiness(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return search.readiness({name: (rows.where(F.col("status") == name), "at") for name in ("F", "O", "none")}, "p3")


@query("WITH a AS (SELECT s_suppkey AS ord, 'id' || s_suppkey AS id, CAST(s_suppkey % 40 AS VARCHAR) AS wdpa_id, s_name AS name FROM supplier), w AS (SELECT 'id' || (c_custkey % 300) AS wanted FROM customer UNION SELECT CAST(c_custkey % 60 AS VARCHAR) FROM customer) SELECT wanted, ord, id, name FROM w JOIN a ON a.id = wanted OR a.wdpa_id = wanted QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY ord) = 1")
def areas_by_any_id(spark, sf_dir):
    areas = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("id"), F.col("s_suppkey").cast("string")).alias("id"), (F.col("s_suppkey") % 40).cast("string").alias("wdpa_id"), F.col("s_name").alias("name"))
    n = read(spark, sf_dir, "customer").select("c_custkey")
    wanted = n.select(F.concat(F.lit("id"), (F.col("c_custkey") % 300).cast("string")).alias("wanted")).union(n.select((F.col("c_custkey") % 60).cast("string"))).distinct()
    return search.by_any_id(areas, wanted)


@query("SELECT concat('pa', CAST(doc_id % 7 AS VARCHAR)) AS pa_id, doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id % 7 ORDER BY lang, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 5 END DESC NULLS LAST, n_chars DESC NULLS LAST, doc_id) AS INT) AS place FROM documents")
def documents_in_order(spark, sf_dir):
    """Documents of a park by category, newest year and upload first."""
    rows = read(spark, sf_dir, "documents").select(F.concat(F.lit("pa"), (F.col("doc_id") % 7).cast("string")).alias("pa_id"), F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") % 5).alias("year"), F.col("n_chars").alias("uploaded_at"))
    return search.documents(rows).select("pa_id", "id", "place")


@query("SELECT concat('pa', CAST(doc_id % 7 AS VARCHAR)) AS pa_id, count(*) AS publications FROM documents GROUP BY 1")
def publication_counts(spark, sf_dir):
    return search.publication_counts(read(spark, sf_dir, "documents").select(F.concat(F.lit("pa"), (F.col("doc_id") % 7).cast("string")).alias("pa_id")))


@query("SELECT c_custkey AS wdpa_id, c_name AS name, c_custkey <= 40 AS loaded FROM customer WHERE contains(lower(c_name), '00003') ORDER BY c_custkey LIMIT 30")
def index_entries(spark, sf_dir):
    index = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("wdpa_id"), F.col("c_name").alias("name"))
    return search.index_search("00003", index, index.where("wdpa_id <= 40").select("wdpa_id")).select("wdpa_id", "name", "loaded")


@query(
    "SELECT q AS query, id, name FROM (SELECT q, p_partkey AS id, p_name AS name, row_number() OVER (PARTITION BY q ORDER BY p_partkey) AS n FROM part, (SELECT unnest(['widget', 'LARGE b', 'w', 'od', 'zzz']) AS q) WHERE contains(lower(p_name), lower(q))) WHERE n <= 30"
)
def indexed_names(spark, sf_dir):
    """Searches by the inverted index, which is built here over all names."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    index = search.NameIndex(spark, f"{work.run_folder(spark)}/names-{uuid.uuid4().hex}").build(rows, ["name"])
    out = [search.matches(index.candidates(q), ["name"], q, 30, ["id"], q).select(F.col("kind").alias("query"), "id", "name") for q in ("widget", "LARGE b", "w", "od", "zzz")]
    return reduce(DataFrame.unionByName, out)


@query("SELECT 'a' || s_suppkey AS id, CAST(NULL AS TIMESTAMP) AS last_sync FROM supplier WHERE s_suppkey % 5 = 0 ORDER BY id LIMIT 3")
def areas_never_synced(spark, sf_dir):
    areas = read(spark, sf_dir, "supplier").select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("n"))
    synced = areas.where("n % 5 <> 0").select(F.col("id").alias("pa_id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_sync"))
    return search.to_sync(areas.select("id"), synced, "2024-02-01").select("id", F.col("last_sync").cast("timestamp_ntz").alias("last_sync"))


@query("SELECT 'a' || s_suppkey AS id, TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 40 AS INT)) AS last_sync FROM supplier WHERE s_suppkey % 40 < 24 ORDER BY last_sync, id LIMIT 3")
def areas_synced_longest_ago(spark, sf_dir):
    areas = read(spark, sf_dir, "supplier").select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("n"))
    synced = areas.select(F.col("id").alias("pa_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n") % 40).cast("int")).cast("timestamp").alias("last_sync"))
    return search.to_sync(areas.select("id"), synced, "2024-02-01").select("id", F.col("last_sync").cast("timestamp_ntz").alias("last_sync"))


@query("SELECT replace(n_name, '_', '') || '_' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'own ' || s_suppkey ELSE 'of ' || replace(n_name, '_', '') END AS legislation, s_suppkey % 3 = 0 AS own FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE NOT contains(n_name, ' ')")
def legal_texts(spark, sf_dir):
    """An area's own legal texts, else those of its country."""
    nation = read(spark, sf_dir, "nation").where(~F.col("n_name").contains(" ")).withColumn("n_name", F.replace("n_name", F.lit("_"), F.lit("")))
    ids = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat_ws("_", "n_name", F.col("s_suppkey").cast("string")).alias("id"), "s_suppkey")
    own = ids.where("s_suppkey % 3 = 0").select("id", F.concat(F.lit("own "), F.col("s_suppkey").cast("string")).alias("legislation"))
    countries = nation.select(F.col("n_name").alias("code"), F.concat(F.lit("of "), "n_name").alias("legislation"))
    return search.legal_of_area(ids.select("id"), own, countries).select("id", "legislation", "own")


# --- Responses, files and texts ------------------------------------------------------------------


@query("SELECT doc_id, lang AS first_author, CAST(2000 + doc_id % 25 AS INT) AS year, 'a' || doc_id AS title FROM documents")
def works_from_responses(spark, sf_dir):
    """Publications from scholarly-service responses, one for each document."""
    json = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("https://x.example/W"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("title"), (2000 + F.col("doc_id") % 25).cast("int").alias("publication_year"),
        F.array(F.struct(F.struct(F.col("lang").alias("display_name")).alias("author"))).alias("authorships"),
    )).alias("results")))
    works = geodata.works(read(spark, sf_dir, "documents").select(F.lit("pa").alias("pa_id"), json.alias("json")))
    read_back = works.withColumn("names", text.authors(F.to_json("authors")))
    return read_back.select(F.substring("openalex_id", 2, 20).cast("long").alias("doc_id"), F.col("names")[0].alias("first_author"), "year", "title")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'track' ELSE 'primary' END AS kind, CAST(s_suppkey % 5 + 2 AS INT) AS points FROM supplier WHERE s_suppkey % 7 <> 0")
def roads_from_responses(spark, sf_dir):
    """Ways with a road class and two points or more; other ways are left out."""
    kind = F.when(F.col("s_suppkey") % 7 == 0, "steps").when(F.col("s_suppkey") % 3 == 0, "track").otherwise("primary")
    shape = F.transform(F.sequence(F.lit(0), (F.col("s_suppkey") % 5 + 1).cast("int")), lambda i: F.struct((F.lit(1.0) + i / 100).alias("lat"), F.lit(20.0).alias("lon")))
    json = F.to_json(F.struct(F.array(F.struct(F.lit("way").alias("type"), F.col("s_suppkey").alias("id"), F.create_map(F.lit("highway"), kind).alias("tags"), shape.alias("geometry"))).alias("elements")))
    out = geodata.roads(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("park_id"), json.alias("json")))
    return out.select(F.col("park_id").cast("long").alias("s_suppkey"), "kind", F.size("points").alias("points"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS DOUBLE) + 0.5e0 END AS area FROM customer")
def reported_areas(spark, sf_dir):
    """The number at the start of a reported area."""
    said = F.when(F.col("c_custkey") % 4 == 0, "unknown").otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".5 km2")))
    return read(spark, sf_dir, "customer").select("c_custkey", geodata.reported_area(said).alias("area"))


@query("SELECT c_custkey % 100 AS id, arg_min(c_custkey, (c_mktsegment, c_custkey)) AS first_key FROM customer GROUP BY 1")
def index_first_seen(spark, sf_dir):
    """Index entries once each, as they came first by country and page."""
    rows = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("id"), F.col("c_mktsegment").alias("country"), F.col("c_custkey").alias("page"))
    return geodata.first_seen(rows).select("id", F.col("page").alias("first_key"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 33 END AS corners FROM supplier")
def areas_with_boundaries(spark, sf_dir):
    """Areas with the ring of their boundary where there is one, else a circle."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_suppkey").alias("n"))
    basic = s.select("id", F.array(geo.circle_ring((F.col("n") % 9).cast("double"), F.lit(20.0))).alias("rings"))
    square = F.from_json(F.lit("[[[0,0],[1,0],[1,1],[0,0]]]"), "array<array<array<double>>>")
    return geodata.with_boundaries(basic, s.where("n % 2 = 0").select("id", square.alias("rings"))).select("id", F.size(F.col("rings")[0]).alias("corners"))


@query("""SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (c_custkey % 30) / 4e0 || ',' || (c_custkey % 20) / 4e0 || ']},"properties":{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}}' AS feature FROM customer""")
def point_features(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumn("lat", (F.col("c_custkey") % 20) / 4.0).withColumn("lon", (F.col("c_custkey") % 30) / 4.0)
    return sinks.point_features(rows, "lat", "lon", ["c_custkey", "c_mktsegment"])


@query("""SELECT '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0.0,0.0],[' || s_suppkey / 2e0 || ',0.0],[0.0,1.0],[0.0,0.0]]]},"properties":{"s_suppkey":' || s_suppkey || '}}' AS feature FROM supplier""")
def polygon_features(spark, sf_dir):
    corner = [(F.lit(0.0), F.lit(0.0)), (F.col("s_suppkey") / 2.0, F.lit(0.0)), (F.lit(0.0), F.lit(1.0)), (F.lit(0.0), F.lit(0.0))]
    return sinks.polygon_features(read(spark, sf_dir, "supplier").withColumn("rings", F.array(F.array(*[F.array(x, y) for x, y in corner]))), ["s_suppkey"])


@query("""SELECT '{"type":"Feature","geometry":{"type":"LineString","coordinates":[' || string_agg('[' || CAST(c_custkey AS DOUBLE) || ',' || (c_custkey % 8) / 4e0 || ']', ',' ORDER BY c_custkey) || ']},"properties":{"c_nationkey":' || c_nationkey || '}}' AS feature FROM customer GROUP BY c_nationkey""")
def line_features(spark, sf_dir):
    nodes = read(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("seq"), F.col("c_custkey").cast("double").alias("lon"), ((F.col("c_custkey") % 8) / 4.0).alias("lat"))
    return sinks.line_features(nodes, ["c_nationkey"])


_NAMES = ", ".join(f"WHEN '{k}' THEN '{v}'" for k, v in narrative.PATTERN_NAMES.items()).replace(", WHEN", " WHEN")


@query(
    f"""WITH {views.LOSSES} SELECT park_id, year, 'In ' || year || ', Park ' || park_id || ' (XX) experienced ' || printf('%.2f', area_km2) || ' km² of forest loss. The pattern shows ' || CASE ['strip', 'cluster', 'other', 'edge', 'minor'][year % 5 + 1] {_NAMES} ELSE 'forest disturbance' END
  || '. Centered at approximately ' || printf('%.2f', abs(lat - 4)) || '°' || CASE WHEN lat - 4 >= 0 THEN 'N' ELSE 'S' END || ', ' || printf('%.2f', abs(lon)) || '°' || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || '. ' AS description FROM losses"""
)
def loss_descriptions(spark, sf_dir):
    pattern = F.element_at(F.array(*map(F.lit, ("strip", "cluster", "other", "edge", "minor"))), (F.col("year") % 5 + 1).cast("int"))
    return views.losses(spark, sf_dir).select("park_id", "year", narrative.loss_description(F.concat(F.lit("Park "), "park_id"), F.lit("XX"), "year", "area_km2", pattern, F.col("lat") - 4, "lon").alias("description"))


@query(
    f"""WITH {SET}, {views.cte("places")}, near AS (SELECT s.id, p.name, {views.haversine("(s.lat + 4)", "(s.lon + 20)", "p.lat", "p.lon")} AS km, {views.words(views.bearing("p.lat", "p.lon", "(s.lat + 4)", "(s.lon + 20)"))} AS heading FROM settlements s JOIN places p ON p.park_id = s.park_id AND abs(p.lat - s.lat - 4) <= 1 AND abs(p.lon - s.lon - 20) <= 1
  WHERE p.place_type IN ('village', 'hamlet', 'town', 'city') QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY km, p.id) = 1)
SELECT id, 'Building cluster ' || printf('%.0f', area_m2) || 'm², ~' || population_est || ' people' || coalesce(', ' || printf('%.0f', km) || ' km ' || heading || ' of ' || name, '') AS description FROM settlements LEFT JOIN near USING (id)"""
)
def settlement_descriptions(spark, sf_dir):
    rows = view(spark, sf_dir, "settlements").withColumn("lat", F.col("lat") + 4).withColumn("lon", F.col("lon") + 20)
    near = spatial.nearest_places(rows.select("id", "park_id", "lat", "lon", "area_m2", "population_est"), view(spark, sf_dir, "places"), ["id"], 1, 1.0, narrative.SETTLEMENTS, outer=True)
    heading = geo.compass_words(geo.bearing("place_lat", "place_lon", "lat", "lon"))
    return near.select("id", narrative.settlement_description("area_m2", "population_est", "place_name", "distance_km", heading, at_place=True).alias("description"))


@query(f"WITH {SET} SELECT park_id, id, CAST(row_number() OVER (PARTITION BY park_id ORDER BY area_m2 DESC, id) AS INT) AS place FROM settlements")
def settlements_by_area(spark, sf_dir):
    order = Window.partitionBy("park_id").orderBy(F.desc("area_m2"), "id")
    return view(spark, sf_dir, "settlements").select("park_id", "id", F.row_number().over(order).alias("place"))


@query(
    """SELECT c_custkey, CASE WHEN v >= 1000000 THEN printf('%.1f', v / 1000000) || 'M' WHEN v >= 1000 THEN printf('%.0f', v / 1000) || 'K' ELSE CAST(CAST(v AS BIGINT) AS VARCHAR) END AS people, CASE WHEN v >= 1000000 THEN printf('%.1f', v / 1000000) || ' km²' WHEN v >= 10000 THEN printf('%.1f', v / 10000) || ' ha' ELSE printf('%.0f', v) || ' m²' END AS area,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a and b' ELSE 'a, b and c' END AS names, contains(translate(c_name || 'Ä', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '1Ä') AS ends_in_1, monthname(make_date(2000, CAST(c_custkey % 12 + 1 AS INT), 1)) AS month
FROM (SELECT c_custkey, c_name, CAST(c_custkey * 7919 % 3000 AS DOUBLE) * (c_custkey % 900 + 1) AS v FROM customer)"""
)
def numbers_and_lists_as_text(spark, sf_dir):
    k = F.col("c_custkey")
    v = (k * 7919 % 3000).cast("double") * (k % 900 + 1)
    names = F.slice(F.array(*map(F.lit, "abc")), F.lit(1), (k % 4).cast("int"))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(v >= 1000, text.people_text(v)).otherwise(v.cast("long").cast("string")).alias("people"), text.area_text(v).alias("area"), text.listed(names).alias("names"),
        text.contains_ascii(F.concat("c_name", F.lit("Ä")), "1Ä").alias("ends_in_1"), text.month_name(F.make_date(F.lit(2000), (k % 12 + 1).cast("int"), F.lit(1))).alias("month"),
    )


@query("SELECT doc_id, CAST(least(b, 1000) + CASE WHEN b > 1000 THEN 3 ELSE 0 END AS INT) AS octets, md5(CASE WHEN b > 1000 THEN encode(t)[1:1000] || '...'::BLOB ELSE encode(t) END) AS digest FROM (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS b FROM documents)")
def abstract_cuts(spark, sf_dir):
    """Every document's text as an abstract, cut after 1,000 bytes and marked: its bytes and their digest."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).repartition(F.xxhash64("doc_id", "t"))
    cut = F.transform(F.array(text.abstract_text(text.inverted_index("t"), 1000)), lambda a: a.cast("binary"))[0]
    return docs.select("doc_id", F.octet_length(cut).alias("octets"), F.md5(cut).alias("digest"))


@query(
    "WITH "
    + DET
    + """, t AS (SELECT event_id, latitude, longitude, radians(latitude) AS phi FROM detections),
n0 AS (SELECT *, phi AS th FROM t), """
    + ", ".join(f"n{i} AS (SELECT * REPLACE (th - (2 * th + sin(2 * th) - pi() * sin(phi)) / (2 + 2 * cos(2 * th)) AS th) FROM n{i - 1})" for i in range(1, 9))
    + """ SELECT event_id, round(2 * sqrt(2e0) / pi() * 6378137e0 * radians(longitude) * cos(th), 4) AS x, round(sqrt(2e0) * 6378137e0 * sin(th), 4) AS y FROM n8"""
)
def equal_area_metres(spark, sf_dir):
    """Detections in equal-area metres."""
    from acacia.functions import projection

    xy = view(spark, sf_dir, "detections").select("event_id", projection.to_equal_area("latitude", "longitude").alias("p"))
    return xy.select("event_id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query(
    f"""WITH {SET}, {DET}, {views.LOSSES}, f AS (SELECT park_id, count(*) AS n FROM detections GROUP BY 1), s AS (SELECT park_id, count(*) AS n FROM settlements GROUP BY 1), l AS (SELECT park_id, sum(area_km2) AS km2 FROM losses GROUP BY 1)
SELECT park_id, name, 'x' AS country, printf('%.2f', area_km2) AS area_km2, CAST(coalesce(f.n, 0) AS VARCHAR) AS fire_count, CAST(coalesce(s.n, 0) AS VARCHAR) AS settlement_count, printf('%.4f', coalesce(km2, 0)) AS deforestation_km2,
  printf('%.2f', CASE WHEN area_km2 > 0 THEN area_km2 / 28 ELSE 0 END) AS roadless_pct FROM parks LEFT JOIN f USING (park_id) LEFT JOIN s USING (park_id) LEFT JOIN l USING (park_id)"""
)
def parks_export_full(spark, sf_dir):
    """The export with all four of its aggregates."""
    parks = view(spark, sf_dir, "parks")

    def counted(name: str, column: str):
        return view(spark, sf_dir, name).groupBy("park_id").agg(F.count(F.lit(1)).alias(column))

    lost = views.losses(spark, sf_dir).groupBy("park_id").agg(F.sum("area_km2").alias("deforestation_km2"))
    roadless = parks.where("area_km2 > 0").select("park_id", (F.col("area_km2") / 28).alias("roadless_pct"))
    areas = parks.select(F.col("park_id").alias("id"), "name", F.lit("x").alias("country"), "area_km2")
    return sinks.parks_export(areas, counted("detections", "fire_count"), counted("settlements", "settlement_count"), lost, roadless)


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, count(DISTINCT o_custkey % 50) AS active_pixels, sum(CAST(floor(o_totalprice / 1000e0) AS DOUBLE)) AS total_distance_km FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AND year(o_orderdate) BETWEEN 1994 AND 1996 GROUP BY 1")
def effort_of_years(spark, sf_dir):
    from acacia.operators import effort

    return effort.by_year(view(spark, sf_dir, "effort").where(F.col("year").between(1994, 1996)))


@query(f"WITH {DET} SELECT event_id, CASE WHEN value < 1 THEN 'stationary' WHEN value < 3 THEN 'slow_patrol' WHEN value < 6 THEN 'fast_patrol' WHEN value < 30 THEN 'slow_vehicle' WHEN value < 80 THEN 'fast_vehicle' WHEN value < 150 THEN 'low_altitude' ELSE 'high_altitude' END AS category, CASE WHEN value < 6 THEN 'foot' WHEN value < 80 THEN 'vehicle' ELSE 'aircraft' END AS movement FROM events")
def speed_categories(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", classify.speed_category("value").alias("category"), classify.analysis_movement("value").alias("movement"))

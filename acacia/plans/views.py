"""The domain's tables, derived from the given ones.

There are no geographic tables to test on, so detections, tracks, pixels and the rest are derived from
the given tables by arithmetic. The expressions are valid in Spark and in DuckDB; the SQL twins of the
queries use them as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acacia.functions import geo

#: view name -> (table, select list)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "detections": (
        "events",
        [
            "event_id",
            "ts",
            "user_id",
            "CAST(ts AS DATE) AS acq_date",
            "value AS frp",
            "concat('p', CAST(user_id % 6 AS STRING)) AS park_id",
            "(event_id * 31) % 10 < 4 AS inside",
            "9.0e0 - CAST(user_id % 20 % 5 AS DOUBLE) - CAST(day(ts) AS DOUBLE) * 0.05e0 * CAST(user_id % 20 % 3 AS DOUBLE) + CAST((event_id * 7919) % 101 - 50 AS DOUBLE) / 1000e0 + 0.0003e0 AS latitude",
            "20.0e0 + CAST(floor(CAST(user_id % 20 AS DOUBLE) / 5e0) AS DOUBLE) * 1.5e0 + CAST((event_id * 104729) % 97 - 48 AS DOUBLE) / 1000e0 + 0.0003e0 AS longitude",
        ],
    ),
    "places": (
        "supplier",
        [
            "s_suppkey AS id",
            "concat('p', CAST(s_suppkey % 6 AS STRING)) AS park_id",
            "CASE s_suppkey % 5 WHEN 0 THEN 'village' WHEN 1 THEN 'town' WHEN 2 THEN 'river' WHEN 3 THEN 'hamlet' ELSE 'stream' END AS place_type",
            "s_name AS name",
            "4e0 + CAST(s_suppkey * 53 % 600 AS DOUBLE) / 100e0 AS lat",
            "20e0 + CAST(s_suppkey * 97 % 600 AS DOUBLE) / 100e0 AS lon",
        ],
    ),
    "effort": (
        "orders",
        [
            "o_orderkey AS upload_id",
            "concat('c', CAST(o_custkey % 50 AS STRING)) AS grid_cell_id",
            "year(o_orderdate) AS year",
            "month(o_orderdate) AS month",
            "CASE WHEN o_orderkey % 7 = 0 THEN day(o_orderdate) END AS day",
            "CASE WHEN o_orderkey % 3 = 0 THEN 'foot' ELSE 'all' END AS movement_type",
            "CAST(floor(o_totalprice / 1000e0) AS DOUBLE) AS total_distance_km",
            "o_orderkey % 100 AS total_points",
            "o_custkey % 4 AS unique_uploads",
            "CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 90 END AS DOUBLE) AS coverage_percent",
        ],
    ),
    "cells": (
        "customer",
        [
            "concat('c', CAST(c_custkey AS STRING)) AS id",
            "CAST(c_custkey % 20 AS DOUBLE) / 10e0 AS lat_center",
            "CAST(c_custkey % 30 AS DOUBLE) / 10e0 AS lon_center",
        ],
    ),
    "pixels": (
        "part",
        [
            "concat('p', CAST(p_partkey % 3 AS STRING)) AS park_id",
            "concat('t', CAST(p_partkey % 2 AS STRING)) AS tile",
            "CASE WHEN p_partkey % 4 = 0 THEN 'ring' ELSE 'interior' END AS zone",
            "CAST(floor(CAST(p_partkey AS DOUBLE) / 50e0) AS INT) AS r",
            "CAST(p_partkey % 50 AS INT) AS c",
            "p_size AS value",
            "p_size % 25 AS code",
            "-5e0 + CAST(p_partkey % 1000 AS DOUBLE) / 100e0 AS lat",
            "20e0 + CAST(p_partkey % 70 AS DOUBLE) / 10e0 AS lon",
        ],
    ),
    "settlements": (
        "customer",
        [
            "c_custkey AS id",
            "concat('p', CAST(c_nationkey % 6 AS STRING)) AS park_id",
            "abs(c_acctbal) AS area_m2",
            "CAST(c_custkey % 40 AS INT) AS pixels",
            "CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 9 ELSE 0 END AS DOUBLE) AS pixel_population",
            "c_custkey % 500 AS population_est",
            "CAST(c_custkey * 37 % 400 AS DOUBLE) / 64e0 AS lat",
            "CAST(c_custkey * 53 % 300 AS DOUBLE) / 64e0 AS lon",
        ],
    ),
    "parks": ("nation", ["concat('p', CAST(n_nationkey AS STRING)) AS park_id", "n_name AS name", "CAST((n_nationkey * 13) % 7 AS DOUBLE) * 400e0 AS area_km2"]),
    "points": (
        "lineitem",
        [
            "concat('f', CAST(l_suppkey AS STRING)) AS file",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_quantity",
            "l_extendedprice",
            "l_suppkey",
        ],
    ),
}

#: Fixed test areas: id, buffer in km, rings of [lon, lat]; one has a hole, one is concave, some overlap.
AREAS = (
    ("a0", 5.0, [[[19.9, 5.0], [21.6, 4.5], [22.1, 8.2], [20.3, 8.6], [19.9, 5.0]]]),
    ("a1", 0.0, [[[21.3, 3.0], [23.6, 3.0], [23.6, 7.0], [21.3, 7.0], [21.3, 3.0]], [[22.0, 4.0], [23.0, 4.0], [23.0, 5.5], [22.0, 5.5], [22.0, 4.0]]]),
    ("a2", 10.0, [[[23.0, 2.0], [25.0, 2.0], [25.0, 9.0], [24.4, 9.0], [24.4, 4.0], [23.0, 4.0], [23.0, 2.0]]]),
    ("a3", 2.0, [[[20.2, 1.5], [22.2, 1.5], [21.1, 4.4]]]),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return read(spark, sf_dir, table).selectExpr(*columns)


def areas(spark: SparkSession) -> DataFrame:
    rows = [(i, name, rings, buffer) for i, (name, buffer, rings) in enumerate(AREAS)]
    return spark.createDataFrame(rows, "ord int, id string, rings array<array<array<double>>>, buffer_km double")


def infractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly totals of each park."""
    rows = read(spark, sf_dir, "orders").selectExpr("concat('p', CAST(o_custkey % 6 AS STRING)) AS park_id", "year(o_orderdate) AS year", "o_orderkey AS k")
    return rows.groupBy("park_id", "year").agg(
        (F.sum(F.col("k") % 7) % 40).alias("total_groups"), (F.sum(F.col("k") % 5) % 13).alias("groups_stopped_inside"), (F.sum(F.col("k") % 3) % 11).alias("groups_transited"), (F.sum(F.col("k") % 11) % 12).cast("double").alias("avg_days_burning")
    )


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly forest loss of each park, in sixteenths of a km2."""
    rows = read(spark, sf_dir, "orders").selectExpr("concat('p', CAST(o_custkey % 6 AS STRING)) AS park_id", "year(o_orderdate) + 15 + CAST(o_custkey % 2 AS INT) * 7 AS year", "o_orderkey AS k", "o_custkey AS q")
    return rows.groupBy("park_id", "year").agg(
        ((F.sum(F.col("k") % 97) % 400) / F.lit(16.0)).alias("area_km2"), (F.avg(F.col("q") % 8) / F.lit(1.0)).alias("lat"), (F.avg(F.col("k") % 8) + 20).alias("lon")
    )


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track for each supplier: a point every 97 seconds, some without time, drifting north-east with jitter."""
    rows = view(spark, sf_dir, "points")
    numbered = rows.selectExpr("*", "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n")
    return numbered.selectExpr(
        "file", "0 AS track_no", "0 AS seg_no", "CAST(n AS INT) AS pt_no", "1e0 + CAST(n AS DOUBLE) / 512e0 + CAST(l_partkey % 16 AS DOUBLE) / 1024e0 AS lat",
        "20e0 + CAST(n AS DOUBLE) / 1024e0 + CAST(l_orderkey % 16 AS DOUBLE) / 1024e0 AS lon",
        "CASE WHEN l_partkey % 11 <> 0 THEN timestamp_seconds(1704067200 + n * 97) END AS ts", "CASE WHEN l_partkey % 9 = 0 THEN 'Tracking' WHEN l_partkey % 10 = 0 THEN concat('seen ', l_partkey) ELSE '' END AS description",
    )


# --- The same for DuckDB -------------------------------------------------------------------------


def cte(*names: str) -> str:
    """Common table expressions of views, for the SQL twins."""
    parts = []
    for name in names:
        table, columns = VIEWS[name]
        parts.append(f"{name} AS (SELECT {', '.join(columns)} FROM {table})".replace("AS STRING)", "AS VARCHAR)"))
    return ",\n".join(parts)


def _edge_rows() -> str:
    rows = []
    for i, (name, buffer, rings) in enumerate(AREAS):
        for ring, corners in enumerate(rings):
            for k, (x1, y1) in enumerate(corners):
                x2, y2 = corners[(k + 1) % len(corners)]
                rows.append(f"({i}, '{name}', {buffer}e0, {ring}, {x1}e0, {y1}e0, {x2}e0, {y2}e0)")
    return ", ".join(rows)


EDGES = f"edges(ord, id, buffer_km, ring, x1, y1, x2, y2) AS (VALUES {_edge_rows()})"
CROSSES = "((y1 > latitude) <> (y2 > latitude)) AND longitude < (x2 - x1) * (latitude - y1) / (CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END) + x1"
_T = "CASE WHEN (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, ((longitude-x1)*(x2-x1)+(latitude-y1)*(y2-y1)) / ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) END"
NEAR = f"(longitude - (x1 + ({_T}) * (x2-x1))) * (longitude - (x1 + ({_T}) * (x2-x1))) + (latitude - (y1 + ({_T}) * (y2-y1))) * (latitude - (y1 + ({_T}) * (y2-y1)))"
#: Areas of each detection: in the buffered sense (outer ring or near it), and strictly.
IN_AREAS = f"""{EDGES},
buffered AS (
  SELECT event_id, ord, id FROM detections, edges WHERE ring = 0 GROUP BY event_id, ord, id, buffer_km
  HAVING sum(CASE WHEN {CROSSES} THEN 1 ELSE 0 END) % 2 = 1 OR (buffer_km > 0 AND min({NEAR}) <= (buffer_km / 111e0) * (buffer_km / 111e0))
),
strict AS (
  SELECT event_id, ord, id FROM detections, edges GROUP BY event_id, ord, id HAVING sum(CASE WHEN {CROSSES} THEN 1 ELSE 0 END) % 2 = 1
),
located AS (SELECT d.*, b.id AS area_id FROM detections d LEFT JOIN (SELECT event_id, min_by(id, ord) AS id FROM buffered GROUP BY event_id) b USING (event_id))"""


def haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))"
    return f"(12742e0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    x = f"(degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360)"
    return f"({x} - 360 * floor({x} / 360))"


def words(degrees: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in geo.WORDS) + f"][CAST(floor(({degrees} + 11.25) / 22.5) AS INT) % 16 + 1]"


def located(points: str, name: str) -> str:
    """Common table expressions up to ``name``: points (point_id, park_id, lat, lon) with a description of where they lie."""
    parts = []
    for kind, types in (("town", "'village', 'hamlet', 'town', 'city'"), ("river", "'river', 'stream'")):
        km = haversine("q.lat", "q.lon", "p.lat", "p.lon")
        parts.append(
            f"""{name}_{kind} AS (SELECT q.point_id, p.name, {km} AS km, p.lat AS y, p.lon AS x FROM {points} q JOIN places p ON p.park_id = q.park_id AND abs(p.lat - q.lat) <= 1 AND abs(p.lon - q.lon) <= 1
  WHERE p.place_type IN ({types}) QUALIFY row_number() OVER (PARTITION BY q.point_id ORDER BY {km}, p.id) = 1)"""
        )
    far = "printf('%.0f', {k}.km) || ' km ' || " + words(bearing("{k}.y", "{k}.x", "q.lat", "q.lon")) + " || ' of {article}' || {k}.name"
    town = "CASE WHEN t.km < 5 THEN 'near ' || t.name WHEN t.km < 30 THEN " + far.replace("{k}", "t").replace("{article}", "") + " END"
    river = "CASE WHEN r.km < 3 THEN 'along the ' || r.name WHEN r.km < 20 THEN " + far.replace("{k}", "r").replace("{article}", "the ") + " END"
    known = f"nullif(concat_ws(', ', {town}, {river}), '')"
    spot = "'at coordinates (' || printf('%.3f', q.lat) || '°, ' || printf('%.3f', q.lon) || '°)'"
    parts.append(f"{name} AS (SELECT q.*, coalesce({known}, {spot}) AS location FROM {points} q LEFT JOIN {name}_town t USING (point_id) LEFT JOIN {name}_river r USING (point_id))")
    return ",\n".join(parts)


def density_clusters(eps_km: float, least: int, day_least: int) -> str:
    """Common table expressions up to ``clustered``: detections with ``cid``, the number of their density cluster, for each park's day."""
    eps = f"({eps_km}e0 / 111e0)"
    return f"""pts AS (
  SELECT *, row_number() OVER (ORDER BY park_id, acq_date, latitude, longitude, frp, event_id) AS i FROM detections QUALIFY count(*) OVER (PARTITION BY park_id, acq_date) >= {day_least}
),
near AS (
  SELECT a.i, b.i AS j FROM pts a JOIN pts b ON a.park_id = b.park_id AND a.acq_date = b.acq_date
  WHERE (a.latitude - b.latitude) * (a.latitude - b.latitude) + (a.longitude - b.longitude) * (a.longitude - b.longitude) <= {eps} * {eps}
),
core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= {least}),
linked AS (SELECT i, j FROM near JOIN core USING (i) JOIN (SELECT i AS j FROM core) USING (j)),
reach(i, j) AS (SELECT i, i FROM core UNION SELECT r.i, l.j FROM reach r JOIN linked l ON l.i = r.j),
label AS (SELECT i, min(j) AS first FROM reach GROUP BY i),
members AS (SELECT i, first FROM label UNION ALL SELECT n.i, min(first) FROM near n JOIN label l ON l.i = n.j WHERE n.i NOT IN (SELECT i FROM core) GROUP BY n.i),
clustered AS (SELECT p.*, CAST(dense_rank() OVER (PARTITION BY park_id, acq_date ORDER BY first) - 1 AS INT) AS cid FROM pts p JOIN members USING (i))"""


INFRACTIONS = """infractions AS (
  SELECT concat('p', CAST(o_custkey % 6 AS VARCHAR)) AS park_id, CAST(year(o_orderdate) AS INT) AS year, CAST(sum(o_orderkey % 7) % 40 AS BIGINT) AS total_groups,
    CAST(sum(o_orderkey % 5) % 13 AS BIGINT) AS groups_stopped_inside, CAST(sum(o_orderkey % 3) % 11 AS BIGINT) AS groups_transited, CAST(sum(o_orderkey % 11) % 12 AS DOUBLE) AS avg_days_burning
  FROM orders GROUP BY 1, 2
)"""
LOSSES = """losses AS (
  SELECT concat('p', CAST(o_custkey % 6 AS VARCHAR)) AS park_id, CAST(year(o_orderdate) + 15 + (o_custkey % 2) * 7 AS INT) AS year, CAST(sum(o_orderkey % 97) % 400 AS DOUBLE) / 16e0 AS area_km2,
    avg(o_custkey % 8) AS lat, avg(o_orderkey % 8) + 20 AS lon
  FROM orders GROUP BY 1, 2
)"""
TRACKS = """numbered AS (
  SELECT concat('f', CAST(l_suppkey AS VARCHAR)) AS file, *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n FROM lineitem
),
track_points AS (
  SELECT file, CAST(n AS INT) AS pt_no, 1e0 + CAST(n AS DOUBLE) / 512e0 + CAST(l_partkey % 16 AS DOUBLE) / 1024e0 AS lat, 20e0 + CAST(n AS DOUBLE) / 1024e0 + CAST(l_orderkey % 16 AS DOUBLE) / 1024e0 AS lon,
    CASE WHEN l_partkey % 11 <> 0 THEN 1704067200 + n * 97 END AS s,
    CASE WHEN l_partkey % 9 = 0 THEN 'Tracking' WHEN l_partkey % 10 = 0 THEN concat('seen ', CAST(l_partkey AS VARCHAR)) ELSE '' END AS description
  FROM numbered
)"""

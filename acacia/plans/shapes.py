"""Registered queries on polygons, rasters under polygons and roads, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from acacia.functions import projection
from acacia.operators import merge, roads, shapes
from acacia.plans import views
from acacia.plans.catalog import _d, query
from acacia.plans.views import read, view

#: Corners of a star about each place: two radii in turn, and a square hole.
_CORNERS, _TILE = 16, 0.5
_RADIUS = "(0.2e0 + CAST(id % 7 AS DOUBLE) / 10e0)"
_HOLE = ((-0.05, -0.05), (0.05, -0.05), (0.05, 0.05), (-0.05, 0.05))


def stars(spark, sf_dir):
    """A concave polygon with a hole about each place."""
    corners = F.transform(F.sequence(F.lit(0), F.lit(_CORNERS - 1)), lambda k: F.struct(((k % 2) * -0.5 + 1).alias("f"), (k * (2.0 / _CORNERS) * F.pi()).alias("w")))
    outer = F.transform(corners, lambda k: F.array(F.col("lon") + F.expr(_RADIUS) * k["f"] * F.cos(k["w"]), F.col("lat") + F.expr(_RADIUS) * k["f"] * F.sin(k["w"])))
    hole = F.array(*[F.array(F.col("lon") + x, F.col("lat") + y) for x, y in _HOLE])
    return view(spark, sf_dir, "places").select("id", F.array(outer, hole).alias("rings"))


#: The area under an edge inside a tile, in closed form: the integral of a line held between the tile's lower and upper border.
_UNDER = "CASE WHEN {f} <= 0 THEN 0e0 WHEN {f} <= 0.5e0 THEN {f} * {f} / 2 ELSE 0.125e0 + 0.5e0 * ({f} - 0.5e0) END"


@query(
    f"""WITH {views.cte("places")},
c AS (SELECT id, 1 AS sign, k, 16 AS n, lon + {_RADIUS} * (1e0 - (k % 2) * 0.5e0) * cos(k * 0.125e0 * pi()) AS x, lat + {_RADIUS} * (1e0 - (k % 2) * 0.5e0) * sin(k * 0.125e0 * pi()) AS y FROM places, range(16) t(k)
  UNION ALL SELECT id, -1, k, 4, lon + dx, lat + dy FROM places, (VALUES {", ".join(f"({k}, {x}e0, {y}e0)" for k, (x, y) in enumerate(_HOLE))}) t(k, dx, dy)),
e AS (SELECT a.id, a.sign, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM c a JOIN c b ON a.id = b.id AND a.sign = b.sign AND b.k = (a.k + 1) % a.n),
t AS (SELECT id, tr, tc FROM (SELECT id, unnest(range(CAST(floor(min(y) / 0.5e0) AS BIGINT), CAST(floor(max(y) / 0.5e0) AS BIGINT) + 1)) AS tr, min(x) AS low, max(x) AS high FROM c GROUP BY id), range(0, 100) u(tc) WHERE tc BETWEEN floor(low / 0.5e0) AND floor(high / 0.5e0)),
s AS (SELECT id, sign, tr, tc, xa, xb, ya, yb, greatest(least(xa, xb), tc * 0.5e0) AS u0, least(greatest(xa, xb), (tc + 1) * 0.5e0) AS u1 FROM e JOIN t USING (id)),
f AS (SELECT *, ya + (yb - ya) * ((u0 - xa) / (xb - xa)) - tr * 0.5e0 AS f0, ya + (yb - ya) * ((u1 - xa) / (xb - xa)) - tr * 0.5e0 AS f1 FROM s WHERE u1 > u0),
p AS (SELECT id, sign, tr, tc, sum(sign(xb - xa) * (u1 - u0) * CASE WHEN abs(f1 - f0) < 1e-9 THEN greatest(0e0, least(0.5e0, f0)) ELSE (({_UNDER.format(f="f1")}) - ({_UNDER.format(f="f0")})) / (f1 - f0) END) AS a FROM f GROUP BY ALL)
SELECT id, CAST(tr AS BIGINT) AS tile_row, CAST(tc AS BIGINT) AS tile_col, round(sum(sign * abs(a)), 6) AS area FROM p GROUP BY 1, 2, 3 HAVING sum(sign * abs(a)) > 1e-7"""
)
def clipped_tile_areas(spark, sf_dir):
    """Areas of the pieces into which half-degree tiles cut a concave polygon with a hole about each place."""
    pieces = shapes.clipped_by_tiles(stars(spark, sf_dir), _TILE)
    return pieces.where("area > 1e-7").select("id", "tile_row", "tile_col", *_d("area"))


#: A raster over the test areas; its origin keeps pixel centres off the areas' edges.
_GRID = shapes.Grid(19.0013, 10.0007, 0.02)
_REACH = 10 / 111.0
_RASTER = """px AS (SELECT r, c, built, population, 10.0007e0 - (r + 0.5e0) * 0.02e0 AS latitude, 19.0013e0 + (c + 0.5e0) * 0.02e0 AS longitude FROM (SELECT l_orderkey * 7 % 450 AS r, (l_partkey * 13 + l_suppkey) % 350 AS c, CAST(l_quantity AS INT) - 5 AS built, CAST(l_discount * 100 AS INT) AS population FROM lineitem))"""


def raster(spark, sf_dir):
    """Pixels with built-up area and people; values below one stand for none."""
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 7 % 450 AS r", "(l_partkey * 13 + l_suppkey) % 350 AS c", "CAST(l_quantity AS INT) - 5 AS built", "CAST(l_discount * 100 AS INT) AS population")


@query(
    f"""WITH {_RASTER}, {views.EDGES},
spots AS (SELECT r, c, latitude, longitude, count(*) AS n, sum(greatest(built, 0)) AS built, sum(greatest(population, 0)) AS population FROM px GROUP BY ALL),
m AS (SELECT id, n, built, population, sum(CASE WHEN {views.CROSSES} THEN 1 ELSE 0 END) % 2 = 1 AS inside, min({views.NEAR}) <= {_REACH * _REACH!r} AS near FROM spots, edges GROUP BY id, r, c, latitude, longitude, n, built, population),
ring_ AS (SELECT id, ring, abs(sum(x1 * y2 - x2 * y1)) / 2 * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS a FROM edges GROUP BY id, ring),
area_ AS (SELECT id, sum(a) * 12321 AS km2 FROM ring_ GROUP BY id)
SELECT id, round(km2, 6) AS area_km2, round(sum(built) FILTER (inside) / 1e6, 9) AS built_up_km2, round(sum(built) FILTER (inside) / 1e6 / km2 * 100, 12) AS built_up_percentage, CAST(sum(n) FILTER (inside) AS BIGINT) AS interior_pixels,
  CAST(sum(population) FILTER (inside) AS DOUBLE) AS interior_population, round(coalesce(sum(built) FILTER (near AND NOT inside), 0) / 1e6, 9) AS buffer_built_up_km2, CAST(coalesce(sum(n) FILTER (near AND NOT inside), 0) AS BIGINT) AS ring_pixels,
  CAST(coalesce(sum(population) FILTER (near AND NOT inside), 0) AS DOUBLE) AS ring_population FROM m JOIN area_ USING (id) GROUP BY id, km2"""
)
def built_up_from_shapes(spark, sf_dir):
    """Built-up area and people inside areas and in the ring of 10 km about them, from shapes and pixels alone."""
    out = shapes.built_up_stats(raster(spark, sf_dir), views.areas(spark).select("id", "rings"), _GRID, _REACH, 12321.0)
    nine = [F.round(c, 9).alias(c) for c in ("built_up_km2", "buffer_built_up_km2")]
    return out.select("id", *_d("area_km2"), *nine, F.round("built_up_percentage", 12).alias("built_up_percentage"), "interior_pixels", "interior_population", "ring_pixels", "ring_population")


# --- Roads ---------------------------------------------------------------------------------------

_M = 1000.0
_ROWS = 40


def park_shapes(spark):
    """The test areas as parks, with their area by a flat count of degrees."""
    areas = views.areas(spark).select("id", "rings")
    return areas.join(shapes.area_of(areas), "id").select(F.col("id").alias("park_id"), "rings", (F.col("area") * 12321).alias("area_km2"))


def roads_from_places(spark, sf_dir):
    """A road of two legs from each place."""
    rows = view(spark, sf_dir, "places")
    ends = [(0.0, 0.0), (0.11, 0.07), (0.05, 0.2)]
    return rows.select(F.col("id").alias("road_id"), F.array(*[F.struct((F.col("lat") + y).alias("lat"), (F.col("lon") + x).alias("lon")) for y, x in ends]).alias("points"))


def _utm_sql(lat: str, lon: str, epsg: str) -> tuple[str, str]:
    phi, lam = f"radians({lat})", f"radians({lon} - (({epsg} % 100) * 6 - 183))"
    e = projection._E
    t = f"sinh(atanh(sin({phi})) - {e!r} * atanh({e!r} * sin({phi})))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    k = projection._SCALE * projection._RECTIFYING
    east = " + ".join([eta] + [f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(projection._ALPHA, 1)])
    north = " + ".join([xi] + [f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(projection._ALPHA, 1)])
    return f"500000e0 + {k!r} * ({east})", f"{k!r} * ({north})"


_PX, _PY = _utm_sql("lat", "lon", "epsg")
_STEP = _M / _ROWS
_Y = f"(-(r + 0.5e0) * {_STEP!r})"
_DISC = "CASE WHEN abs(y - {y}) <= {m} THEN sqrt({m} * {m} - (y - {y}) * (y - {y})) END"
_SIDE = "CASE WHEN y2 <> y1 AND (y - y1 - {s} * (x2 - x1) / l * {m}) / (y2 - y1) BETWEEN 0 AND 1 THEN x1 - {s} * (y2 - y1) / l * {m} + (y - y1 - {s} * (x2 - x1) / l * {m}) / (y2 - y1) * (x2 - x1) END"
_ENDS = ", ".join([f"{x} {sign} {_DISC.format(y=y, m=_M)}" for x, y in (("x1", "y1"), ("x2", "y2")) for sign in "-+"] + [_SIDE.format(s=s, m=_M) for s in (1, -1)])


@query(
    f"""WITH {views.cte("places")}, {views.EDGES},
pt AS (SELECT id AS road, k, lat + dy AS lat, lon + dx AS lon FROM places, (VALUES (0, 0e0, 0e0), (1, 0.11e0, 0.07e0), (2, 0.05e0, 0.2e0)) v(k, dy, dx)),
leg_ AS (SELECT a.road, a.k, a.lat AS ya, a.lon AS xa, b.lat AS yb, b.lon AS xb FROM pt a JOIN pt b ON a.road = b.road AND b.k = a.k + 1),
deg AS (SELECT id, road FROM pt, edges GROUP BY id, road, k, lat, lon HAVING sum(CASE WHEN ((y1 > lat) <> (y2 > lat)) AND lon < (x2 - x1) * (lat - y1) / (CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END) + x1 THEN 1 ELSE 0 END) % 2 = 1
  UNION SELECT id, road FROM leg_, edges WHERE ((x2 - x1) * (ya - y1) - (y2 - y1) * (xa - x1)) * ((x2 - x1) * (yb - y1) - (y2 - y1) * (xb - x1)) <= 0 AND ((xb - xa) * (y1 - ya) - (yb - ya) * (x1 - xa)) * ((xb - xa) * (y2 - ya) - (yb - ya) * (x2 - xa)) <= 0 AND (x1 <> x2 OR y1 <> y2)),
zone_ AS (SELECT id, 32601 + CAST(floor((sum(x) / sum(w) + 180) / 6) AS INT) AS epsg FROM (SELECT id, sum(x1 * y2 - x2 * y1) AS w0, abs(w0) * CASE WHEN ring = 0 THEN 1 ELSE -1 END AS w, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / 3 / w0 * w AS x FROM edges GROUP BY id, ring) GROUP BY id),
m AS (SELECT id, road, k, {_PX} AS x, {_PY} AS y FROM pt JOIN deg USING (road) JOIN zone_ USING (id)),
seg AS (SELECT DISTINCT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS l FROM m a JOIN m b ON b.id = a.id AND b.road = a.road AND b.k = a.k + 1),
row_ AS (SELECT *, {_Y} AS y FROM (SELECT *, unnest(range(CAST(floor((-greatest(y1, y2) - {_M}) / {_STEP!r} - 0.5e0) AS BIGINT), CAST(ceil((-least(y1, y2) + {_M}) / {_STEP!r} - 0.5e0) AS BIGINT) + 1)) AS r FROM seg)),
span AS (SELECT id, r, y, list_min(v) AS low, list_max(v) AS high FROM (SELECT id, r, y, [{_ENDS}] AS v FROM row_) WHERE list_max(v) IS NOT NULL),
edge AS (SELECT id, {_PX.replace("lat", "y1").replace("lon", "x1")} AS x1, {_PY.replace("lat", "y1").replace("lon", "x1")} AS y1, {_PX.replace("lat", "y2").replace("lon", "x2")} AS x2, {_PY.replace("lat", "y2").replace("lon", "x2")} AS y2 FROM edges JOIN zone_ USING (id)),
spot AS (SELECT id, r, y, low, high, greatest(low, coalesce(max(high) OVER (PARTITION BY id, r ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), low)) AS new_low FROM span),
free AS (SELECT id, r, y, new_low AS low, high FROM spot WHERE high > new_low),
cut AS (SELECT DISTINCT r, y, f.id, (x2 - x1) * (y - y1) / (y2 - y1) + x1 AS x FROM (SELECT DISTINCT id, r, y FROM free) f JOIN edge e ON e.id = f.id AND (y1 > y) <> (y2 > y)),
pair AS (SELECT id, r, x AS low, lead(x) OVER (PARTITION BY id, r ORDER BY x) AS high, row_number() OVER (PARTITION BY id, r ORDER BY x) AS n FROM cut)
SELECT f.id AS park_id, round(sum(greatest(0e0, least(f.high, p.high) - greatest(f.low, p.low))) * {_STEP!r} / 1e6, 6) AS roaded_area_km2 FROM free f JOIN pair p ON f.id = p.id AND f.r = p.r AND p.n % 2 = 1 GROUP BY 1"""
)
def roaded_areas(spark, sf_dir):
    """How much of each park lies within a distance of the roads that meet it, overlapping buffers once."""
    parks = park_shapes(spark)
    of_parks = roads.crossing(roads.roads_of_parks(roads_from_places(spark, sf_dir), parks), parks)
    return roads.roaded_area(of_parks, parks, _M, _ROWS).select("park_id", *_d("roaded_area_km2"))


@query()
def road_statistics(spark, sf_dir):
    """Lengths, densities and roadless shares of all parks; lengths are geodesics, which SQL lacks."""
    return roads.statistics(roads_from_places(spark, sf_dir), park_shapes(spark))


# --- Tiles ---------------------------------------------------------------------------------------

_TILES = "CAST(p_partkey % 8 AS INT)"


@query(
    f"""WITH t AS (SELECT concat('p', CAST(p_partkey % 3 AS VARCHAR)) AS park_id, {_TILES} AS tile, CAST(sum(p_size) AS BIGINT) AS built_m2, count(*) AS settlements FROM part GROUP BY 1, 2)
SELECT park_id, CAST(sum(built_m2) AS BIGINT) AS built_m2, CAST(sum(settlements) AS BIGINT) AS settlements, arg_min(built_m2 % 100, tile) AS share, count(*) AS tiles_available FROM t GROUP BY 1"""
)
def tile_sums_replayed(spark, sf_dir):
    """Sums of parks from two batches of tiles, of which the second brings two tiles again."""
    rows = read(spark, sf_dir, "part").selectExpr("concat('p', CAST(p_partkey % 3 AS STRING)) AS park_id", f"{_TILES} AS tile", "p_size")
    tiles = rows.groupBy("park_id", "tile").agg(F.sum("p_size").alias("built_m2"), F.count(F.lit(1)).alias("settlements")).withColumn("share", F.col("built_m2") % 100)
    sums, firsts = ["built_m2", "settlements"], ["share"]
    target, taken = tiles.where("false").withColumn("tiles_available", F.lit(0).cast("long")).drop("tile"), tiles.where("false").select("park_id", "tile")
    for batch in (tiles.where("tile <= 4"), tiles.where("tile >= 3")):
        target, taken = merge.add_tiles(target, taken, batch, "park_id", sums, firsts)
    return target

"""Roads of parks: lengths, and the area within a distance of any road.

What lies within a distance of a road is the union of its legs' capsules. The union is swept in rows: each capsule
has one span on a row, overlapping spans become one, and what the park's own spans share with them is
summed. Rows of a park are independent of each other, so no task holds a park's roads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acacia.functions import geo, projection
from acacia.operators import shapes, spatial

#: Metres on either side of a road, rows to that width (0.1 % of a disc's area), the simplification in degrees, and the degrees about a park in which roads count.
BUFFER_M, ROWS, SIMPLE, NEAR = 1000.0, 40, 0.001, 0.1


def roads_of_parks(roads: DataFrame, parks: DataFrame, reach: float = NEAR) -> DataFrame:
    """A row for each road (road_id, points) and park (park_id, rings) whose boxes, the park's wider by ``reach`` degrees, overlap. Boxes meet by one-degree cells, each pair in one of them."""
    xs, ys = (F.transform("points", lambda p: p[c]) for c in ("lon", "lat"))
    road = roads.where(F.size("points") > 0).select("road_id", "points", *(f(v).alias(n) for n, f, v in (("x1", F.array_min, xs), ("x2", F.array_max, xs), ("y1", F.array_min, ys), ("y2", F.array_max, ys))))
    box = geo.ring_bbox(F.flatten("rings"))
    park = parks.select("park_id", (box["lon_min"] - reach).alias("px1"), (box["lon_max"] + reach).alias("px2"), (box["lat_min"] - reach).alias("py1"), (box["lat_max"] + reach).alias("py2"))

    def spread(df: DataFrame, x1: str, x2: str, y1: str, y2: str) -> DataFrame:
        return df.withColumn("cell_x", F.explode(F.sequence(F.floor(x1), F.floor(x2)))).withColumn("cell_y", F.explode(F.sequence(F.floor(y1), F.floor(y2))))

    met = spread(road, "x1", "x2", "y1", "y2").join(spread(park, "px1", "px2", "py1", "py2"), ["cell_x", "cell_y"])
    apart = (F.col("x1") > F.col("px2")) | (F.col("px1") > F.col("x2")) | (F.col("y1") > F.col("py2")) | (F.col("py1") > F.col("y2"))
    first = (F.col("cell_x") == F.floor(F.greatest("x1", "px1"))) & (F.col("cell_y") == F.floor(F.greatest("y1", "py1")))
    return met.where(~apart & first).select("park_id", "road_id", "points")


def centroid(parks: DataFrame) -> DataFrame:
    """park_id with lat and lon of the area's centre, holes taken out."""
    n = F.size("corners")
    x0, y0 = F.col("corners")[0]["x"], F.col("corners")[0]["y"]

    def turn(i: Column) -> Column:
        a, b = F.col("corners")[i - 1], F.col("corners")[i % n]
        ax, ay, bx, by = a["x"] - x0, a["y"] - y0, b["x"] - x0, b["y"] - y0
        w = ax * by - bx * ay
        return F.struct(w.alias("w"), (w * (ax + bx) / 3).alias("x"), (w * (ay + by) / 3).alias("y"))

    turns = shapes.rings_of(parks, "park_id").withColumn("turns", F.transform(F.sequence(F.lit(1), n), turn))
    sums = {c: F.aggregate(F.transform("turns", lambda t: t[c]), F.lit(0.0), lambda a, v: a + v) for c in ("w", "x", "y")}
    whole = turns.select("park_id", "sign", x0.alias("x0"), y0.alias("y0"), *(v.alias(c) for c, v in sums.items()))
    # A ring's direction decides the sign of all three sums.
    side = F.when(F.col("w") < 0, -F.col("sign")).otherwise(F.col("sign"))
    parts = whole.groupBy("park_id").agg(
        F.sum(F.col("w") * side).alias("w"), F.sum((F.col("w") * F.col("x0") + F.col("x")) * side).alias("x"), F.sum((F.col("w") * F.col("y0") + F.col("y")) * side).alias("y")
    )
    return parts.where("w > 0").select("park_id", (F.col("y") / F.col("w")).alias("lat"), (F.col("x") / F.col("w")).alias("lon"))


def legs_of(points: Column) -> Column:
    """Pairs of neighbouring points."""
    n = F.size(points)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(points[i - 1].alias("p"), points[i].alias("q"))))


def crossing(roads: DataFrame, parks: DataFrame) -> DataFrame:
    """The rows (park_id, road_id, points) of roads that have a point inside their park (park_id, rings) or cross its edge."""
    edges = parks.select("park_id", spatial.edges(F.col("rings")).alias("edges"))

    def crosses(leg: Column, e: Column) -> Column:
        p, q = leg["p"], leg["q"]
        of_edge = [(e["x2"] - e["x1"]) * (v["lat"] - e["y1"]) - (e["y2"] - e["y1"]) * (v["lon"] - e["x1"]) for v in (p, q)]
        of_leg = [(q["lon"] - p["lon"]) * (y - p["lat"]) - (q["lat"] - p["lat"]) * (x - p["lon"]) for x, y in ((e["x1"], e["y1"]), (e["x2"], e["y2"]))]
        return (of_edge[0] * of_edge[1] <= 0) & (of_leg[0] * of_leg[1] <= 0) & ((of_edge[0] != of_edge[1]) | (of_leg[0] != of_leg[1]))

    met = roads.join(edges, "park_id").withColumn("legs", F.coalesce(legs_of(F.col("points")), F.array()))
    inside = F.exists("points", lambda p: spatial.inside(p["lat"], p["lon"], F.col("edges")))
    return met.where(inside | F.exists("legs", lambda leg: F.exists("edges", lambda e: crosses(leg, e)))).select("park_id", "road_id", "points")


def roaded_area(roads: DataFrame, parks: DataFrame, buffer_m: float = BUFFER_M, rows: int = ROWS) -> DataFrame:
    """park_id and roaded_area_km2: how much of each park (park_id, rings) lies within ``buffer_m`` of its roads (park_id, points), in the park's UTM zone."""
    grid = shapes.Grid(0.0, 0.0, buffer_m / rows)
    zone = centroid(parks).select("park_id", geo.utm_epsg("lat", "lon").alias("epsg"))

    placed = roads.join(zone, "park_id")
    # A point alone is a leg of no length.
    legs = F.when(F.size("points") > 1, legs_of(F.col("points"))).otherwise(F.array(F.struct(F.col("points")[0].alias("p"), F.col("points")[0].alias("q"))))
    legs = placed.where(F.size("points") > 0).select("park_id", "epsg", F.explode(legs).alias("leg"))
    legs = legs.select("park_id", *(projection.utm(F.col(f"leg.{v}.lat"), F.col(f"leg.{v}.lon"), F.col("epsg")).alias(v) for v in ("p", "q")))
    segments = legs.select("park_id", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2")).distinct()
    near = shapes.merged(shapes.capsule_spans(segments, F.lit(buffer_m), grid, "park_id"), ["park_id", "r"])

    edges = shapes.edges_of(parks, "park_id").join(zone, "park_id")
    edges = edges.select("park_id", *(projection.utm(F.col(f"y{k}"), F.col(f"x{k}"), F.col("epsg")).alias(f"c{k}") for k in (1, 2)))
    edges = edges.select("park_id", *(F.col(f"c{k}.{a}").alias(f"{a}{k}") for k in (1, 2) for a in ("x", "y")))
    inner = shapes.inner_spans(edges, grid, "park_id").groupBy("park_id", "r").agg(F.collect_list(F.struct("low", "high")).alias("inner"))

    shared = F.transform("inner", lambda s: F.greatest(F.lit(0.0), F.least(s["high"], F.col("high")) - F.greatest(s["low"], F.col("low"))))
    length = F.aggregate(shared, F.lit(0.0), lambda a, v: a + v)
    return near.join(inner, ["park_id", "r"]).groupBy("park_id").agg((F.sum(length) * grid.size / 1e6).alias("roaded_area_km2"))


def statistics(roads: DataFrame, parks: DataFrame, buffer_m: float = BUFFER_M, rows: int = ROWS, tolerance: float = SIMPLE, reach: float = NEAR) -> DataFrame:
    """Length and density of the roads about each park (park_id, rings, area_km2), and the shares of the park with and without roads.

    Lengths are geodesic and of whole roads; areas are those of simplified roads that meet the park. Parks without roads have zeros.
    """
    of_parks = roads_of_parks(roads, parks, reach)
    length = of_parks.groupBy("park_id").agg(F.count(F.lit(1)).alias("roads"), F.sum(projection.line_km("points")).alias("road_length_km"))
    simple = crossing(of_parks, parks).select("park_id", projection.simplified("points", F.lit(tolerance)).alias("points"))
    out = parks.select("park_id", "area_km2").join(length, "park_id", "left").join(roaded_area(simple, parks, buffer_m, rows), "park_id", "left")
    out = out.fillna(0, ["roads"]).fillna(0.0, ["road_length_km", "roaded_area_km2"])
    area = F.when(F.col("area_km2") > 0, F.col("area_km2"))
    return out.select(
        "park_id", "roads", "road_length_km", "roaded_area_km2", (F.col("area_km2") - F.col("roaded_area_km2")).alias("roadless_area_km2"),
        F.coalesce((F.col("area_km2") - F.col("roaded_area_km2")) / area * 100, F.lit(0.0)).alias("roadless_percentage"), F.coalesce(F.col("road_length_km") / area, F.lit(0.0)).alias("road_density"),
    )

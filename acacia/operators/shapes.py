"""Polygons cut by tiles and laid over rasters.

A polygon is a list of rings of [x, y] pairs; a ring inside an odd number of the others is a hole. Tiles cut rings
by half-planes, in array expressions. Over a raster a polygon is a set of row spans: the crossings of its edges with a row of pixel
centres, sorted and paired; everything within a distance of it adds the span of each edge's capsule. Rows follow
from edges, so a span stands for any number of pixels, and pixels meet spans packed by row and chunk of columns:
no row is made for a pixel and an area.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acacia.functions import geo
from acacia.operators import spatial

_RING = "array<struct<x: double, y: double>>"


@dataclass(frozen=True)
class Grid:
    """A raster: columns count right from ``x0`` and rows down from ``y0``, in pixels of one size."""

    x0: float
    y0: float
    size: float

    def x(self, c: Column) -> Column:
        return F.lit(self.x0) + (c + 0.5) * self.size

    def y(self, r: Column) -> Column:
        return F.lit(self.y0) - (r + 0.5) * self.size

    def first_column(self, x: Column) -> Column:
        """The first column whose centre isn't left of x."""
        return F.ceil((x - self.x0) / self.size - 0.5)

    def last_column(self, x: Column) -> Column:
        """The last column whose centre isn't right of x."""
        return F.floor((x - self.x0) / self.size - 0.5)

    def rows(self, low: Column, high: Column) -> Column:
        """All rows whose centres lie between two heights, and up to one more on either side."""
        return F.sequence(F.floor((F.lit(self.y0) - high) / self.size - 0.5), F.ceil((F.lit(self.y0) - low) / self.size - 0.5))


# --- Rings ---------------------------------------------------------------------------------------


def rings_of(areas: DataFrame, key: str = "id") -> DataFrame:
    """A row for each ring (key, ring, corners, sign) of areas (key, rings): corners without the repeated last one, sign -1 for holes."""
    with_edges = areas.select(key, "rings", spatial.edges(F.col("rings")).alias("edges"))
    out = with_edges.select(key, "edges", F.posexplode("rings").alias("ring", "pairs"))
    own = F.filter("edges", lambda e: e["ring"] == F.col("ring"))
    others = F.filter("edges", lambda e: e["ring"] != F.col("ring"))
    x, y = (own[0][a] * 0.5 + own[0][b] * 0.5 for a, b in (("x1", "x2"), ("y1", "y2")))
    hole = spatial.inside(y, x, others)
    corners = F.transform("pairs", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    closed = (F.size("pairs") > 1) & (F.col("pairs")[0] == F.element_at("pairs", -1))
    return out.where(F.size("pairs") > 0).select(key, "ring", F.when(closed, F.slice(corners, F.lit(1), F.size("pairs") - 1)).otherwise(corners).alias("corners"), F.when(hole, -1).otherwise(1).alias("sign"))


def ring_area(corners: Column) -> Column:
    """The area that a ring encloses; edges that go there and back enclose nothing."""
    n = F.size(corners)
    x0, y0 = corners[0]["x"], corners[0]["y"]
    each = F.transform(F.sequence(F.lit(1), n), lambda i: (corners[i - 1]["x"] - x0) * (corners[i % n]["y"] - y0) - (corners[i % n]["x"] - x0) * (corners[i - 1]["y"] - y0))
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(each, F.lit(0.0), lambda a, v: a + v)) / 2)


def half_plane(corners: Column, axis: str, limit: Column, upper: bool) -> Column:
    """The part of a ring on one side of a line across an axis. Parts that fall apart stay joined along the line, which changes no area."""
    other = "y" if axis == "x" else "x"
    n = F.size(corners)

    def kept(p: Column) -> Column:
        return p[axis] >= limit if upper else p[axis] <= limit

    def passed(i: Column) -> Column:
        p, q = corners[i - 1], corners[i % n]
        span = F.when(q[axis] == p[axis], F.lit(1.0)).otherwise(q[axis] - p[axis])
        at = p[other] + (q[other] - p[other]) * ((limit - p[axis]) / span)
        cut = F.struct((limit if axis == "x" else at).alias("x"), (at if axis == "x" else limit).alias("y"))
        none = F.array().cast(_RING)
        return F.when(kept(p), F.when(kept(q), F.array(q)).otherwise(F.array(cut))).otherwise(F.when(kept(q), F.array(cut, q)).otherwise(none))

    return F.when(n == 0, F.array().cast(_RING)).otherwise(F.flatten(F.transform(F.sequence(F.lit(1), n), passed)))


def clipped_by_tiles(areas: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0, key: str = "id") -> DataFrame:
    """key, tile_row, tile_col, rings (corners and sign) and area of the pieces into which tiles cut areas (key, rings).

    Tiles count right and up from the origin. A ring is cut into columns first, and only a column's part into rows.
    """

    def between(axis: str) -> Column:
        low, high = (f(F.transform("corners", lambda p: p[axis])) for f in (F.array_min, F.array_max))
        start = x0 if axis == "x" else y0
        return F.when(F.size("corners") >= 3, F.sequence(F.floor((low - start) / size), F.floor((high - start) / size)))

    # Outer generators and no filter on corners: a filter would move below the passes and repeat them.
    out = rings_of(areas, key)
    for axis, tile, start in (("x", "tile_col", x0), ("y", "tile_row", y0)):
        out = out.withColumn(tile, F.explode_outer(between(axis))).where(F.col(tile).isNotNull())
        for upper in (True, False):  # a column of its own each time: the next pass reads it often
            limit = F.lit(start) + (F.col(tile) + (0 if upper else 1)) * size
            out = out.withColumn("corners", half_plane(F.col("corners"), axis, limit, upper))
    out = out.withColumn("piece", ring_area(F.col("corners")) * F.col("sign"))
    part = F.when(F.size("corners") >= 3, F.struct("ring", "sign", "corners"))
    return out.groupBy(key, "tile_row", "tile_col").agg(
        F.array_sort(F.collect_list(part)).alias("rings"), F.sum("piece").alias("area")
    ).where("area > 0")


def area_of(areas: DataFrame, key: str = "id") -> DataFrame:
    """key and area of areas (key, rings)."""
    return rings_of(areas, key).groupBy(key).agg(F.sum(ring_area(F.col("corners")) * F.col("sign")).alias("area"))


# --- Rows ----------------------------------------------------------------------------------------


def edges_of(areas: DataFrame, key: str = "id") -> DataFrame:
    """A row for each edge (key, x1, y1, x2, y2) of areas (key, rings)."""
    return areas.select(key, F.explode(spatial.edges(F.col("rings"))).alias("e")).select(key, "e.x1", "e.y1", "e.x2", "e.y2")


def inner_spans(edges: DataFrame, grid: Grid, key: str = "id") -> DataFrame:
    """key, r, low and high: where the rows of pixel centres run inside areas, lower ends included."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    y = grid.y(F.col("r"))
    met = edges.where("y1 <> y2").withColumn("r", F.explode(grid.rows(low, high))).where((F.col("y1") > y) != (F.col("y2") > y))
    at = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    rows = met.groupBy(key, "r").agg(F.array_sort(F.collect_list(at)).alias("at"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)), lambda i: F.struct(F.col("at")[i].alias("low"), F.col("at")[i + 1].alias("high")))
    return rows.where(F.size("at") > 1).select(key, "r", F.inline(pairs))


def capsule_spans(segments: DataFrame, reach: Column, grid: Grid, key: str = "id") -> DataFrame:
    """key, r, low and high: where rows of pixel centres run within ``reach`` of segments (key, x1, y1, x2, y2), both ends included.

    What lies within a distance of a segment is convex; its ends on a row lie on one of the two discs or of the two long sides.
    """
    y = grid.y(F.col("r"))
    rows = segments.withColumn("reach", reach).withColumn("r", F.explode(grid.rows(F.least("y1", "y2") - F.col("reach"), F.greatest("y1", "y2") + F.col("reach")))).withColumn("y", y)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(dx * dx + dy * dy)
    unit = F.when(length > 0, length).otherwise(F.lit(1.0))
    ends = []
    for x, cy in (("x1", "y1"), ("x2", "y2")):
        left = F.col("reach") * F.col("reach") - (F.col("y") - F.col(cy)) * (F.col("y") - F.col(cy))
        half = F.when(left >= 0, F.sqrt(F.greatest(left, F.lit(0.0))))
        ends += [F.col(x) - half, F.col(x) + half]
    for side in (1, -1):
        sx, sy = -dy / unit * F.col("reach") * side, dx / unit * F.col("reach") * side
        t = (F.col("y") - F.col("y1") - sy) / F.when(dy == 0, F.lit(1.0)).otherwise(dy)
        ends.append(F.when((dy != 0) & t.between(0, 1), F.col("x1") + sx + t * dx))
    return rows.withColumn("ends", F.array_compact(F.array(*ends))).where(F.size("ends") > 0).select(key, "r", F.array_min("ends").alias("low"), F.array_max("ends").alias("high"))


def merged(spans: DataFrame, by: list[str], gap: float = 0.0) -> DataFrame:
    """Spans (by, low, high) that overlap, or lie no further apart than ``gap``, as one."""
    order = Window.partitionBy(*by).orderBy("low")
    reached = spans.withColumn("reached", F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    starts = (F.col("reached").isNull() | (F.col("low") > F.col("reached") + gap)).cast("int")
    numbered = reached.withColumn("part", F.sum(starts).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "part").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("part")


def zones(areas: DataFrame, grid: Grid, reach: float, touched: bool = False, key: str = "id") -> DataFrame:
    """key, zone, r, first and last: column spans of areas' insides (``interior``) and of all within ``reach`` of them, insides included (``wide``).

    A pixel counts by its centre; with ``touched`` all pixels that an edge passes count as inside, too.
    """
    edges = edges_of(areas, key)
    inner = inner_spans(edges, grid, key).select(key, "r", grid.first_column(F.col("low")).alias("low"), (grid.first_column(F.col("high")) - 1).alias("high"))
    if touched:
        inner = inner.unionByName(_passed(edges, grid, key))
    inner = merged(inner.where("low <= high"), [key, "r"], 1)
    near = capsule_spans(edges, F.lit(float(reach)), grid, key).select(key, "r", grid.first_column(F.col("low")).alias("low"), grid.last_column(F.col("high")).alias("high"))
    wide = merged(near.where("low <= high").unionByName(inner), [key, "r"], 1)
    return inner.withColumn("zone", F.lit("interior")).unionByName(wide.withColumn("zone", F.lit("wide"))).select(key, "zone", "r", F.col("low").alias("first"), F.col("high").alias("last"))


def _passed(edges: DataFrame, grid: Grid, key: str) -> DataFrame:
    """Column spans of the pixels that edges pass."""

    def row(y: Column) -> Column:
        return F.floor((F.lit(grid.y0) - y) / grid.size)

    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("r", F.explode(F.sequence(row(high), row(low))))
    top, bottom = (F.lit(grid.y0) - (F.col("r") + k) * grid.size for k in (0, 1))
    dy = F.col("y2") - F.col("y1")

    def at(y: Column) -> Column:
        """The edge's x at a height, held between its ends."""
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - F.col("y1")) / F.when(dy == 0, F.lit(1.0)).otherwise(dy)))
        return F.col("x1") + (F.col("x2") - F.col("x1")) * t

    a, b = (F.when(dy == 0, F.col(x)).otherwise(at(y)) for x, y in (("x1", top), ("x2", bottom)))
    return rows.select(key, "r", F.floor((F.least(a, b) - grid.x0) / grid.size).alias("low"), F.floor((F.greatest(a, b) - grid.x0) / grid.size).alias("high"))


def zonal_sums(pixels: DataFrame, areas: DataFrame, grid: Grid, reach: float, values: list[str], chunk: int = 256, touched: bool = False, key: str = "id") -> DataFrame:
    """Sums of positive values and counts of pixels (r, c, values) in areas (key, rings) and in the ring of width ``reach`` about each.

    Columns: key, then ``interior_`` and ``ring_`` with pixels and each value. Areas without pixels have zeros.
    Each chunk of a row's pixels is one packed row, which every span over it reads.
    """
    packed = pixels.groupBy("r", F.floor(F.col("c") / chunk).alias("chunk")).agg(F.collect_list(F.struct("c", *values)).alias("held"))
    spans = zones(areas, grid, reach, touched, key).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor(F.col("last") / chunk))))
    within = F.filter("held", lambda p: p["c"].between(F.col("first"), F.col("last")))
    met = spans.join(packed, ["r", "chunk"]).select(key, "zone", within.alias("held"))
    def total(value: str) -> Column:
        positive = F.transform("held", lambda p: F.greatest(p[value].cast("double"), F.lit(0.0)))
        return F.aggregate(positive, F.lit(0.0), lambda a, x: a + x)

    sums = {"pixels": F.size("held").cast("long")} | {v: total(v) for v in values}
    each = met.select(key, "zone", *(c.alias(n) for n, c in sums.items()))
    zone = F.col("zone") == "interior"
    totals = each.groupBy(key).agg(*(F.coalesce(F.sum(F.when(on, F.col(n))), F.lit(0)).alias(f"{name}_{n}") for n in sums for name, on in (("interior", zone), ("wide", ~zone))))
    out = areas.select(key).join(totals, key, "left").fillna(0)
    return out.select(key, *(c for n in sums for c in (F.col(f"interior_{n}"), (F.col(f"wide_{n}") - F.col(f"interior_{n}")).alias(f"ring_{n}"))))


def built_up_stats(pixels: DataFrame, areas: DataFrame, grid: Grid, reach: float, unit_km2: float, touched: bool = False) -> DataFrame:
    """Built-up area and people in areas (id, rings) and their rings, from pixels (r, c, built in m2, population) and shapes alone.

    ``unit_km2``: km2 of a square unit of the grid's coordinates, for the share of the area that is built up.
    """
    sums = zonal_sums(pixels, areas, grid, reach, ["built", "population"], touched=touched)
    out = sums.join(area_of(areas), "id", "left").withColumn("area_km2", F.coalesce(F.col("area"), F.lit(0.0)) * unit_km2)
    km2 = F.col("interior_built") / 1e6
    share = F.when(F.col("area_km2") > 0, km2 / F.when(F.col("area_km2") > 0, F.col("area_km2")) * 100).otherwise(0.0)
    return out.select(
        "id", "area_km2", km2.alias("built_up_km2"), share.alias("built_up_percentage"), "interior_pixels", "interior_population",
        (F.col("ring_built") / 1e6).alias("buffer_built_up_km2"), "ring_pixels", "ring_population",
    )

"""Geometry of WGS84 points as Column functions; angles in degrees, distances in km."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0
CELL = 0.1
#: The sixteen compass points from north, clockwise.
WORDS = (
    "north", "north-northeast", "northeast", "east-northeast", "east", "east-southeast", "southeast", "south-southeast",
    "south", "south-southwest", "southwest", "west-southwest", "west", "west-northwest", "northwest", "north-northwest",
)
LETTERS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def equirect_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    y = (lat2 - lat1) * KM_PER_DEGREE
    x = (lon2 - lon1) * KM_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(y * y + x * x)


def planar_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    return F.sqrt((lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1)) * KM_PER_DEGREE


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first point to the second, 0 to 360."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def _sector(degrees) -> Column:
    return (F.pmod(F.floor((_c(degrees) + 11.25) / 22.5), F.lit(16)) + 1).cast("int")


def compass_words(degrees) -> Column:
    return F.element_at(F.array(*map(F.lit, WORDS)), _sector(degrees))


def compass_letters(degrees) -> Column:
    return F.element_at(F.array(*map(F.lit, LETTERS)), _sector(degrees))


def compass_described(degrees) -> Column:
    return F.concat(compass_words(degrees), F.format_string(" (bearing %03.0f°)", F.bround(_c(degrees), 0)))


def dominant_axis(lat1, lon1, lat2, lon2) -> Column:
    """Heading by the larger difference; latitude has to be strictly larger to count."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    y, x = lat2 - lat1, lon2 - lon1
    vertical = F.when(y < 0, "southward").otherwise("northward")
    return F.when(F.abs(y) > F.abs(x), vertical).otherwise(F.when(x < 0, "westward").otherwise("eastward"))


def drift(lat_from, lat_to, band: float = 0.1) -> Column:
    change = _c(lat_to) - _c(lat_from)
    return F.when(change < -band, "southward").when(change > band, "northward").otherwise("stationary")


def cell_floor(x) -> Column:
    """Number of the cell a coordinate lies in; patrols count cells from their lower edge."""
    return F.floor(_c(x) / CELL)


def grid_cell_id(lat, lon) -> Column:
    """Patrol cell: lower edges with one decimal."""
    return F.format_string("%.1f_%.1f", cell_floor(lat) * CELL, cell_floor(lon) * CELL)


def fire_cell_id(lat, lon) -> Column:
    """Fire cell: coordinates rounded to the nearest tenth, halves to even."""

    def tenth(x) -> Column:
        return (F.bround(_c(x) * 10, 0) / 10).cast("decimal(9,1)").cast("string")

    return F.concat_ws("_", tenth(lat), tenth(lon))


def cell_center(x) -> Column:
    return cell_floor(x) * CELL + CELL / 2


def cell_bounds(lat, lon) -> Column:
    low_lat, low_lon = cell_floor(lat) * CELL, cell_floor(lon) * CELL
    return F.struct(low_lat.alias("lat_min"), (low_lat + CELL).alias("lat_max"), low_lon.alias("lon_min"), (low_lon + CELL).alias("lon_max"))


def subcell_id(lat, lon) -> Column:
    """Row and column of the hundredth of a cell in which a point lies."""

    def index(x) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(9), F.floor((_c(x) - cell_floor(x) * CELL) / (CELL / 10)).cast("int")))

    return F.concat_ws("_", index(lat).cast("string"), index(lon).cast("string"))


def segment_distance_sq(px, py, x1, y1, x2, y2) -> Column:
    """Squared distance of a point to a segment; a segment of no length is a point."""
    px, py, x1, y1, x2, y2 = map(_c, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.when(length == 0, F.lit(1.0)).otherwise(length))))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def ray_crosses(px, py, x1, y1, x2, y2) -> Column:
    """Whether a ray from the point towards larger x crosses the edge; edges own their lower end."""
    px, py, x1, y1, x2, y2 = map(_c, (px, py, x1, y1, x2, y2))
    at = (x2 - x1) * (py - y1) / F.when(y2 == y1, F.lit(1.0)).otherwise(y2 - y1) + x1
    return ((y1 > py) != (y2 > py)) & (px < at)


def pixel_area_km2(lat, degrees: float = 0.00025) -> Column:
    return F.lit(110.574 * degrees) * (F.lit(111.32) * F.cos(F.radians(_c(lat))) * degrees)


def forest_tile(lat, lon) -> Column:
    """Name of the ten-degree forest tile: its upper edge north of the equator and just south of it, else its upper edge as S; W tiles by their left edge."""
    lat, lon = _c(lat), _c(lon)
    north = F.format_string("%02dN", (F.floor(lat / 10) * 10 + 10).cast("int"))
    south = F.format_string("%02dS", (F.floor(F.floor(-lat) / 10) * 10).cast("int"))
    east = F.format_string("%03dE", (F.floor(lon / 10) * 10).cast("int"))
    west = F.format_string("%03dW", (F.floor(F.floor(-lon - 0.0001) / 10) * 10 + 10).cast("int"))
    return F.concat_ws("_", F.when(lat >= 0, north).when(lat > -10, "00N").otherwise(south), F.when(lon >= 0, east).otherwise(west))


def forest_tile_box(name) -> Column:
    """The box of a forest tile by its name."""
    name = _c(name)
    top = F.when(F.substring(name, 3, 1) == "N", F.substring(name, 1, 2).cast("int")).otherwise(-F.substring(name, 1, 2).cast("int"))
    left = F.when(F.substring(name, -1, 1) == "E", F.substring(name, 5, 3).cast("int")).otherwise(-F.substring(name, 5, 3).cast("int"))
    return F.struct((top - 10).alias("lat_min"), top.alias("lat_max"), left.alias("lon_min"), (left + 10).alias("lon_max"))


def grid_tile(x, y, origin_x: float, origin_y: float, size: float) -> Column:
    """Row and column of an equal-area tile, counted right and down from the origin, towards zero."""
    return F.struct(((F.lit(origin_y) - _c(y)) / size).cast("int").alias("tile_row"), ((_c(x) - origin_x) / size).cast("int").alias("tile_col"))


def tile_range(x_min, y_min, x_max, y_max, origin_x: float, origin_y: float, size: float) -> Column:
    """All tiles of a box, as an array of rows and columns."""
    low, high = grid_tile(x_min, y_max, origin_x, origin_y, size), grid_tile(x_max, y_min, origin_x, origin_y, size)
    rows = F.sequence(low["tile_row"], high["tile_row"])
    columns = F.sequence(low["tile_col"], high["tile_col"])
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: F.struct(r.alias("tile_row"), c.alias("tile_col")))))


def utm_epsg(lat, lon) -> Column:
    zone = (F.floor((_c(lon) + 180) / 6) + 1).cast("int")
    return F.when(_c(lat) >= 0, zone + 32600).otherwise(zone + 32700)


def bbox_around(lat, lon, km: float) -> Column:
    d = km / KM_PER_DEGREE
    return F.struct((_c(lat) - d).alias("lat_min"), (_c(lat) + d).alias("lat_max"), (_c(lon) - d).alias("lon_min"), (_c(lon) + d).alias("lon_max"))


def bbox_around_ring(ring, km: float) -> Column:
    """The box of a ring, wider by some km on all sides."""
    box, d = ring_bbox(ring), km / KM_PER_DEGREE
    return F.struct((box["lat_min"] - d).alias("lat_min"), (box["lat_max"] + d).alias("lat_max"), (box["lon_min"] - d).alias("lon_min"), (box["lon_max"] + d).alias("lon_max"))


def forest_tiles(box: Column) -> Column:
    """Names of all ten-degree forest tiles that a box touches."""
    rows = F.sequence((F.floor(box["lat_min"] / 10) * 10).cast("int"), (F.floor(box["lat_max"] / 10) * 10).cast("int"), F.lit(10))
    columns = F.sequence((F.floor(box["lon_min"] / 10) * 10).cast("int"), (F.floor(box["lon_max"] / 10) * 10).cast("int"), F.lit(10))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: forest_tile(r + 5, c + 5))))))


def ring_bbox(ring) -> Column:
    """Box of a ring of [lon, lat] pairs."""
    ring = _c(ring)
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(ys).alias("lat_min"), F.array_max(ys).alias("lat_max"), F.array_min(xs).alias("lon_min"), F.array_max(xs).alias("lon_max"))


def bbox_area(box: Column) -> Column:
    return (box["lat_max"] - box["lat_min"]) * (box["lon_max"] - box["lon_min"])


def circle_ring(lat, lon, area_km2=None, corners: int = 32, default_km2: float = 1000.0) -> Column:
    """A closed ring about a point with the given area; longitudes widen by the cosine of the latitude."""
    lat, lon = _c(lat), _c(lon)
    area = F.lit(default_km2) if area_km2 is None else F.when(_c(area_km2) > 0, _c(area_km2)).otherwise(F.lit(default_km2))
    r = F.sqrt(area / F.pi()) / KM_PER_DEGREE

    def corner(i: Column) -> Column:
        angle = F.lit(2.0) * F.pi() * (i % corners) / corners
        return F.array(lon + r * F.cos(angle) / F.cos(F.radians(lat)), lat + r * F.sin(angle))

    return F.transform(F.sequence(F.lit(0), F.lit(corners)), corner)


def quadrant(lat, lon, center_lat, center_lon) -> Column:
    north = F.when(_c(lat) >= _c(center_lat), "North").otherwise("South")
    return F.concat(north, F.when(_c(lon) >= _c(center_lon), "east").otherwise("west"))


def fire_location(inside: Column, has_boundary: Column) -> Column:
    return F.when(~has_boundary, "unknown").when(inside, "infraction").otherwise("buffer")

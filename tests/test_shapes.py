"""Clips, row spans, zonal sums, projection and road buffers against plain restatements and exact cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from acacia.functions import projection
from acacia.operators import roads, shapes

AREAS = "id string, rings array<array<array<double>>>"


def star(rng, x, y, size, corners=9):
    return [[x + size * rng.uniform(0.35, 1) * math.cos(2 * math.pi * k / corners), y + size * rng.uniform(0.35, 1) * math.sin(2 * math.pi * k / corners)] for k in range(corners)]


def inside(rings, x, y):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return n % 2 == 1


def distance(rings, x, y):
    best = math.inf
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            dx, dy = x2 - x1, y2 - y1
            size = dx * dx + dy * dy
            t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / size)) if size else 0.0
            best = min(best, math.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return best


@pytest.fixture(scope="module")
def concave():
    """Stars with a hole and an island in the hole; the second has its first ring closed."""
    rng = random.Random(11)
    out = []
    for name, x, y in (("a", 0.3, -0.2), ("b", 5.1, 4.7), ("c", -3.0, 0.0)):
        rings = [star(rng, x, y, 3.0, 11), [[x - 0.5, y - 0.5], [x + 0.5, y - 0.4], [x + 0.4, y + 0.5]], [[x - 0.1, y - 0.1], [x + 0.1, y - 0.1], [x, y + 0.1]]]
        out.append((name, [rings[0] + rings[0][:1], *rings[1:]] if name == "b" else rings))
    return out


def test_clips(spark, concave):
    areas = spark.createDataFrame([*concave, ("none", []), ("line", [[[0.0, 0.0], [1.0, 1.0]]])], AREAS)
    pieces = shapes.clipped_by_tiles(areas, 1.5, x0=-0.25).collect()
    whole = {r.id: r.area for r in shapes.area_of(areas).collect()}
    assert {p.id for p in pieces} == {"a", "b", "c"}
    for name, rings in concave:
        own = [p for p in pieces if p.id == name]
        assert sum(p.area for p in own) == pytest.approx(whole[name], rel=1e-12)
        for p in own:
            low_x, low_y = -0.25 + p.tile_col * 1.5, p.tile_row * 1.5
            for ring in p.rings:
                assert all(low_x - 1e-9 <= c.x <= low_x + 1.5 + 1e-9 and low_y - 1e-9 <= c.y <= low_y + 1.5 + 1e-9 for c in ring.corners)
            n = 60
            hits = sum(inside(rings, low_x + (i + 0.5) * 1.5 / n, low_y + (j + 0.5) * 1.5 / n) for i in range(n) for j in range(n))
            assert p.area == pytest.approx(hits * (1.5 / n) ** 2, abs=0.03)


def test_convex_pieces_are_exact(spark):
    areas = spark.createDataFrame([("square", [[[0.5, 0.5], [2.5, 0.5], [2.5, 2.5], [0.5, 2.5]]]), ("corner", [[[0.0, 0.0], [2.0, 0.0], [0.0, 2.0], [0.0, 0.0]]])], AREAS)
    got = {(r.id, r.tile_row, r.tile_col): r.area for r in shapes.clipped_by_tiles(areas, 1.0).collect()}
    want = {("square", r, c): (0.5 if r != 1 else 1.0) * (0.5 if c != 1 else 1.0) for r in range(3) for c in range(3)}
    want |= {("corner", 0, 0): 1.0, ("corner", 0, 1): 0.5, ("corner", 1, 0): 0.5}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("touched", [False, True])
def test_zonal_sums(spark, concave, touched):
    grid = shapes.Grid(-7.013, 8.007, 0.31)
    rng = random.Random(2)
    pixels = [(r, c, rng.choice([None, -200, 0, 3, 7]), float(rng.randrange(9))) for r in range(60) for c in range(60) if rng.random() < 0.8]
    pixels += pixels[:40]
    df = spark.createDataFrame(pixels, "r int, c int, built int, population double")
    got = {r.id: tuple(r)[1:] for r in shapes.zonal_sums(df, spark.createDataFrame([*concave, ("far", [[[90.0, 80.0], [91.0, 80.0], [91.0, 81.0]]])], AREAS), grid, 0.8, ["built", "population"], chunk=7, touched=touched).collect()}
    want = {"far": (0, 0, 0.0, 0.0, 0.0, 0.0)}
    for name, rings in concave:
        sums = [0, 0, 0.0, 0.0, 0.0, 0.0]
        passed = set()
        for ring in rings if touched else []:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
                for k in range(4001):
                    x, y = x1 + (x2 - x1) * k / 4000, y1 + (y2 - y1) * k / 4000
                    passed.add((math.floor((8.007 - y) / 0.31), math.floor((x + 7.013) / 0.31)))
        for r, c, built, population in pixels:
            x, y = -7.013 + (c + 0.5) * 0.31, 8.007 - (r + 0.5) * 0.31
            zone = 0 if inside(rings, x, y) or (r, c) in passed else 1 if distance(rings, x, y) <= 0.8 else None
            if zone is not None:
                for i, v in enumerate((1, max(built or 0, 0), max(population, 0))):
                    sums[2 * i + zone] += v
        want[name] = tuple(sums)
    if touched:  # the walk above may miss a pixel of which an edge only cuts a corner
        for name in want:
            assert got[name] == pytest.approx(want[name], rel=0.02, abs=3)
    else:
        assert got == want


def test_capsules(spark):
    rng = random.Random(4)
    segments = [(str(i), *(rng.uniform(-3, 3) for _ in range(4))) for i in range(20)] + [("flat", -1.0, 0.4, 2.0, 0.4), ("upright", 1.0, -2.0, 1.0, 1.0), ("point", 0.5, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(segments, "id string, x1 double, y1 double, x2 double, y2 double")
    spans = {(r.id, r.r): (r.low, r.high) for r in shapes.capsule_spans(df, F.lit(0.7), shapes.Grid(0.0, 5.0, 0.25)).collect()}
    for name, x1, y1, x2, y2 in segments:
        for row in range(-2, 44):
            y = 5.0 - (row + 0.5) * 0.25
            xs = [x for x in np.arange(-4, 4, 0.01) if distance([[[x1, y1], [x2, y2]]], x, y) <= 0.7]
            if len(xs) > 1:
                assert spans[name, row] == pytest.approx((min(xs), max(xs)), abs=0.011)
            elif (name, row) in spans:
                assert spans[name, row][1] - spans[name, row][0] < 0.03


def test_utm(spark):
    rows = [(43.642566, -79.387139, 32617), (0.0, 21.0, 32634), (-33.8568, 151.2153, 32756), (52.0, 21.0, 32634), (10.0, 23.9, 32634), (-4.5, 21.0, 32734)]
    got = [r.m for r in spark.createDataFrame(rows, "lat double, lon double, epsg int").select(projection.utm(F.col("lat"), F.col("lon"), F.col("epsg")).alias("m")).collect()]
    assert (got[0].x, got[0].y) == pytest.approx((630_084, 4_833_438), abs=1)  # a published position
    assert (got[1].x, got[1].y) == pytest.approx((500_000, 0), abs=1e-6)
    assert got[2].y > 6_000_000 and got[2].x == pytest.approx(334_900, abs=200)
    zero = np.zeros(1)
    for i, lat, base in ((3, 52.0, 0.0), (5, -4.5, 10_000_000.0)):  # northings on the middle meridian are scaled geodesics
        arc = float(projection.geodesic_m(zero, zero, np.array([lat]), zero)[0]) * 0.9996 * math.copysign(1, lat)
        assert (got[i].x, got[i].y) == pytest.approx((500_000, base + arc), abs=1e-3)
    assert got[4].x == pytest.approx(817_700, abs=1_500)


PARK = [[[20.8, 4.8], [21.2, 4.8], [21.2, 5.2], [20.8, 5.2], [20.8, 4.8]]]


def area(spark, lines, rings=PARK, buffer_m=1000.0):
    parks = spark.createDataFrame([("p", rings)], "park_id string, rings array<array<array<double>>>")
    df = spark.createDataFrame([("p", [{"lat": y, "lon": x} for x, y in line]) for line in lines], "park_id string, points array<struct<lat: double, lon: double>>")
    got = roads.roaded_area(df, parks, buffer_m).collect()
    return got[0].roaded_area_km2 if got else 0.0


def test_roaded_area_is_exact(spark):
    unit = 0.9996
    north = float(projection.geodesic_m(np.array([4.95]), np.zeros(1), np.array([5.05]), np.zeros(1))[0]) * unit / 1000
    assert area(spark, [[(21.0, 5.0)]]) == pytest.approx(math.pi, rel=1e-3)
    capsule = math.pi + 2 * north
    assert area(spark, [[(21.0, 4.95), (21.0, 5.05)]]) == pytest.approx(capsule, rel=1e-3)
    assert area(spark, [[(21.0, 4.95), (21.0, 5.05)], [(21.0, 5.05), (21.0, 4.99), (21.0, 4.95)]]) == pytest.approx(capsule, rel=1e-3)
    # half of a disc on the park's upper edge, which is straight in the zone and some metres above the parallel there
    rise = (22.13**2) * math.tan(math.radians(5.2)) / (2 * 6371)
    assert area(spark, [[(21.0, 5.2)]]) == pytest.approx(math.pi / 2 + 2 * rise, rel=1e-3)
    # a hole takes out what lies in it
    hole = [[20.9, 4.9], [21.0, 4.9], [21.0, 5.1], [20.9, 5.1]]
    assert area(spark, [[(21.0, 5.0)]], [*PARK, hole]) == pytest.approx(math.pi / 2, rel=2e-3)
    assert area(spark, [[(25.0, 5.0)]]) == 0.0
    east = float(projection.geodesic_m(np.array([5.0]), np.zeros(1), np.array([5.0]), np.array([0.01]))[0]) * unit / 1000
    lens = 2 * math.acos(east / 2) - east / 2 * math.sqrt(4 - east * east)
    assert area(spark, [[(21.0, 5.0)], [(21.01, 5.0)]]) == pytest.approx(2 * math.pi - lens, rel=1e-3)


def test_road_statistics(spark):
    parks = spark.createDataFrame([("p", PARK, 2000.0), ("empty", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]], 0.0)], "park_id string, rings array<array<array<double>>>, area_km2 double")
    lines = {1: [(21.0, 4.9), (21.0, 5.0), (21.0, 5.1)], 2: [(21.25, 4.9), (21.25, 5.1)], 3: [(30.0, 5.0), (31.0, 5.0)], 4: [], 5: [(20.7, 5.0), (21.3, 5.0)]}
    df = spark.createDataFrame([(i, [{"lat": y, "lon": x} for x, y in line]) for i, line in lines.items()], "road_id int, points array<struct<lat: double, lon: double>>")
    got = {r.park_id: r for r in roads.statistics(df, parks).collect()}
    assert (got["empty"].roads, got["empty"].road_length_km, got["empty"].roadless_percentage) == (0, 0.0, 0.0)
    p = got["p"]
    north = 22.12  # 0.2 degrees
    across = float(projection.geodesic_m(np.array([5.0]), np.array([20.8]), np.array([5.0]), np.array([21.2]))[0]) / 1000
    assert p.roads == 3 and p.road_length_km == pytest.approx(2 * north + across * 1.5, rel=2e-3)
    # road 2 runs beside the park and doesn't count; 1 and 5 cross in a square of 2 km
    assert p.roaded_area_km2 == pytest.approx(2 * north + math.pi + 2 * across - 4, rel=2e-3)
    assert p.roadless_percentage == pytest.approx(100 - p.roaded_area_km2 / 20)
    meeting = roads.crossing(roads.roads_of_parks(df, parks), parks)
    assert {r.road_id for r in meeting.collect()} == {1, 5}

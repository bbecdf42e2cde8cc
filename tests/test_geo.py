import pytest
from pyspark.sql import functions as F

from acacia.functions import classify, geo, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_haversine_known_distances(spark):
    r = one(spark, geo.haversine_km(51.5074, -0.1278, 48.8566, 2.3522), geo.haversine_km(0, 0, 0, 1), geo.haversine_km(1, 1, 1, 1))
    assert r[0] == pytest.approx(344, abs=20)
    assert r[1] == pytest.approx(111.2, abs=1)
    assert r[2] == 0


def test_haversine_is_symmetric(spark):
    rows = spark.range(50).select((F.col("id") - 25).cast("double").alias("a"), (F.col("id") * 3.0).alias("b"))
    there, back = geo.haversine_km("a", "b", F.lit(7.5), F.lit(11.0)), geo.haversine_km(F.lit(7.5), F.lit(11.0), "a", "b")
    assert rows.where(F.abs(there - back) > 1e-9).count() == 0


@pytest.mark.parametrize("degrees,word,letters", [(0, "north", "N"), (11.24, "north", "N"), (11.25, "north-northeast", "NNE"), (90, "east", "E"), (348.75, "north", "N"), (225, "southwest", "SW")])
def test_compass(spark, degrees, word, letters):
    assert tuple(one(spark, geo.compass_words(degrees), geo.compass_letters(degrees))) == (word, letters)


def test_bearing_and_axis(spark):
    r = one(spark, geo.bearing(0, 0, 1, 0), geo.bearing(0, 0, 0, 1), geo.dominant_axis(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)), geo.compass_described(geo.bearing(0, 0, 0, 1)))
    assert (round(r[0], 6), round(r[1], 6), r[2], r[3]) == (0, 90, "eastward", "east (bearing 090°)")


def test_cells(spark):
    r = one(spark, geo.grid_cell_id(-0.05, 36.82), geo.fire_cell_id(-0.05, 36.85), geo.subcell_id(-0.05, 36.829), geo.utm_epsg(-1.0, 36.8))
    assert tuple(r) == ("-0.1_36.8", "0.0_36.8", "5_2", 32737) or tuple(r) == ("-0.1_36.8", "0.0_36.9", "5_2", 32737)


@pytest.mark.parametrize("lat,lon,name", [(5, 15, "10N_010E"), (-5, 15, "00N_010E"), (-15, 25, "10S_020E"), (0, 0, "10N_000E"), (12, -5, "20N_010W"), (-20, -15, "20S_020W")])
def test_forest_tiles(spark, lat, lon, name):
    assert one(spark, geo.forest_tile(F.lit(float(lat)), F.lit(float(lon))))[0] == name


def test_tile_enumeration(spark):
    tiles = one(spark, geo.tile_range(0, 0, 25, 15, -100, 100, 10))[0]
    assert {(t.tile_row, t.tile_col) for t in tiles} == {(r, c) for r in (8, 9, 10) for c in (10, 11, 12)}


def test_circle_has_area(spark):
    ring = one(spark, geo.circle_ring(0, 0, F.lit(1000.0)))[0]
    assert len(ring) == 33 and ring[0] == pytest.approx(ring[-1])
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2 * 111 * 111
    assert area == pytest.approx(1000, rel=0.02)


@pytest.mark.parametrize("speed,kind", [(0, "foot"), (5, "foot"), (7.9, "foot"), (8, "vehicle"), (50, "vehicle"), (120, "vehicle"), (121, "aircraft"), (500, "aircraft")])
def test_movement(spark, speed, kind):
    assert one(spark, classify.segment_movement(F.lit(float(speed))))[0] == kind


@pytest.mark.parametrize("dry,rainy,expected", [(0, 0, 0.5), (6, 0, 1.0), (6, 6, 1.3), (12, 6, 1.5)])
def test_intensity(spark, dry, rainy, expected):
    assert one(spark, classify.coverage_intensity(F.lit(dry), F.lit(rainy), F.lit(None).cast("double"), F.lit(40.0)))[0] == pytest.approx(expected)


@pytest.mark.parametrize(
    "nodes,speed,spread,south,kind",
    [(2, 50, 0, 0, "unknown"), (5, 31, 0, 0, "management_fast"), (5, 16, 31, 0, "management_vehicle"), (5, 16, 30, 0, "herder_fast"), (5, 15, 0, 21, "transhumance"), (5, 6, 0, 20, "herder_local"),
     (11, 3, 0, 16, "transhumance_slow"), (10, 3, 0, 16, "local_burning"), (8, 2, 0, 0, "village_persistent"), (7, 2, 0, 0, "local_stationary")],
)
def test_trajectory_types(spark, nodes, speed, spread, south, kind):
    assert one(spark, classify.trajectory_type(F.lit(nodes), F.lit(float(speed)), F.lit(float(spread)), F.lit(float(south))))[0] == kind


def test_texts(spark):
    r = one(spark, text.area_text(F.lit(1.5e6)), text.area_text(F.lit(25000.0)), text.area_text(F.lit(12.5)), text.people_text(F.lit(2_500_000)), text.listed(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), text.padded_time(F.lit(5)), text.fixed(F.lit(0.15), 1))
    assert tuple(r) == ("1.5 km²", "2.5 ha", "12 m²", "2.5M", "a, b and c", "0005", "0.1")


def test_abstracts(spark):
    index = F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(3)), F.lit("b"), F.array(F.lit(1)))
    long = F.create_map(F.lit("é" * 600), F.array(F.lit(0)))
    r = one(spark, text.abstract_text(index), F.octet_length(text.abstract_text(long)))
    assert r[0] == "a b  a" and r[1] == 1003
    late = F.create_map(F.lit("c"), F.array(F.lit(2), F.lit(4)), F.lit("b"), F.array(F.lit(4), F.lit(-1), F.lit(None).cast("int")))
    r = one(spark, text.abstract_text(late), text.abstract_text(F.lit(None).cast("map<string,array<int>>")), text.abstract_text(F.create_map().cast("map<string,array<int>>")))
    assert tuple(r) == ("  c  c", "", "")
    assert one(spark, text.about_park(F.lit("On KRUGER"), F.lit(None).cast("string"), F.lit("Kruger National Park")))[0]


def test_equal_area_known_points():
    import numpy as np

    from acacia.functions import projection

    x, y = projection.mollweide(np.array([0.0, 90.0, -90.0, 0.0]), np.array([180.0, 10.0, 10.0, 0.0]))
    assert np.allclose(x, [2 * np.sqrt(2) * projection.A, 0, 0, 0], atol=1e-2) and np.allclose(y, [0, np.sqrt(2) * projection.A, -np.sqrt(2) * projection.A, 0], atol=1e-2)
    lat, lon = np.linspace(-89, 89, 50), np.linspace(-179, 179, 50)
    back = projection.from_mollweide(*projection.mollweide(lat, lon))
    assert np.allclose(back[0], lat) and np.allclose(back[1], lon)


def test_geodesic_and_simplify():
    import numpy as np

    from acacia.functions import projection

    d = projection.geodesic_m(np.array([0.0, 0.0, 1.0]), np.array([0.0, 0.0, 1.0]), np.array([0.0, 1.0, 1.0]), np.array([1.0, 0.0, 1.0]))
    assert np.allclose(d, [111319.4908, 110574.3886, 0], atol=1e-3)
    line = np.array([[0, 0], [0.0005, 1], [0, 2], [1, 3]], float)
    assert projection.simplify(line, 0.001).tolist() == [True, False, True, True]


def test_year_ranges():
    from acacia.functions.params import year_range

    assert year_range("2020") == (2020, 2020) and year_range("x", "2001", None, (2000, 2024)) == (2001, 2024) and year_range(None, "x", "y") == (1900, 2100)

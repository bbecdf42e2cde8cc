import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from acacia.operators import clusters, components, effort, loss, merge, search, spatial, tracks
from acacia.sources import fires as fire_sources
from acacia.sources import geodata, sinks


def areas(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, id string, buffer_km double, rings array<array<array<double>>>")


def at(spark, *points):
    return spark.createDataFrame([(float(a), float(b)) for a, b in points], "latitude double, longitude double")


def test_area_with_buffer(spark):
    # A pentagon and eight kilometres about it, which are 0.072 degrees.
    area = areas(spark, ("five", 8.0, [[[10.0, 50.0], [13.0, 50.0], [14.0, 52.0], [11.5, 54.0], [9.5, 52.0], [10.0, 50.0]]]))
    want = {(51.5, 12.0): "five", (50.0, 10.0): "five", (49.95, 11.5): "five", (49.9, 11.5): None, (53.9, 9.6): None}
    found = spatial.first_area(at(spark, *want), area)
    assert {(r.latitude, r.longitude): r.area_id for r in found.collect()} == want


def test_trapezoid_hole_and_order(spark):
    shapes = areas(spark, ("t", 0.0, [[[1.0, 1.0], [5.0, 1.0], [4.0, 3.0], [2.0, 3.0]]]), ("h", 0.0, [[[0.0, 0.0], [9.0, 0.0], [9.0, 6.0], [0.0, 6.0]], [[6.0, 2.0], [8.0, 2.0], [8.0, 4.0], [6.0, 4.0]]]))
    points = at(spark, (0.5, -1.0), (1.2, 1.2), (2.0, 3.0), (3.0, 7.0), (5.0, 7.0))
    # Holes count only where areas are taken strictly.
    assert [r.area_id for r in spatial.first_area(points, shapes).orderBy("latitude").collect()] == [None, "t", "t", "h", "h"]
    assert {(r.latitude, r.area_id) for r in spatial.all_areas(points, shapes).collect()} == {(1.2, "t"), (1.2, "h"), (2.0, "t"), (2.0, "h"), (5.0, "h")}


def brute_dbscan(p, eps, least):
    n = len(p)
    near = [[j for j in range(n) if ((p[i] - p[j]) ** 2).sum() <= eps * eps] for i in range(n)]
    label, k = [-1] * n, 0
    for i in range(n):
        if label[i] >= 0 or len(near[i]) < least:
            continue
        label[i], todo = k, [i]
        while todo:
            for j in near[todo.pop()]:
                if label[j] < 0:
                    label[j] = k
                    if len(near[j]) >= least:
                        todo.append(j)
        k += 1
    return label


@pytest.mark.parametrize("seed", range(5))
def test_dbscan(seed):
    p = np.random.default_rng(seed).random((150, 2 + seed % 2))
    for eps, least in ((0.05, 3), (0.1, 4), (0.2, 1)):
        assert clusters.dbscan(p, eps, least).tolist() == brute_dbscan(p, eps, least)


def test_linking_gaps_ties_and_lengths():
    lat, lon = np.array([0.0, 0.01, -0.01, 0.0, 0.0]), np.zeros(5)
    day, size = np.array([1, 2, 2, 5, 9]), np.ones(5)
    assert clusters.link(lat, lon, day, size, clusters.Linking("planar", 20.0, least=1)) == [[0, 1, 3], [2], [4]]
    assert clusters.link(lat, lon, day, size, clusters.NEAREST) == [[0, 1, 3]]


def test_pixels_touch_by_edges_or_corners():
    r, c = np.array([0, 1, 1, 3]), np.array([0, 1, 2, 3])
    assert clusters.label_pixels(r, c, False).tolist() == [1, 2, 2, 3]
    assert clusters.label_pixels(r, c, True).tolist() == [1, 1, 1, 2]


@pytest.mark.parametrize("corners", [False, True])
def test_components_are_not_cut_at_block_borders(spark, corners):
    rnd = random.Random(8)
    on = sorted((r, c) for r in range(20) for c in range(20) if rnd.random() < 0.55)
    whole = clusters.label_pixels(np.array([p[0] for p in on]), np.array([p[1] for p in on]), corners)
    rows = spark.createDataFrame([("t", r, c, 1) for r, c in on], "tile string, r int, c int, value int")
    got = {(x.r, x.c): x.component for x in components.large_raster(rows, ["tile"], 4, corners).collect()}
    pairs = {(int(a), got[p]) for a, p in zip(whole, on, strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def track(spark, minutes):
    t0 = datetime(2024, 1, 15, 8)
    rows = [("f", 0, 0, i, 0.0, i * 0.01, t0 + timedelta(minutes=m) if m is not None else None, "") for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "file string, track_no int, seg_no int, pt_no int, lat double, lon double, ts timestamp, description string")


@pytest.mark.parametrize("limit,parts", [(30, 1), (10, 2), (9, 3)])
def test_split(spark, limit, parts):
    assert tracks.split_by_duration(track(spark, [0, 10, 20]), limit).select("part").distinct().count() == parts


def test_split_keeps_its_anchor(spark):
    out = [r.part for r in tracks.split_by_duration(track(spark, [0, 10, None, 20, 31, 32, 70])).orderBy("pt_no").collect()]
    assert out == [0, 0, 0, 0, 1, 1, 2]


def test_segments_without_times_have_no_speed(spark):
    r = tracks.segments(track(spark, [None, None]), ["file"]).first()
    assert r.avg_speed_kmh == 0 and r.distance_km > 1 and r.movement_type == "foot"


def test_sampling_keeps_ends(spark):
    got = [r.pt_no for r in tracks.sampled(track(spark, range(1000)), ["file"], 10).orderBy("pt_no").collect()]
    assert got == [int(i * 999 / 9 + 0.5) for i in range(10)]


def test_circles(spark):
    b = [float(i * 100 % 360) for i in range(15)]
    assert spark.createDataFrame([(b,)], "b array<double>").select(tracks.circles("b")).first()[0] == 3


def test_cell_effort_adds_up(spark):
    points = track(spark, range(0, 60, 3))
    sums = tracks.cell_effort(points, ["file"], tracks.segments(points, ["file"]))
    total = tracks.segments(points, ["file"]).first().distance_km
    by = {r.movement_type: r.d for r in sums.groupBy("movement_type").agg(F.sum("total_distance_km").alias("d")).collect()}
    assert by["all"] == pytest.approx(total) and sum(v for k, v in by.items() if k != "all") == pytest.approx(total)


def test_merges(spark):
    def rows(*r):
        return spark.createDataFrame(r, "k string, day int, n long")

    old, new = rows(("a", None, 1), ("b", 1, 2)), rows(("a", None, 5), ("c", 1, 7), ("c", 1, 3))
    got = lambda df: sorted(map(tuple, df.select("k", "day", "n").collect()), key=str)
    key = ["k", "day"]
    assert got(merge.insert_new(old, new, key, [F.col("n")])) == [("a", None, 1), ("b", 1, 2), ("c", 1, 3)]
    assert got(merge.replace(old, new, key, [F.desc("n")])) == [("a", None, 5), ("b", 1, 2), ("c", 1, 7)]
    assert got(merge.add_up(old, new, key, ["n"])) == [("a", None, 6), ("b", 1, 2), ("c", 1, 10)]
    assert got(merge.add_up_nulls_apart(old, new, key, "day", ["n"])) == [("a", None, 1), ("a", None, 5), ("b", 1, 2), ("c", 1, 10)]
    again = merge.insert_new(merge.insert_new(old, new, key, [F.col("n")]), new, key, [F.col("n")])
    assert got(again) == [("a", None, 1), ("b", 1, 2), ("c", 1, 3)]
    assert got(merge.update(old, rows(("b", 1, 9)), key, ["n"])) == [("a", None, 1), ("b", 1, 9)]


def test_sync_windows(spark):
    state = spark.createDataFrame([("a", date(2024, 1, 1)), ("b", None), ("c", date(2024, 2, 1))], "park_id string, last_date date")
    out = merge.date_chunks(merge.sync_window(state, "2024-01-25", "2024-01-20"))
    assert sorted((r.park_id, str(r.chunk_start), str(r.chunk_end)) for r in out.collect()) == [("a", "2024-01-02", "2024-01-11"), ("a", "2024-01-12", "2024-01-21"), ("a", "2024-01-22", "2024-01-25"), ("b", "2024-01-20", "2024-01-25")]


def test_loss_trend_lengths(spark):
    rows = [(f"p{n}", 2000 + i, float(1 + (i >= n / 2))) for n in (4, 5, 9, 10) for i in range(n)]
    got = {r.park_id: r.trend for r in loss.loss_trend(spark.createDataFrame(rows, "park_id string, year int, area_km2 double")).collect()}
    assert got == {"p4": "insufficient_data", "p5": "worsening", "p9": "worsening", "p10": "worsening"}


def test_roadless(spark):
    roads = spark.createDataFrame([("p", [(0.0, 0.0), (0.0, 0.5)])], "park_id string, points array<struct<lat:double,lon:double>>")
    r = loss.road_stats(roads, spark.createDataFrame([("p", 1000.0), ("q", 10.0)], "park_id string, area_km2 double")).orderBy("park_id").collect()
    assert r[0].road_length_km == pytest.approx(55.6, abs=0.5) and r[0].roaded_area_km2 == pytest.approx(55.6 * 2 + 3.1, rel=0.25) and r[1].roadless_percentage == 100


def test_csv_dual_names_and_bad_rows(spark, tmp_path):
    (tmp_path / "viirs_2023_Dem_Rep_Congo.csv").write_text("latitude,longitude,brightness,acq_date,acq_time,satellite,frp\n1.5,30.25,330,2023-01-02,5,N,\nx,30,1,2023-01-02,5,N,2\n,31,1,2023-06-02,1130,N,2\n")
    rows = fire_sources.read_csv(spark, str(tmp_path)).orderBy("latitude").collect()
    assert [(r.latitude, r.brightness, r.acq_time, r.frp) for r in rows] == [(0.0, 1.0, "1130", 2.0), (1.5, 330.0, "0005", None)]
    assert fire_sources.read_csv(spark, str(tmp_path), (1, 2, 30, 31), (1,)).count() == 1
    assert fire_sources.keyed(fire_sources.read_csv(spark, [str(tmp_path)] * 1).union(fire_sources.read_csv(spark, str(tmp_path)))).count() == 2


def test_zip_members(spark, tmp_path):
    import zipfile

    body = "latitude,longitude,bright_ti4,acq_date,acq_time\n1,2,3,2023-01-02,7\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("2023/viirs_2023_Kenya.csv", "__MACOSX/viirs_2023_Kenya.csv", "2022/viirs_2022_Kenya.csv", "2023/._viirs_2023_Kenya.csv", "2023/note.txt"):
            z.writestr(name, body)
    assert [(r.latitude, r.acq_time) for r in fire_sources.read_zip(spark, str(tmp_path), 2023).collect()] == [(1.0, "0007")]


GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>N</name></metadata><wpt lat="9" lon="9"/>
<trk><name>a</name><trkseg><trkpt lat="-1.5" lon="36.5"><ele>1795</ele><time>2024-01-15T08:00:00Z</time><desc>hello</desc></trkpt><trkpt lat="-1.6" lon="36.6"><time>never</time></trkpt></trkseg></trk>
<trk><trkseg><trkpt lat="1" lon="2"/></trkseg><trkseg><trkpt lat="3" lon="4"/></trkseg></trk></gpx>"""


def test_gpx(spark, tmp_path):
    import zipfile

    (tmp_path / "a.GPX").write_text(GPX)
    (tmp_path / "b.gpx").write_text("not valid xml")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x/d.gpx", GPX)
        z.writestr("__MACOSX/d.gpx", GPX)
    points, bad = geodata.tracks(geodata.uploads(spark, str(tmp_path)))
    rows = points.where("file like '%GPX'").orderBy("track_no", "seg_no", "pt_no").collect()
    assert [(r.lat, r.lon, r.ts is None, r.description) for r in rows] == [(-1.5, 36.5, False, "hello"), (-1.6, 36.6, True, ""), (1, 2, True, ""), (3, 4, True, "")]
    assert points.count() == 8 and bad.count() == 1


def test_geometry_parsing(spark):
    small, large = "[[[0,0],[1,0],[1,1],[0,1]]]", "[[[0,0],[9,0],[9,9],[0,9]],[[1,1],[2,1],[2,2]]]"
    rows = spark.createDataFrame([("Polygon", small), ("MultiPolygon", f"[{small},{large}]")], "t string, c string")
    got = rows.select(F.size(geodata.largest_rings(F.col("t"), F.col("c"))), geodata.whole_box(F.col("t"), F.col("c"))["lat_max"]).collect()
    assert [tuple(r) for r in got] == [(1, 1.0), (2, 9.0)]


def test_search_and_sync(spark):
    areas_ = spark.createDataFrame([(0, "KEN_a", "1", "Alpha", "Kenya"), (1, "TZA_b", None, "Beta", "Tanzania")], "ord int, id string, wdpa_id string, name string, country string")
    index = spark.createDataFrame([("1", "Alpha"), ("2", "Alphabet")], "wdpa_id string, name string")
    none = areas_.limit(0)
    found = search.areas("ALPHA", areas_, none.select(F.col("id").alias("code"), "name"), none.select("id", "name", "country"), index)
    assert sorted(r.id for r in found.collect()) == ["2", "KEN_a"]
    assert search.areas("", areas_, none.select(F.col("id").alias("code"), "name"), none.select("id", "name", "country"), index).count() == 0
    assert {(r.wdpa_id, r.loaded) for r in search.index_search("alpha", index, areas_).collect()} == {("1", True), ("2", False)}
    synced = spark.createDataFrame([("KEN_a", datetime(2024, 1, 1)), ("TZA_b", datetime(2024, 1, 9))], "pa_id string, last_sync timestamp")
    assert [r.id for r in search.to_sync(areas_, synced.limit(1), "2024-01-10").collect()] == ["TZA_b"]
    assert [r.id for r in search.to_sync(areas_, synced, "2024-01-10").collect()] == ["KEN_a"]
    texts = spark.createDataFrame([("KEN_a", ["x"])], "id string, legislation array<string>")
    by_country = spark.createDataFrame([("TZA", ["y"])], "code string, legislation array<string>")
    assert {(r.id, tuple(r.legislation), r.own) for r in search.legal_of_area(areas_.select("id"), texts, by_country).collect()} == {("KEN_a", ("x",), True), ("TZA_b", ("y",), False)}


def test_features(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0)], "id string, lat double, lon double")
    doc = sinks.collection(sinks.point_features(rows, "lat", "lon", ["id"])).first().document
    assert doc == '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[2.0,1.0]},"properties":{"id":"a"}}]}'
    long = spark.range(1).select(sinks.bounded_list(F.sequence(F.lit(1), F.lit(600)))).first()[0]
    assert '"count":600' in long


def test_effort_bounds_filters_are_optional(spark):
    e = spark.createDataFrame([("c", 2020, "all", 1.0)], "grid_cell_id string, year int, movement_type string, total_distance_km double")
    c = spark.createDataFrame([("c", 1.0, 2.0)], "id string, lat_center double, lon_center double")
    assert effort.in_bounds(e, c).count() == 1 and effort.in_bounds(e, c, years=(2021, 2022)).count() == 0


def test_partitions_and_order_do_not_matter(spark):
    rnd = random.Random(5)
    rows = [(f"p{i % 2}", date(2024, 1, 1 + i % 9), rnd.random(), rnd.random(), float(i)) for i in range(300)]
    schema = "park_id string, acq_date date, latitude double, longitude double, frp double"
    one = clusters.daily_clusters(spark.createDataFrame(rows, schema), clusters.STREAMED)
    rnd.shuffle(rows)
    other = clusters.daily_clusters(spark.createDataFrame(rows, schema).repartition(7), clusters.STREAMED)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))

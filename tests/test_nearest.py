"""Nearest places against all pairs, with one crowded spot, and how many places a query looks at."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from acacia.operators import spatial
from tests.conftest import SMALL

PLACES = "id long, park_id string, place_type string, name string, lat double, lon double"


def kilometres(by, a, b, c, d):
    if by == "degrees":
        return (c - a) ** 2 + (d - b) ** 2
    if by == "equirect":
        return math.hypot((c - a) * 111.0, (d - b) * 111.0 * math.cos(math.radians((a + c) / 2)))
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.fixture(scope="module")
def spots():
    rng = random.Random(21)
    middles = [("p", 1.0, 20.0, 3.0), ("p", 1.2, 20.2, 0.002), ("q", 70.0, 30.0, 2.0), (None, 1.0, 20.0, 2.0), ("q", -88.0, 10.0, 1.5)]

    def point():
        park, lat, lon, spread = rng.choice(middles)
        return park, round(max(-90, lat + rng.uniform(-spread, spread)), 4), round(lon + rng.uniform(-spread, spread), 4)

    places = [(i, park, rng.choice(["town", "river"]), f"n{i}", lat, lon) for i in range(600) for park, lat, lon in [point()]]
    places += [(1000 + i, "p", "town", "same", 1.2, 20.2) for i in range(40)]
    queries = [(i, *point()) for i in range(150)] + [(1000, "nowhere", 1.0, 20.0), (1001, "p", 50.0, 50.0), (1002, "p", None, 20.0)]
    return places, queries


@pytest.mark.parametrize(
    ("k", "by", "reach", "max_km", "same_park", "outer", "types"),
    [(1, "haversine", 1.0, None, True, True, None), (3, "haversine", 1.0, None, True, False, ["town"]), (4, "equirect", 0.7, 30.0, False, False, None), (2, "degrees", 3.0, None, True, False, None), (50, "haversine", 0.5, None, False, True, None)],
)
@pytest.mark.parametrize("crowded", [0, 10_000])
def test_against_all_pairs(spark, spots, monkeypatch, crowded, k, by, reach, max_km, same_park, outer, types):
    monkeypatch.setattr(spatial, "CROWDED", crowded)
    places, queries = spots
    got = spatial.nearest_places(
        spark.createDataFrame(queries, "qid long, park_id string, lat double, lon double").repartition(3), spark.createDataFrame(places, PLACES), ["qid"], k, reach, types, max_km, False, by, same_park, outer
    )
    want = []
    for q, park, lat, lon in queries:
        near = []
        for i, of, kind, _, y, x in places if lat is not None else ():
            if abs(y - lat) <= reach and abs(x - lon) <= reach and (types is None or kind in types) and (not same_park or of == park is not None):
                km = kilometres("haversine" if by == "degrees" else by, lat, lon, y, x)
                if max_km is None or km <= max_km:
                    near.append((kilometres(by, lat, lon, y, x), i))
        near.sort()
        want += [(q, i, n) for n, (_, i) in enumerate(near[:k], 1)] or ([(q, None, 1)] if outer else [])
    assert sorted(((r.qid, r.place_id, r.place_rank) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_crowds_cost_nothing(spark):
    """Ten times the places about a query, and a query still looks at a bounded number of them."""
    held = []
    for n in (2_000, 20_000):
        rng = random.Random(1)
        places = spark.createDataFrame([(i, "p", "town", "n", 1 + rng.uniform(-0.5, 0.5), 20 + rng.uniform(-0.5, 0.5)) for i in range(n)], PLACES)
        wanted = places.select(F.col("id").alias("place_id"), F.col("park_id").alias("place_park"), "place_type", F.col("name").alias("place_name"), F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"))
        queries = spark.createDataFrame([(i, "p", 1 + rng.uniform(-0.4, 0.4), 20 + rng.uniform(-0.4, 0.4)) for i in range(100)], "qid long, park_id string, lat double, lon double")
        _, choices = spatial._choices(queries, wanted, 3, 1.0, True)
        held.append(choices.select(F.avg(F.size("held")), F.max(F.size("held"))).first())
    assert held[1][0] < 100 and held[1][1] < 400 and held[1][0] < 2 * held[0][0]


@pytest.mark.parametrize(("k", "by", "max_km", "same_park"), [(1, "equirect", 50.0, False), (2, "haversine", None, True), (3, "degrees", 40.0, False)])
@pytest.mark.parametrize("crowded", [0, 10_000])
def test_each_type_against_all_pairs(spark, spots, monkeypatch, crowded, k, by, max_km, same_park):
    monkeypatch.setattr(spatial, "CROWDED", crowded)
    places, queries = spots
    places = [(i, park, None if i % 7 == 0 else kind, name, y, x) for i, park, kind, name, y, x in places]
    got = spatial.nearest_places(spark.createDataFrame(queries, "qid long, park_id string, lat double, lon double"), spark.createDataFrame(places, PLACES), ["qid"], k, 1.0, None, max_km, True, by, same_park)
    want = []
    for q, park, lat, lon in queries:
        near = {}
        for i, of, kind, _, y, x in places if lat is not None else ():
            km = kilometres("haversine" if by == "degrees" else by, lat, lon, y, x)
            if abs(y - lat) <= 1 and abs(x - lon) <= 1 and (not same_park or of == park is not None) and (max_km is None or km <= max_km):
                near.setdefault(kind, []).append((kilometres(by, lat, lon, y, x), i))
        want += [(q, kind, i, n) for kind, found in near.items() for n, (_, i) in enumerate(sorted(found)[:k], 1)]
    assert sorted(((r.qid, r.place_type, r.place_id, r.place_rank) for r in got.collect()), key=repr) == sorted(want, key=repr) and want


@pytest.mark.parametrize("per_type", [False, True])
def test_copies_and_pairs_cost_nothing(spark, per_type):
    """Places at the same spots are left out before they are met, and no pairs of queries and places are dealt or ranked."""
    places = spark.createDataFrame([(i, "p", "town" if i % 2 else "river", "n", 1 + i % 10 / 10, 20.0) for i in range(5_000)], PLACES)
    queries = spark.createDataFrame([(i, "p", 1 + i / 500, 20.1) for i in range(500)], "qid long, park_id string, lat double, lon double")
    wanted = places.select(F.col("id").alias("place_id"), F.col("park_id").alias("place_park"), "place_type", F.col("name").alias("place_name"), F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"))
    assert sorted(r.place_id for r in spatial._first_of_spots(wanted, 2, True, per_type).collect()) == list(range(20))
    plan = spatial.nearest_places(queries, places, ["qid"], 2, 1.0, None, None, per_type)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number() windowspecdefinition(qid" not in plan and "rightHint=(strategy=broadcast)" in plan


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """Small tables with many suppliers at each spot, and DuckDB over them."""
    folder = tmp_path_factory.mktemp("copied")
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    times = {"supplier": ("s_suppkey", 250), "events": ("event_id", 1), "customer": ("c_custkey", 1)}
    for table, (key, n) in times.items():
        file = f"{SMALL}/{table}.parquet"
        con.sql(f"COPY (SELECT * REPLACE (CAST({key} + i * (SELECT max({key}) + 1 FROM '{file}') AS BIGINT) AS {key}) FROM '{file}', range({n}) r(i)) TO '{folder}/{table}.parquet'")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["nearest_of_each_type", "nearest_settlements", "settlement_descriptions"])
def test_queries_on_copies(spark, copied, name):
    folder, con = copied
    df = entry.queries()[name](spark, folder)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want


def test_queries_of_one_file_part_are_dealt_to_tasks(spark):
    """All queries lie in one part of their table, and more than one task looks for their places."""
    places = spark.createDataFrame([(i, "p", "town", "n", 1 + i / 10, 20.0) for i in range(10)], PLACES)
    queries = spark.createDataFrame([(i, "p", 1 + i / 500, 20.1) for i in range(500)], "qid long, park_id string, lat double, lon double").coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spatial.nearest_places(queries, places, ["qid"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 4 and max(r["count"] for r in rows) < 250 and sum(r["count"] for r in rows) == 500


def test_settlements_at_a_place_are_told_as_in_sql_and_joined_once(spark, tmp_path):
    con = duckdb.connect()
    for table, columns in {"supplier": "*", "customer": "* REPLACE (CAST(0 AS BIGINT) AS c_nationkey)"}.items():
        con.sql(f"COPY (SELECT {columns} FROM '{SMALL}/{table}.parquet') TO '{tmp_path}/{table}.parquet'")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    df = entry.queries()["settlement_descriptions"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()['settlement_descriptions']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and any(", 0 km " in d for _, d in want)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1

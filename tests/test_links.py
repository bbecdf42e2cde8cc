"""Links of components against links of whole years."""

import datetime
import random

import numpy as np
import pytest

from acacia.operators import clusters

DAY = datetime.date(2023, 12, 20)


def whole_years(rows, rule):
    groups = {}
    for park, date, cid, lat, lon, fires in rows:
        groups.setdefault((park, date.year), []).append((date.toordinal(), str(cid) if rule.day_by_day else cid, cid, lat, lon, fires))
    out = []
    for (park, year), nodes in groups.items():
        nodes.sort()
        day, _, cid, lat, lon, fires = zip(*nodes, strict=True)
        found = clusters.link(np.array(lat), np.array(lon), np.array(day), np.array(fires, float), rule)
        out += [(park, year, t, s, day[i], cid[i]) for t, path in enumerate(found) for s, i in enumerate(path)]
    return out


@pytest.mark.parametrize("rule", [clusters.SCORED, clusters.NEAREST, clusters.DAY_BY_DAY, clusters.Linking("haversine", 120.0, max_gap=5, southward=2.0)])
def test_components_link_as_the_year_does(spark, rule):
    """Two years, a null park, crowded and lonely clusters, high latitudes and both sides of the 180th meridian."""
    rng = random.Random(9)
    middles = [("p", 1.0, 20.0, 0.5), ("p", -3.0, 25.0, 2.0), ("q", 86.5, 10.0, 3.0), ("r", 12.0, 180.0, 0.4), (None, 60.0, -100.0, 1.0), ("s", -89.5, 0.0, 0.4)]
    rows, counts = [], {}
    for _ in range(900):
        park, lat, lon, spread = rng.choice(middles)
        date = DAY + datetime.timedelta(days=rng.randrange(25))
        cid = counts[park, date] = counts.get((park, date), -1) + 1
        x = float((lon + rng.uniform(-spread, spread) / max(0.02, np.cos(np.radians(lat))) + 180) % 360 - 180)
        rows.append((park, date, cid, max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), x, rng.randrange(1, 60)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "park_id string, acq_date date, cid int, lat double, lon double, fires int").selectExpr("*", "1.5D AS frp", "2.5D AS spread_km").repartition(3)
    got = [(r.park_id, r.year, r.traj_id, r.seq, r.acq_date.toordinal(), r.cid) for r in clusters.trajectories(df, rule).collect()]
    assert sorted(got, key=repr) == sorted(whole_years(rows, rule), key=repr) and len(got) > 100


def test_no_group_holds_a_year(spark):
    """Places out of each other's reach are linked apart, and the plan deals by component."""
    rows = [(f"p{i % 2}", DAY + datetime.timedelta(days=d), i, float(i), 20.0, 5) for i in range(30) for d in range(8)]
    df = spark.createDataFrame(rows, "park_id string, acq_date date, cid int, lat double, lon double, fires int").selectExpr("*", "1.5D AS frp", "2.5D AS spread_km", "year(acq_date) AS year", "datediff(acq_date, '1970-01-01') AS day", "monotonically_increasing_id() AS node")
    df = spark.createDataFrame(df.collect(), df.schema)  # the numbers stay
    pairs = clusters.candidates(df, clusters.NEAREST)
    nodes = {r.node: (r.park_id, r.cid, r.day) for r in df.collect()}
    found = [(nodes[r.a], nodes[r.b]) for r in pairs.collect()]
    assert found and all(a[:2] == b[:2] and 1 <= b[2] - a[2] <= 3 for a, b in found)
    assert len(found) == 30 * (7 + 6 + 5) and len(set(found)) == len(found)
    assert clusters.trajectories(df, clusters.NEAREST).groupBy("park_id", "year", "traj_id").count().count() == 30


def test_no_clusters(spark):
    df = spark.createDataFrame([], "park_id string, acq_date date, cid int, lat double, lon double, fires int, frp double, spread_km double")
    for rule in (clusters.SCORED, clusters.DAY_BY_DAY):
        assert clusters.trajectories(df, rule).collect() == []

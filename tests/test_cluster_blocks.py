"""Density clusters cut into blocks against the kernel on whole groups, and greedy links against a plain restatement."""

import math
import random
import time

import numpy as np
import pytest

from acacia.operators import clusters
from acacia.plans import views


def plain_dbscan(points, eps, least):
    n = len(points)
    near = [[j for j in range(n) if sum((a - b) ** 2 for a, b in zip(points[i], points[j])) <= eps * eps] for i in range(n)]
    core = [len(x) >= least for x in near]
    label, number = [-1] * n, 0
    for i in range(n):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], number
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = number
                        stack.append(j)
            number += 1
    return [label[i] if core[i] else min((label[j] for j in near[i] if core[j]), default=-1) for i in range(n)]


@pytest.mark.parametrize("dims", [2, 3])
def test_kernel_against_plain(dims):
    rnd = random.Random(dims)
    for _ in range(15):
        centers = [[rnd.uniform(0, 10) for _ in range(dims)] for _ in range(4)]
        points = sorted([c + rnd.gauss(0, 0.6) for c in rnd.choice(centers)] for _ in range(rnd.randint(1, 90)))
        assert clusters.dbscan(np.array(points), 0.7, 4).tolist() == plain_dbscan(points, 0.7, 4)


def rows_of(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def scattered(spark):
    rnd = random.Random(3)
    rows = []
    for day in range(3):
        lat, lon = 5.0, 20.0
        for i in range(700):
            lat, lon = lat + rnd.gauss(0, 0.03), lon + rnd.gauss(0, 0.03)
            rows.append((["p", None][day % 2], day + 1, round(lat, 2), round(lon, 2), rnd.random()))
    df = spark.createDataFrame(rows, "park_id string, day int, latitude double, longitude double, frp double")
    return df.selectExpr("park_id", "make_date(2024, 1, day) AS acq_date", "latitude", "longitude", "frp", "1 AS inside")


@pytest.mark.parametrize("preset", [clusters.GROUPS, clusters.STREAMED, clusters.Clustering(2.0, 5)])
def test_days_in_blocks(scattered, preset, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 3)
    whole = rows_of(clusters.daily_clusters(scattered, preset))
    assert len(whole) >= 3 and rows_of(clusters.daily_clusters(scattered, preset, most=100)) == whole


def test_herds_in_blocks(scattered, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 2)
    whole = rows_of(clusters.herds(scattered, eps=1.0))
    assert len({r[-1] for r in whole}) > 1 and rows_of(clusters.herds(scattered, eps=1.0, most=100)) == whole


def plain_links(nodes, rule):
    """Trajectories of (day, place in its day's order, lat, lon, fires) by the rule, one candidate at a time."""
    nodes = sorted(nodes, key=lambda n: (n[0], str(n[1]) if rule.day_by_day else n[1]))
    used, out = set(), []

    def km(a, b):
        if rule.metric == "planar":
            return math.hypot(b[2] - a[2], b[3] - a[3]) * 111
        if rule.metric == "equirect":
            return math.hypot((b[2] - a[2]) * 111, (b[3] - a[3]) * 111 * math.cos(math.radians((a[2] + b[2]) / 2)))
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for start in range(len(nodes)):
        if start in used:
            continue
        used.add(start)
        path = [start]
        while True:
            at, best = nodes[path[-1]], None
            for gap in range(1, rule.max_gap + 1):
                for i, n in enumerate(nodes):
                    d = km(at, n)
                    if i not in used and n[0] == at[0] + gap and (d < rule.max_km or d == rule.max_km and not rule.strict):
                        score = d - rule.southward * (at[2] - n[2]) + rule.sizes * max(n[4], at[4]) / max(1, min(n[4], at[4]))
                        if best is None or score < best[0]:
                            best = (score, i)
                if best:
                    break
            if best is None or rule.day_by_day and len(path) > 100:
                break
            used.add(best[1])
            path.append(best[1])
        if len(path) >= rule.least:
            out.append([nodes[i][:2] for i in path])
    return out


@pytest.mark.parametrize("rule", [clusters.SCORED, clusters.SCORED_BY_MOVE, clusters.NEAREST, clusters.DAY_BY_DAY])
@pytest.mark.parametrize("preset", [clusters.GROUPS, clusters.STREAMED])
def test_links_against_plain(spark, rule, preset):
    daily = clusters.daily_clusters(views.view(spark, "/root/testdata/sf0.01", "detections"), preset)
    groups = {}
    for r in daily.collect():
        groups.setdefault(r.park_id, []).append((r.acq_date.toordinal(), r.cid, r.lat, r.lon, r.fires))
    want = sorted((park, t, s, *n) for park, nodes in groups.items() for t, path in enumerate(plain_links(nodes, rule)) for s, n in enumerate(path))
    got = sorted((r.park_id, r.traj_id, r.seq, r.acq_date.toordinal(), r.cid) for r in clusters.trajectories(daily, rule).collect())
    assert got == want and got


def test_close_needs_no_pairs_of_all_points():
    """Two crowded cells just out of each other's reach; all pairs of them would be 40 thousand million."""
    rng = np.random.default_rng(5)
    a, b = rng.random((200_000, 3)), rng.random((200_000, 3)) + [3.0, 0, 0]
    began = time.perf_counter()
    assert not clusters._close(a, b, 2.0 - 1e-3) and clusters._close(a, b, 2.3)
    assert time.perf_counter() - began < 20
    for n in range(200):
        a, b, eps = rng.random((n % 40 + 1, 2)), rng.random((n % 7 + 1, 2)) + [rng.random(), 0.5], 0.3
        d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        assert clusters._close(a, b, eps, 4) == bool((d <= eps * eps).any())

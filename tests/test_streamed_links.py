"""Streamed links against the batch linker, over a restart, and the end of the state."""

import datetime
import random

import numpy as np
import pytest

from acacia.operators import clusters
from acacia.streaming import links

FIRST = datetime.date(2023, 12, 24)
SCHEMA = "park_id string, acq_date date, cid int, lat double, lon double, fires int"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def clusters_of(seed, days):
    rng = random.Random(seed)
    out = []
    for park in ("p", None):
        for d in range(days):
            for cid in range(rng.randrange(0, 7)):
                out.append((park, FIRST + datetime.timedelta(days=d), cid, rng.uniform(0, 0.6), 20 + rng.uniform(0, 0.6), rng.randrange(1, 30)))
    return out


def batch_paths(rows, rule):
    out, groups = set(), {}
    for park, date, cid, lat, lon, fires in rows:
        groups.setdefault((park, date.year), []).append((date.toordinal(), str(cid) if rule.day_by_day else cid, lat, lon, fires, cid))
    for (park, year), nodes in groups.items():
        nodes.sort()
        day, _, lat, lon, fires, cid = zip(*nodes, strict=True)
        for path in clusters.link(np.array(lat), np.array(lon), np.array(day), np.array(fires, float), rule):
            out.add((park, year, tuple((day[i], cid[i]) for i in path)))
    return out


def drained(spark, tmp_path, rule, files, late):
    """One run of the stream over what the folder holds."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = links.linked_trajectories(stream, rule, late).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).outputMode("append").start()
    try:
        q.processAllAvailable()
        return q.lastProgress
    finally:
        q.stop()


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("rule", [clusters.NEAREST, clusters.SCORED])
def test_equals_batch_after_a_restart(spark, tmp_path, rule):
    """Days in any order within the watermark, a null park, a change of the year, and a new query from the checkpoint half-way."""
    rows = clusters_of(4, 16)
    rng = random.Random(1)
    for half in (lambda d: d < 8, lambda d: d >= 8):
        own = [r for r in rows if half((r[1] - FIRST).days)]
        own.sort(key=lambda r: (r[1] - FIRST).days // 2 + rng.random() / 2)
        for i in range(0, len(own), 40):
            put(spark, tmp_path, own[i : i + 40])
        drained(spark, tmp_path, rule, 0, "6 days")
    far = FIRST + datetime.timedelta(days=400)
    put(spark, tmp_path, [("end", far, 0, 0.0, 0.0, 1)])
    put(spark, tmp_path, [("end", far, 1, 9.0, 0.0, 1)])
    progress = drained(spark, tmp_path, rule, 0, "6 days")
    paths = {}
    for r in spark.read.parquet(str(tmp_path / "out")).where("park_id is null or park_id <> 'end'").collect():
        paths.setdefault((r.park_id, r.year, r.start_date, r.start_place), []).append((r.node, r.acq_date.toordinal(), r.cid))
    assert sum(map(len, paths.values())) == len(rows)
    got = {(k[0], k[1], tuple(n[1:] for n in sorted(v))) for k, v in paths.items() if len(v) >= rule.least}
    assert got == batch_paths(rows, rule) and len(got) > 2
    # Nothing but the last day's two clusters and their timers is left.
    assert progress["stateOperators"][0]["numRowsTotal"] <= 2 + 2 * 2 * 2

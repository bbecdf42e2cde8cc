"""Daily clusters linked into trajectories as they arrive, with the links that the batch linker gives.

State is kept by park and year: the clusters of days that may still grow, and each open trajectory's last
cluster, an entry a trajectory. An event-time timer ends each day once the watermark has passed it; the day's
clusters are then linked, older trajectories first, as the batch linker has it. Another timer ends the
trajectories that nothing can follow any more, so that a park's state is empty once the gap has passed.
Trajectories are named by the day and the place within the day of their first cluster, which needs no counter.

Defined cases: clusters of a park's day come in any order and over any number of batches up to the watermark,
and later ones are dropped; a cluster (cid) of a day that comes again replaces the one before; rows without a
date, position or cid are left out; a null park is a park of its own; fires that are null count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from acacia.operators import clusters

_DAY = 86_400_000
LINKED = "park_id string, year int, start_date date, start_place int, node int, acq_date date, cid int, lat double, lon double, fires int"
_NAMES = [c.split()[0] for c in LINKED.split(", ")]


class OpenTrajectories(StatefulProcessor):
    """Links one park's year day by day."""

    def __init__(self, rule: clusters.Linking):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day int, cid int", "lat double, lon double, fires int")
        self.open = handle.getMapState("open", "start int, place int", "lat double, lon double, fires int, day int, nodes int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days: set[int] = set()
        for batch in rows:
            for day, cid, lat, lon, fires in batch[["day", "cid", "lat", "lon", "fires"]].itertuples(index=False):
                self.waiting.updateValue((int(day), int(cid)), (float(lat), float(lon), int(fires)))
                days.add(int(day))
        for day in days:
            self.handle.registerTimer(day * _DAY)
            self.handle.registerTimer((day + self.rule.max_gap) * _DAY)
        yield pd.DataFrame(columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // _DAY
        by_day: dict[int, list[tuple]] = {}
        for (day, cid), (lat, lon, fires) in self.waiting.iterator():
            if day <= now:
                by_day.setdefault(day, []).append((cid, lat, lon, fires))
        tracks = {tuple(k): tuple(v) for k, v in self.open.iterator()}
        before = dict(tracks)
        out: list[tuple] = []
        for day in sorted(by_day):
            out += self._linked(tracks, day, sorted(by_day[day], key=lambda c: str(c[0]) if self.rule.day_by_day else c[0]))
        for day, rows in by_day.items():
            for row in rows:
                self.waiting.removeKey((day, row[0]))
        for name, track in tracks.items():
            if now - track[3] >= self.rule.max_gap:
                if name in before:
                    self.open.removeKey(name)
            elif before.get(name) != track:
                self.open.updateValue(name, track)
        frame = pd.DataFrame([(*key, *row) for row in out], columns=_NAMES)
        for c in ("start_date", "acq_date"):
            frame[c] = pd.to_datetime(frame[c], unit="D").dt.date
        yield frame

    def _linked(self, tracks: dict[tuple, tuple], day: int, found: list[tuple]) -> list[tuple]:
        """A day's clusters as nodes; tracks go on with them or begin."""
        cid, lat, lon, fires = (np.array([c[i] for c in found], float) for i in range(4))
        free = np.ones(len(found), bool)
        out = []

        def node(name: tuple, i: int, number: int) -> None:
            tracks[name] = (float(lat[i]), float(lon[i]), int(fires[i]), day, number)
            out.append((*name, number, day, int(cid[i]), float(lat[i]), float(lon[i]), int(fires[i])))
            free[i] = False

        for name in sorted(tracks):
            y, x, size, last, number = tracks[name]
            if not 0 < day - last <= self.rule.max_gap or (self.rule.day_by_day and number >= 100):
                continue
            score = clusters.scores(self.rule, y, x, size, lat, lon, fires)
            score[~free] = np.inf
            if np.isfinite(score).any():
                node(name, int(np.argmin(score)), number + 1)
        for place, i in enumerate(np.flatnonzero(free)):
            node((day, place), int(i), 0)
        return out

    def close(self) -> None:
        pass


def linked_trajectories(daily: DataFrame, rule: clusters.Linking = clusters.NEAREST, late: str = "3 days") -> DataFrame:
    """Nodes of trajectories from a stream of daily clusters (park_id, acq_date, cid, lat, lon, fires); short trajectories are among them.

    Runs on the RocksDB state store, as timers and map state need it.
    """
    day = F.unix_date("acq_date")
    rows = daily.where("acq_date is not null and lat is not null and lon is not null and cid is not null").select(
        "park_id", F.year("acq_date").alias("year"), day.alias("day"), F.timestamp_seconds(day.cast("long") * 86_400).alias("at"),
        F.col("cid").cast("int").alias("cid"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.coalesce(F.col("fires").cast("int"), F.lit(0)).alias("fires"),
    )
    return rows.withWatermark("at", late).groupBy("park_id", "year").transformWithStateInPandas(OpenTrajectories(rule), LINKED, "Append", "EventTime")

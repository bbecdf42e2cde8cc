"""Density clusters, their links over days, and connected pixels.

One task works on one park's day (or year, or raster tile) while that is small enough, and on a block of it where
it is not; the numpy kernels below see only that. Point sets and clusters come in a fixed order, on which ties
and border points depend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acacia.functions import geo
from acacia.operators.work import written


def _close(a: np.ndarray, b: np.ndarray, eps: float, pairs: int = 1 << 20) -> bool:
    """Whether a point of ``a`` lies within ``eps`` of one of ``b``: boxes that lie apart are left out, and those that don't are halved down to so many pairs."""
    todo, limit = [(a, b)], eps * eps
    while todo:
        a, b = todo.pop()
        (low_a, high_a), (low_b, high_b) = ((x.min(axis=0), x.max(axis=0)) for x in (a, b))
        if (np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)) ** 2).sum() > limit * (1 + 1e-12):
            continue
        if (np.maximum(high_a - low_b, high_b - low_a) ** 2).sum() <= limit * (1 - 1e-12):
            return True
        a = a[(np.maximum(0, np.maximum(low_b - a, a - high_b)) ** 2).sum(axis=1) <= limit * (1 + 1e-12)]
        if not len(a):
            continue
        if len(a) * len(b) <= pairs:
            if (((a[:, None] - b[None]) ** 2).sum(axis=2) <= limit).any():
                return True
            continue
        if len(a) < len(b):
            a, b = b, a
        half = np.argpartition(a[:, np.ptp(a, axis=0).argmax()], len(a) // 2)
        todo += [(a[half[: len(a) // 2]], b), (a[half[len(a) // 2 :]], b)]
    return False


class Density:
    """Core points of a set, the component of each (-1 for others, components numbered by their first core point), and the components near any point.

    Points are put into cells within which all are neighbours. Cells that weigh ``least`` or more hold core points
    only, so that dense places need no pairs; a component is one of cells with core points near each other.
    ``usable`` leaves out points whose neighbours are not all there: they count as neighbours, but are no core points.
    """

    def __init__(self, points: np.ndarray, eps: float, least: int, weight: np.ndarray | None = None, usable: np.ndarray | None = None):
        n, dims = points.shape
        self.points, self.eps = points, eps
        weight = np.ones(n, int) if weight is None else weight
        side = eps / np.sqrt(dims) * (1 - 1e-9)
        self.cell = np.floor((points - points.min(axis=0)) / side).astype(np.int64)
        members: dict[tuple, list[int]] = {}
        for i, c in enumerate(map(tuple, self.cell.tolist())):
            members.setdefault(c, []).append(i)
        self.inside = {c: np.array(own) for c, own in members.items()}
        reach = int(np.ceil(np.sqrt(dims) + 1e-6))
        self.steps = [s for s in np.stack(np.meshgrid(*[range(-reach, reach + 1)] * dims, indexing="ij"), -1).reshape(-1, dims).tolist() if any(s)]
        self.beside: dict[tuple, list[tuple]] = {}
        self.core = core = np.zeros(n, bool)
        for c, own in self.inside.items():
            if weight[own].sum() >= least:
                core[own] = True
                continue
            near = np.concatenate([own, *(self.inside[d] for d in self.around(c))])
            for i in own:
                core[i] = weight[near][((points[near] - points[i]) ** 2).sum(axis=1) <= eps * eps].sum() >= least
        if usable is not None:
            core &= usable
        self.cores = {c: own[core[own]] for c, own in self.inside.items() if core[own].any()}
        parent = {c: c for c in self.cores}

        def root(c: tuple) -> tuple:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        for c, own in self.cores.items():
            for d in self.around(c):
                if d > c and d in self.cores and root(c) != root(d) and _close(points[own], points[self.cores[d]], eps):
                    parent[root(d)] = root(c)
        number: dict[tuple, int] = {}
        self.component = np.full(n, -1)
        for i in np.flatnonzero(core):
            self.component[i] = number.setdefault(root(tuple(self.cell[i].tolist())), len(number))

    def around(self, c: tuple) -> list[tuple]:
        """Occupied cells near a cell."""
        if c not in self.beside:
            self.beside[c] = [d for s in self.steps if (d := tuple(map(add, c, s))) in self.inside]
        return self.beside[c]

    def near(self, i: int) -> np.ndarray:
        """Components with a core point within reach of a point."""
        c = tuple(self.cell[i].tolist())
        there = [self.cores[d] for d in (c, *self.around(c)) if d in self.cores]
        if not there:
            return np.zeros(0, int)
        there = np.concatenate(there)
        return np.unique(self.component[there[((self.points[there] - self.points[i]) ** 2).sum(axis=1) <= self.eps * self.eps]])


def dbscan(points: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Labels from 0 in the order of each cluster's first core point; noise is -1. A point counts among its own neighbours, and a border point belongs to the first cluster it is near."""
    if not len(points):
        return np.full(0, -1)
    found = Density(points, eps, least)
    labels = found.component.copy()
    for i in np.flatnonzero(~found.core):
        near = found.near(i)
        if len(near):
            labels[i] = near[0]
    return labels


#: Rows of a group up to which one task clusters it; larger groups are cut into blocks of so many radii a side.
MOST_ROWS, BLOCK = 200_000, 8


def _of_groups(rows: DataFrame, groups: DataFrame, by: list[str], how: str) -> DataFrame:
    """Rows whose group is (or is not) among some; a null is a group like any other."""
    named = groups.select(*[F.col(c).alias(f"group_{c}") for c in by])
    same = F.lit(True)
    for c in by:
        same = same & rows[c].eqNullSafe(named[f"group_{c}"])
    return rows.join(named, same, how)


def large_groups(rows: DataFrame, by: list[str], most: int) -> DataFrame | None:
    """Groups of more rows than ``most``, or None."""
    large = written(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*by), "large")
    return None if large.isEmpty() else large


def labelled_in_blocks(rows: DataFrame, by: list[str], axes: list[Column], first: list[int], eps: float, least: int, name: str) -> DataFrame:
    """Rows in density clusters of their group with the cluster's number, by blocks of space: no task holds a whole group.

    Equal positions become one with a weight. A block gets the positions within two radii of it, so that core points within
    one radius of it are known for sure; a core point that two blocks label joins their labels. Clusters are
    numbered by their first core point in the order of the axes ``first``, as ``dbscan`` does on sorted points.
    """
    from acacia.operators.components import connected

    at = [f"{name}_{i}" for i in range(len(axes))]
    placed = rows.withColumns(dict(zip(at, axes, strict=True)))
    spots = placed.groupBy(*by, *at).agg(F.count(F.lit(1)).alias("weight"))
    side = BLOCK * eps
    dealt = spots
    for c in at:
        dealt = dealt.withColumn(f"block_{c}", F.explode(F.sequence(F.floor((F.col(c) - 2 * eps) / side), F.floor((F.col(c) + 2 * eps) / side))))
    blocks = [f"block_{c}" for c in at]
    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields), *(f"{c} double" for c in at)])

    def run(table: pd.DataFrame) -> pd.DataFrame:
        points = table[at].to_numpy(float)
        table, points = table.iloc[order := np.lexsort(points.T[::-1])], points[order]
        block = table[blocks].to_numpy(float)[0]
        low = block * side
        own = (np.floor(points / side) == block).all(axis=1)
        sure = ((points >= low - eps) & (points <= low + side + eps)).all(axis=1)
        found = Density(points, eps, least, table["weight"].to_numpy(), sure)
        tag = ":".join(str(int(x)) for x in table[blocks].iloc[0]) + ":" + ":".join(map(str, table[by].iloc[0])) + ":"
        told = [[tag + str(found.component[i])] if found.core[i] else [tag + str(x) for x in found.near(i)] if own[i] else [] for i in range(len(points))]
        out = table[[*by, *at]].assign(own=own, core=found.core, labels=told)
        return out[[bool(t) for t in told]]

    marked = written(dealt.groupBy(*by, *blocks).applyInPandas(run, kinds + ", own boolean, core boolean, labels array<string>"), "marked")
    several = marked.where("core").groupBy(*by, *at).agg(F.array_sort(F.collect_set(F.col("labels")[0])).alias("l")).where(F.size("l") > 1)
    roots = connected(several.select(F.col("l")[0].alias("a"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("b")))
    told = marked.where("own").withColumn("label", F.explode("labels")).join(roots, F.col("label") == F.col("node"), "left")
    told = written(told.select(*by, *at, "core", F.coalesce("root", "label").alias("root")), "told")
    starts = told.where("core").groupBy(*by, "root").agg(F.min(F.struct(*[at[i] for i in first])).alias("start"))
    numbers = starts.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy("start")) - 1).cast("int")).select("root", name)
    chosen = told.join(numbers, "root").groupBy(*by, *at).agg(F.min(name).alias(name)).select(*[F.col(c).alias(f"of_{c}") for c in (*by, *at)], name)
    same = F.lit(True)
    for c in (*by, *at):
        same = same & (placed[c].eqNullSafe(chosen[f"of_{c}"]) if c in by else placed[c] == chosen[f"of_{c}"])
    return placed.join(chosen, same).select(*rows.columns, name)


@dataclass(frozen=True)
class Clustering:
    eps_km: float
    least: int
    day_least: int = 1


#: Presets: the analysis of group movements, the constant-memory run, and single linkage.
GROUPS = Clustering(15.0, 4, 8)
STREAMED = Clustering(5.0, 3)
LINKED = Clustering(5.0, 1)

_CLUSTERS = "park_id string, acq_date date, cid int, lat double, lon double, lat_min double, lat_max double, fires int, frp double, avg_frp double, spread_km double"


def daily_clusters(detections: DataFrame, preset: Clustering = GROUPS, most: int = MOST_ROWS) -> DataFrame:
    """Clusters of each park's day from park_id, acq_date, latitude, longitude and frp."""
    by = ["park_id", "acq_date"]
    rows = detections.select(*by, "latitude", "longitude", "frp")
    large = large_groups(rows, by, most)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) >= preset.day_least:
            rows = rows.sort_values(["latitude", "longitude", "frp"], kind="stable")
            lat, lon, frp = (rows[c].to_numpy(float) for c in ("latitude", "longitude", "frp"))
            labels = dbscan(np.stack([lat, lon], axis=1), preset.eps_km / 111.0, preset.least)
            frp = np.nan_to_num(frp)
            for c in range(labels.max(initial=-1) + 1):
                on = labels == c
                y, x, f = lat[on], lon[on], frp[on]
                out.append((rows["park_id"].iloc[0], rows["acq_date"].iloc[0], c, y.mean(), x.mean(), y.min(), y.max(), int(on.sum()), f.sum(), f.mean(), max(np.ptp(y), np.ptp(x)) * 111.0))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _CLUSTERS.split(", ")])

    if large is None:
        return rows.groupBy(*by).applyInPandas(run, _CLUSTERS)
    small = _of_groups(rows, large, by, "left_anti").groupBy(*by).applyInPandas(run, _CLUSTERS)
    members = labelled_in_blocks(_of_groups(rows, large, by, "left_semi"), by, [F.col("latitude"), F.col("longitude")], [0, 1], preset.eps_km / 111.0, preset.least, "cid")
    power = F.coalesce(F.nanvl("frp", F.lit(0.0)), F.lit(0.0))
    ends = [f(c).alias(f"{c[:3]}_{n}") for c in ("latitude", "longitude") for n, f in (("min", F.min), ("max", F.max))]
    whole = members.groupBy(*by, "cid").agg(
        F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), *ends, F.count(F.lit(1)).cast("int").alias("fires"), F.sum(power).alias("frp"), F.avg(power).alias("avg_frp")
    )
    spread = F.greatest(F.col("lat_max") - F.col("lat_min"), F.col("lon_max") - F.col("lon_min")) * 111.0
    return small.unionByName(whole.withColumn("spread_km", spread).select(*[c.split()[0] for c in _CLUSTERS.split(", ")]))


@dataclass(frozen=True)
class Linking:
    """How a trajectory chooses its next cluster.

    ``metric`` measures km; ``southward`` km are taken off for each degree south and ``sizes`` added for each
    unit of size ratio; ``strict`` distances stay below the limit. With ``day_by_day`` the gaps 1, 2, ... are
    tried until one has a hit, and clusters go in the order of their names.
    """

    metric: str
    max_km: float
    max_gap: int = 3
    least: int = 1
    southward: float = 0.0
    sizes: float = 0.0
    strict: bool = False
    day_by_day: bool = False


SCORED = Linking("equirect", 25.0, least=5, southward=5.0, sizes=2.0)
SCORED_BY_MOVE = Linking("equirect", 25.0, least=5, southward=5.0)
NEAREST = Linking("planar", 20.0, least=3, strict=True)
DAY_BY_DAY = Linking("haversine", 50.0, strict=True, day_by_day=True)


def _km(metric: str, lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    if metric == "planar":
        return np.sqrt((lats - lat) ** 2 + (lons - lon) ** 2) * 111.0
    if metric == "equirect":
        return np.sqrt(((lats - lat) * 111.0) ** 2 + ((lons - lon) * 111.0 * np.cos(np.radians((lats + lat) / 2))) ** 2)
    a = np.sin(np.radians(lats - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(lats)) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * 6371.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def scores(rule: Linking, lat: float, lon: float, size: float, lats: np.ndarray, lons: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How well clusters follow one, lower being better; infinite for those out of reach."""
    km = _km(rule.metric, lat, lon, lats, lons)
    ratio = np.maximum(sizes, size) / np.maximum(1, np.minimum(sizes, size))
    return np.where(km < rule.max_km if rule.strict else km <= rule.max_km, km - rule.southward * (lat - lats) + rule.sizes * ratio, np.inf)


def link(lat: np.ndarray, lon: np.ndarray, day: np.ndarray, size: np.ndarray, rule: Linking) -> list[list[int]]:
    """Trajectories as lists of cluster indices; clusters come by day and then in the order in which they are tried."""
    free = np.ones(len(day), bool)
    days = np.unique(day)
    by_day = {int(d): np.flatnonzero(day == d) for d in days}

    def best(at: int, there: np.ndarray) -> int | None:
        there = there[free[there]]
        if not len(there):
            return None
        score = scores(rule, lat[at], lon[at], size[at], lat[there], lon[there], size[there])
        return int(there[np.argmin(score)]) if np.isfinite(score).any() else None  # the first of equals

    out = []
    for start in range(len(day)):
        if not free[start]:
            continue
        free[start] = False
        path, at = [start], start
        while True:
            following = None
            for gap in range(1, rule.max_gap + 1):
                following = best(at, by_day.get(int(day[at]) + gap, np.zeros(0, int)))
                if following is not None:
                    break
            if following is None or (rule.day_by_day and len(path) > 100):
                break
            free[following] = False
            path.append(following)
            at = following
        if len(path) >= rule.least:
            out.append(path)
    return out


_NODES = "park_id string, year int, traj_id int, seq int, acq_date date, cid int, lat double, lon double, fires int, frp double, spread_km double"


def candidates(clusters: DataFrame, rule: Linking) -> DataFrame:
    """Pairs (a, b) of clusters (node, park_id, year, day, lat, lon) of one park's year of which the second can follow the first: within the rule's gap and reach.

    Clusters meet by day and cell: rows of cells are as high as the reach, and cells of a row as wide as the reach is anywhere near it.
    """
    reach = rule.max_km / geo.KM_PER_DEGREE * 1.01
    km = {"planar": geo.planar_km, "equirect": geo.equirect_km, "haversine": geo.haversine_km}[rule.metric]
    row = F.floor(F.col("lat") / reach)

    def width(r: Column) -> Column:
        if rule.metric == "planar":
            return F.lit(reach)
        far = F.greatest(F.abs(r), F.abs(r + 1)) * reach + reach
        return F.when(far >= 88, F.lit(360.0)).otherwise(reach / F.cos(F.radians(F.least(far, F.lit(88.0)))))

    turns = (-360.0, 0.0, 360.0) if rule.metric == "haversine" else (0.0,)
    before = clusters.select(
        F.col("node").alias("a"), F.col("park_id").alias("park_a"), F.col("year").alias("year_a"), F.col("day").alias("day_a"), row.alias("row_a"),
        F.floor(F.col("lon") / width(row)).alias("cell_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"),
    )
    after = clusters.select(F.col("node").alias("b"), "park_id", "year", F.col("day"), "lat", "lon", F.explode(F.sequence(row - 1, row + 1)).alias("row"))
    at = [F.floor((F.col("lon") + turn) / width(F.col("row"))) for turn in turns]
    cells = F.array_distinct(F.array(*[cell + i for cell in at for i in (-1, 0, 1)]))
    after = after.withColumn("cell", F.explode(cells)).withColumn("on", F.explode(F.sequence(F.col("day") - rule.max_gap, F.col("day") - 1)))
    same = [F.col(f"{c}_a") == F.col(of) for c, of in (("year", "year"), ("day", "on"), ("row", "row"), ("cell", "cell"))]
    met = before.join(after, [F.col("park_a").eqNullSafe(F.col("park_id")), *same])
    met = met.where(km("lat_a", "lon_a", "lat", "lon") <= rule.max_km * (1 + 1e-9))
    return met.select("a", "b", F.xxhash64("park_a", "year_a", F.floor(F.col("row_a") / 8), F.floor(F.col("cell_a") / 8), F.floor(F.col("day_a") / 32)).alias("block"))


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b, block) to those from each node to the smallest one that it is connected with inside a partition, blocks being dealt whole; they connect what the edges did."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(n: int) -> int:
            while (above := root.setdefault(n, n)) != n:
                root[n] = root[above]
                n = root[n]
            return n

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array([find(n) for n in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])

    return edges.repartition("block").select("a", "b").mapInArrow(run, "a long, b long").where("a <> b")


def trajectories(clusters: DataFrame, rule: Linking = SCORED) -> DataFrame:
    """Nodes of each park's and year's trajectories.

    Clusters compete only where they can follow each other, so each connected component of such pairs is linked
    by itself, which gives the links that the whole year would. Trajectories are numbered by their first clusters:
    within a day, and on from the numbers of the days before.
    """
    from acacia.operators.components import connected

    names = [c.split()[0] for c in _NODES.split(", ")]
    columns = ["park_id", F.year("acq_date").alias("year"), *[c for c in names if c not in ("park_id", "year", "traj_id", "seq")]]
    day = F.datediff("acq_date", F.lit("1970-01-01"))
    rows = written(clusters.select(*columns).withColumn("day", day).withColumn("node", F.monotonically_increasing_id()), "clusters")
    roots = connected(stars(candidates(rows, rule))).select(F.col("node").alias("of"), "root")
    # A component's smallest node is its root and has no row of its own; nodes without pairs have no component.
    roots = roots.unionByName(roots.select(F.col("root").alias("of"), "root").distinct())
    placed = written(rows.join(roots, F.col("node") == F.col("of"), "left").withColumnRenamed("root", "component").drop("of"), "components")
    schema = _NODES.replace("traj_id int", "start long")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(name=rows["cid"].astype(str))
        rows = rows.sort_values(["day", "name" if rule.day_by_day else "cid"], kind="stable").reset_index(drop=True)
        found = link(*(rows[c].to_numpy(float) for c in ("lat", "lon")), rows["day"].to_numpy(int), rows["fires"].to_numpy(float), rule)
        out = rows.iloc[[i for path in found for i in path]].copy()
        out["start"] = np.repeat([rows["node"][p[0]] for p in found], [len(p) for p in found]).astype("int64")
        out["seq"] = np.concatenate([np.arange(len(p)) for p in found]).astype("int32") if found else np.zeros(0, "int32")
        return out[[c.split()[0] for c in schema.split(", ")]]

    nodes = placed.where("component is not null").groupBy("component").applyInPandas(run, schema)
    if rule.least <= 1:
        alone = placed.where("component is null").withColumn("start", F.col("node")).withColumn("seq", F.lit(0))
        nodes = nodes.unionByName(alone.select(*[F.expr(f"cast({c} as {kind}) as {c}") for c, kind in map(str.split, schema.split(", "))]))
    nodes = written(nodes, "nodes")
    starts = nodes.where("seq = 0").select("park_id", "year", "acq_date", "start", (F.col("cid").cast("string") if rule.day_by_day else F.col("cid")).alias("name"))
    days = starts.groupBy("park_id", "year", "acq_date").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("park_id", "year").orderBy("acq_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col("park_id").alias("of"), F.col("acq_date").alias("on"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # a park's year has no more rows here than days
    place = F.row_number().over(Window.partitionBy("park_id", "acq_date").orderBy("name")) - 1
    numbers = starts.withColumn("place", place).join(days, [F.col("park_id").eqNullSafe(F.col("of")), F.col("acq_date") == F.col("on")])
    numbers = numbers.select(F.col("start").alias("first"), (F.col("place") + F.col("before")).cast("int").alias("traj_id"))
    return nodes.join(numbers, F.col("start") == F.col("first")).select(*names)


def herds(detections: DataFrame, least_fires: int = 100, eps: float = 3.0, least: int = 20, most: int = MOST_ROWS) -> DataFrame:
    """Members of space-time clusters of each park's year: ten units a degree, three tenths a day."""
    by = ["park_id", "year"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["acq_date", "latitude", "longitude", "frp"], kind="stable")
        if len(rows) < least_fires:
            return rows.iloc[:0].assign(herd=pd.Series(dtype="int32"))
        day = pd.to_datetime(rows["acq_date"]).dt.dayofyear.to_numpy(float)
        space = np.stack([rows["latitude"].to_numpy(float) * 10, rows["longitude"].to_numpy(float) * 10, day * 0.3], axis=1)
        rows = rows.assign(herd=dbscan(space, eps, least).astype("int32"))
        return rows[rows["herd"] >= 0]

    columns = ["park_id", "year", "acq_date", "latitude", "longitude", "frp", "inside"]
    schema = "park_id string, year int, acq_date date, latitude double, longitude double, frp double, inside int, herd int"
    rows = detections.withColumn("year", F.year("acq_date")).select(*columns)
    large = large_groups(rows, by, most)
    if large is None:
        return rows.groupBy(*by).applyInPandas(run, schema)
    small = _of_groups(rows, large, by, "left_anti").groupBy(*by).applyInPandas(run, schema)
    axes = [F.col("latitude") * 10, F.col("longitude") * 10, F.dayofyear("acq_date") * 0.3]
    return small.unionByName(labelled_in_blocks(_of_groups(rows, large, by, "left_semi"), by, axes, [2, 0, 1], eps, least, "herd"))


def label_pixels(r: np.ndarray, c: np.ndarray, corners: bool) -> np.ndarray:
    """Components of pixels that touch by edges (and corners), numbered from 1 by their first pixel in row order."""
    order = np.lexsort((c, r))
    at = {(int(y), int(x)): i for i, (y, x) in enumerate(zip(r[order], c[order], strict=True))}
    parent = list(range(len(order)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    before = ((-1, 0), (0, -1), (-1, -1), (-1, 1)) if corners else ((-1, 0), (0, -1))
    for (y, x), i in at.items():
        for dy, dx in before:
            j = at.get((y + dy, x + dx))
            if j is not None:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(order))], int)
    _, numbers = np.unique(roots, return_inverse=True)
    out = np.empty(len(order), int)
    out[order] = numbers + 1
    return out


def pixel_components(pixels: DataFrame, by: list[str], corners: bool = False) -> DataFrame:
    """Pixels (by, r, c, value) with the component each belongs to; components end at the border of a group."""
    fields = [f for f in pixels.schema.fields if f.name in (*by, "r", "c", "value")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", component int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(component=label_pixels(rows["r"].to_numpy(int), rows["c"].to_numpy(int), corners).astype("int32"))

    return pixels.select(*[f.name for f in fields]).groupBy(*by).applyInPandas(run, schema)

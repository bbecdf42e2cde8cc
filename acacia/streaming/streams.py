"""Detections and patrols as streams; the windowed ones have batch twins that give the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from acacia import schemas
from acacia.functions import geo
from acacia.operators import clusters, merge


def detections(spark: SparkSession, path: str, late: str = "3 days") -> DataFrame:
    """New Parquet detections (with ts) of a folder, each natural key once within the watermark."""
    rows = spark.readStream.schema(schemas.DETECTION + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(schemas.DETECTION_KEY)


def daily_grid(rows: DataFrame, late: str | None = None) -> DataFrame:
    """Fires and radiative power of each fire cell and day, from ts, latitude, longitude and frp; streams give a watermark."""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    day = F.window("ts", "1 day")
    out = timed.groupBy(geo.fire_cell_id("latitude", "longitude").alias("grid_cell_id"), day.alias("day")).agg(F.count(F.lit(1)).alias("fire_count"), F.sum("frp").alias("total_frp"))
    return out.select("grid_cell_id", F.to_date("day.start").alias("date"), "fire_count", "total_frp")


def patrol_sessions(rows: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Activity of each user between gaps. (A duration split is another thing: see ``tracks.split_by_duration``.)"""
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    out = timed.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count(F.lit(1)).alias("points"))
    return out.select("user_id", F.col("session.start").alias("start_time"), F.col("session.end").alias("end_time"), "points")


def upsert_effort(batches: DataFrame, target: str, checkpoint: str, key: list[str], sums: list[str], deals: int = 64):
    """Adds each micro-batch to a table; only the deals (parts of the table by hash of the key) that a batch touches are written again.

    Every version of a deal lies in its own folder, and the newest below a batch's number is its base: a batch that
    comes again finds what it found before, and writes the same. Versions before the base are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("deal", F.pmod(F.xxhash64(*key), F.lit(deals)).cast("int"))
        files = spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())

        def path(*parts: str):
            return spark._jvm.org.apache.hadoop.fs.Path("/".join([target, *parts]))

        touched = [r["deal"] for r in fresh.select("deal").distinct().collect()]  # as many as there are deals at most
        bases, old = [], []
        for deal in touched:
            there = path(f"deal={deal}")
            versions = sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(there)) if files.exists(there) else []
            before = [v for v in versions if v < number]
            bases += [f"{target}/deal={deal}/version={v}" for v in before[-1:]]
            old += [path(f"deal={deal}", f"version={v}") for v in before[:-1]]
        base = spark.read.schema(batch.schema).parquet(*bases) if bases else batch.limit(0)
        both = merge.add_up(base, batch, key, sums).withColumn("deal", F.pmod(F.xxhash64(*key), F.lit(deals)).cast("int")).withColumn("version", F.lit(number))
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("deal", "version").parquet(target)
        for path_ in old:
            files.delete(path_, True)

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def effort_table(spark: SparkSession, target: str) -> DataFrame:
    """The table that ``upsert_effort`` keeps: the newest version of every deal."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy("deal").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["deal", "version"]).drop("deal", "version")  # a row for each deal


_LINKED = "park_id string, traj_id long, node int, acq_date date, lat double, lon double, fires int"


def open_trajectories(daily: DataFrame, rule: clusters.Linking = clusters.NEAREST) -> DataFrame:
    """Links a stream of daily clusters (park_id, acq_date, lat, lon, fires) to each park's open trajectories, in the order of days."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks, issued = ([list(t) for t in state.get[0]], state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches))
        rows = rows.assign(day=pd.to_datetime(rows["acq_date"]).map(datetime.toordinal)).sort_values(["day", "lat", "lon"], kind="stable")
        out = []
        for day, own in rows.groupby("day", sort=True):
            tracks = [t for t in tracks if day - t[3] <= rule.max_gap]
            free = list(own.itertuples())
            for t in tracks:
                if t[3] >= day or not free:
                    continue
                km = clusters._km(rule.metric, t[1], t[2], *(pd.Series([getattr(c, x) for c in free]).to_numpy(float) for x in ("lat", "lon")))
                if km.min() < rule.max_km:
                    c = free.pop(int(km.argmin()))
                    t[1:] = [float(c.lat), float(c.lon), int(day), t[4] + 1]
                    out.append((key[0], int(t[0]), int(t[4]), c.acq_date, c.lat, c.lon, c.fires))
            for c in free:
                tracks.append([issued, float(c.lat), float(c.lon), int(day), 0])
                out.append((key[0], issued, 0, c.acq_date, c.lat, c.lon, c.fires))
                issued += 1
        state.update((tracks, issued))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _LINKED.split(", ")])

    state_schema = "tracks array<struct<id:long,lat:double,lon:double,day:long,nodes:long>>, issued long"
    return daily.groupBy("park_id").applyInPandasWithState(run, _LINKED, state_schema, "append", GroupStateTimeout.NoTimeout)

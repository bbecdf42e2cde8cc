from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from acacia.operators import clusters
from acacia.streaming import streams


def drain(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def write(spark, path, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_daily_grid_stream_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(hours=7 * i), 1.0 + i % 3 / 10, 2.0, float(i)) for i in range(40)]
    schema = "ts timestamp, latitude double, longitude double, frp double"
    write(spark, tmp_path / "in", [rows[:20], rows[20:]], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(streams.daily_grid(stream, "30 days"), "complete", "grid")
    batch = streams.daily_grid(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.table("grid").collect())) == sorted(map(tuple, batch.collect()))


def test_sessions_stream_equals_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i % 3, t0 + timedelta(minutes=i * 9 + (i // 10) * 60)) for i in range(40)]
    write(spark, tmp_path / "in", [rows[:15], rows[15:]], "user_id long, ts timestamp")
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(streams.patrol_sessions(stream, late="30 days"), "complete", "sessions")
    batch = streams.patrol_sessions(spark.createDataFrame(rows, "user_id long, ts timestamp"))
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, batch.collect()))


def test_detections_once(spark, tmp_path):
    row = (1.0, 2.0, 3.0, 0.4, 0.4, date(2024, 1, 1), "0005", "N", "VIIRS", "n", "2", 290.0, 5.0, "D", datetime(2024, 1, 1, 0, 5))
    schema = "latitude double, longitude double, brightness double, scan double, track double, acq_date date, acq_time string, satellite string, instrument string, confidence string, version string, bright_t31 double, frp double, daynight string, ts timestamp"
    write(spark, tmp_path / "in", [[row], [row]], schema)
    drain(streams.detections(spark, str(tmp_path / "in")), "append", "once")
    assert spark.table("once").count() == 1


def test_effort_upsert(spark, tmp_path):
    schema = "cell string, day int, km double"
    write(spark, tmp_path / "in", [[("a", None, 1.0)], [("a", None, 2.0), ("b", 1, 5.0)]], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.upsert_effort(stream, str(tmp_path / "out"), str(tmp_path / "log"), ["cell", "day"], ["km"])
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = streams.effort_table(spark, str(tmp_path / "out"))
    assert rows.columns == ["cell", "day", "km"] and sorted((r.cell, r.day, r.km) for r in rows.collect()) == [("a", None, 3.0), ("b", 1, 5.0)]
    # Each deal has the version that a batch wrote and its base at most.
    assert all(len(list(deal.iterdir())) <= 2 for deal in (tmp_path / "out").iterdir() if deal.name.startswith("deal="))


def test_open_trajectories(spark, tmp_path):
    rows = [[("p", date(2024, 1, d), 1.0 + d / 100, 2.0, 5)] for d in (1, 2, 4, 9)]
    schema = "park_id string, acq_date date, lat double, lon double, fires int"
    write(spark, tmp_path / "in", rows, schema)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    drain(streams.open_trajectories(stream, clusters.NEAREST), "append", "open")
    got = [(r.traj_id, r.node) for r in spark.table("open").orderBy(F.col("acq_date")).collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 0)]

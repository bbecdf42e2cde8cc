"""Lines of tracks: one line's numbers at a time in a task, and the same lines as by arrays of points."""

import numpy as np
from pyspark.sql import functions as F

from acacia.functions import projection


def test_lines_as_by_arrays(spark):
    rng = np.random.default_rng(3)
    rows = [(f"f{f}", int(n), float(n) / 512 + float(rng.random()) / 64, 20 + int(n) / 1024) for f, size in enumerate((1, 2, 3, 700)) for n in rng.permutation(size)]
    points = spark.createDataFrame(rows, "file string, pt_no int, lat double, lon double")
    got = {r.file: r for r in projection.lines(points, 0.01).collect()}
    line = F.transform(F.array_sort(F.collect_list(F.struct("pt_no", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    arrays = points.groupBy("file").agg(line.alias("line")).withColumn("less", projection.simplified("line", F.lit(0.01)))
    want = arrays.select("file", F.size("line").alias("points"), projection.line_km("line").alias("km"), F.size("less").alias("points_left"), projection.line_km("less").alias("km_left")).collect()
    assert len(got) == len(want) == 4 and got["f3"].points_left < 700
    for r in want:
        assert (got[r.file].points, got[r.file].points_left) == (r.points, r.points_left) and abs(got[r.file].km - r.km) < 1e-8 and abs(got[r.file].km_left - r.km_left) < 1e-8


def test_no_column_of_whole_lines_meets_python(spark):
    """Batches of whole lines took Python memory by the rows of a batch times their points."""
    import __spark_entry__ as entry
    from tests.conftest import SMALL

    plan = entry.queries()["track_lines"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "ArrowEvalPython" not in plan


def test_lengths_by_stretches():
    p = np.stack([np.linspace(1, 40, 1001), 20 + np.sin(np.arange(1001))], axis=1)
    whole = projection.geodesic_m(p[:-1, 0], p[:-1, 1], p[1:, 0], p[1:, 1]).sum() / 1000
    assert all(abs(projection.length_km(p, rows) - whole) < 1e-5 for rows in (1, 7, 500, 1000, 5000))
    assert projection.length_km(p[:1]) == projection.length_km(p[:0]) == 0

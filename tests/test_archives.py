"""The data source of archives and landed responses: rows, pruned members, odd files."""

import datetime
import zipfile

import pytest

from acacia.sources import archives, fires

HEAD = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight\n"


def line(lat, lon, day, frp="1.5"):
    return f"{lat},{lon},330.1,0.4,0.4,{day},5,N,VIIRS,n,2.0,290.5,{frp},D\n"


@pytest.fixture
def folder(tmp_path, spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("viirs_2022_Chad.csv", HEAD + line(1.0, 2.0, "2022-05-01") + line("", 3.0, "2022-05-02"))
        z.writestr("x/viirs_2023_Chad.csv", HEAD + line(1.5, 2.5, "2023-02-01") + line("north", 3.0, "2023-05-02") + line(1.0, 1.0, "no day"))
        z.writestr("__MACOSX/viirs_2023_Chad.csv", HEAD + line(9, 9, "2023-02-01"))
        z.writestr("x/._viirs_2023_Chad.csv", HEAD + line(9, 9, "2023-02-01"))
        z.writestr("readme.txt", "no table")
        z.writestr("empty_2023.csv", "")
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "0,0,5,5_2023-01-01_10.csv").write_text(HEAD + line(4.0, 4.0, "2023-01-03") + line(4.0, 4.5, "2023-01-10"))
    (tmp_path / "landed" / "0,0,5,5_2023-01-11_10.csv").write_text(HEAD + line(4.1, 4.0, "2023-01-12"))
    (tmp_path / "landed" / "10,0,15,5_2023-01-01_10.csv").write_text("brightness,latitude,extra,longitude,acq_date\n300,2,x,12,2023-1-4\n")
    (tmp_path / "landed" / "unnamed.csv").write_bytes(HEAD.encode() + b"3,3,\xff,1,1,2023-01-05,5\n")
    return str(tmp_path)


def places(df):
    return sorted((r.latitude, r.longitude, str(r.acq_date)) for r in df.collect())


def test_all_rows(spark, folder):
    rows = archives.read(spark, folder)
    assert places(rows) == [
        (0.0, 3.0, "2022-05-02"), (1.0, 2.0, "2022-05-01"), (1.5, 2.5, "2023-02-01"), (2.0, 12.0, "2023-01-04"), (3.0, 3.0, "2023-01-05"),
        (4.0, 4.0, "2023-01-03"), (4.0, 4.5, "2023-01-10"), (4.1, 4.0, "2023-01-12"),
    ]
    assert {r.brightness for r in rows.where("longitude = 12").collect()} == {300.0}
    assert rows.where("acq_time = '0005'").count() == 7


def test_as_the_archive_reader_reads(spark, folder):
    columns = sorted(fires.read_zip(spark, f"{folder}/a.zip").columns)
    both = [sorted(map(repr, df.select(*columns).collect())) for df in (fires.read_zip(spark, f"{folder}/a.zip"), archives.read(spark, f"{folder}/a.zip"))]
    assert both[0] == both[1] and len(both[0]) == 3


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_box_and_days(spark, folder, pushed):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    assert places(archives.read(spark, folder, (0, 5, 0, 5), "2023-01-01", "2023-01-10")) == [(3.0, 3.0, "2023-01-05"), (4.0, 4.0, "2023-01-03"), (4.0, 4.5, "2023-01-10")]
    assert places(archives.read(spark, folder, (50, 60, 0, 5))) == [] and places(archives.read(spark, folder, None, "2030-01-01")) == []


def test_pruned_partitions(spark, folder):
    """Only the members that the filters leave are partitions of the plan."""
    def parts(*args):
        return archives.read(spark, folder, *args).rdd.getNumPartitions()

    assert parts() == 7
    assert parts(None, "2023-02-01") == 3  # the year's two members and the unnamed file
    assert parts((0, 5, 0, 5), "2023-01-01", "2023-01-10") == 4  # one request of three, the year's members, the unnamed file


def test_names():
    day = datetime.date
    assert archives.spans("a/viirs_2023_Chad.csv") == {"day": (day(2023, 1, 1), day(2023, 12, 31))}
    assert archives.spans("-1.5,0,5,5_2023-01-31_2.csv") == {"day": (day(2023, 1, 31), day(2023, 2, 1)), "lat": (0.0, 5.0), "lon": (-1.5, 5.0)}
    assert archives.spans("viirs_2022_2023.csv") == {} == archives.spans("0,0,5,5_2023-13-01_2.csv") == archives.spans("120230.csv")


def test_nothing_there(spark, tmp_path):
    assert archives.read(spark, str(tmp_path)).collect() == []

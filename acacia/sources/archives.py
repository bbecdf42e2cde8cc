"""Detections of ZIP archives and landed responses as a Spark data source, read by member.

``path`` names a file or folder that all executors reach (local, or any address that Arrow's file systems know). Each
CSV member of a ZIP file, and each landed response, is one partition; a ZIP file is opened by seeking, so that
a task reads its directory and its own member and holds a chunk of rows at a time.

A landed response carries its request in its name, ``<west>,<south>,<east>,<north>_<first day>_<days>.csv``. A member
of an archive carries its year, as ``viirs_2023_Chad.csv``. Filters on ``day``, ``lat`` and ``lon`` reach the source (with
``spark.sql.python.filterPushdown.enabled``) and leave out the partitions whose names rule them out. Rows are filtered
by Spark as well, so a pushed filter only saves work. Without that setting all partitions are read, with the same rows.

Defined cases: file-system leftovers (``__MACOSX``, ``._``) and files that are no CSV are skipped; names that carry neither
a request nor one year are always read; members without a header or rows give none; fields that a member lacks are
null and columns that no detection has are left out; an empty folder gives no rows; bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

import csv
import datetime
import io
import math
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from acacia import schemas
from acacia.sources import fires

FORMAT = "detection_archives"
#: Rows of a batch.
ROWS = 10_000
_FIELDS = [f.split()[0] for f in schemas.DETECTION_CSV.split(", ")]
_OLD_NAMES = {"bright_ti4": "brightness", "bright_ti5": "bright_t31"}
_DAY = re.compile(r"\s*([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?![0-9])")
_YEAR = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
_REQUEST = re.compile(rf"(?:^|/)({_NUMBER}),({_NUMBER}),({_NUMBER}),({_NUMBER})_([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})_([0-9]+)\.csv$", re.I)
_COLUMNS = ("day", "lat", "lon")


@dataclass
class Member(InputPartition):
    """A CSV file, or one of an archive."""

    path: str
    member: str | None


def _day(value: str | None) -> datetime.date | None:
    found = _DAY.match(value or "")
    try:
        return datetime.date(*map(int, found.groups())) if found else None
    except ValueError:
        return None


def _coordinate(value: str | None) -> float | None:
    """Missing counts as 0, as in ``fires.detections``."""
    if value is None or not value.strip():
        return 0.0
    try:
        number = float(value)
    except ValueError:
        return None
    return number if math.isfinite(number) else None


def spans(name: str) -> dict[str, tuple]:
    """What a file's name says about its rows: the least and largest day, latitude and longitude."""
    request = _REQUEST.search(name)
    if request:
        first, days = _day(request[5]), int(request[6])
        west, south, east, north = map(float, request.groups()[:4])
        try:
            return {"day": (first, first + datetime.timedelta(days=days - 1)), "lat": (south, north), "lon": (west, east)} if first and days else {}
        except OverflowError:
            return {}
    years = {int(y) for y in _YEAR.findall(name.rsplit("/", 1)[-1])}
    if len(years) == 1:
        year = years.pop()
        return {"day": (datetime.date(year, 1, 1), datetime.date(year, 12, 31))}
    return {}


def may_hold(span: tuple, test: Filter) -> bool:
    """Whether a value between two others can pass a filter."""
    low, high = span
    try:
        if isinstance(test, EqualTo):
            return low <= test.value <= high
        if isinstance(test, In):
            return any(v is not None and low <= v <= high for v in test.value)
        if isinstance(test, GreaterThan):
            return high > test.value
        if isinstance(test, GreaterThanOrEqual):
            return high >= test.value
        if isinstance(test, LessThan):
            return low < test.value
        if isinstance(test, LessThanOrEqual):
            return low <= test.value
    except TypeError:
        pass
    return True


def _csv_name(name: str) -> bool:
    base = name.rsplit("/", 1)[-1]
    return "__MACOSX" not in name and not base.startswith(("._", ".", "_")) and base.lower().endswith(".csv")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.tests: list[Filter] = []  # those that partitions have to pass

    def partitions(self) -> list[Member]:
        files, root = pafs.FileSystem.from_uri(self.path)
        there = files.get_file_info(root)
        found = files.get_file_info(pafs.FileSelector(root, recursive=True)) if there.type == pafs.FileType.Directory else [there]
        out = []
        for info in sorted((f for f in found if f.type == pafs.FileType.File), key=lambda f: f.path):
            if _csv_name(info.path):
                out.append(Member(info.path, None))
            elif info.path.lower().endswith(".zip"):
                with files.open_input_file(info.path) as source, zipfile.ZipFile(source) as archive:
                    out += [Member(info.path, name) for name in archive.namelist() if _csv_name(name)]
        kept = []
        for part in out:
            known = spans(part.member or part.path)
            if all(may_hold(known[t.attribute[0]], t) for t in self.tests if t.attribute[0] in known):
                kept.append(part)
        return kept

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(self.path)
        if not isinstance(partition, Member):  # no partition at all
            return
        with files.open_input_file(partition.path) as source:
            if partition.member is None:
                yield from _batches(source)
            else:
                with zipfile.ZipFile(source) as archive, archive.open(partition.member) as stream:
                    yield from _batches(stream)


class PruningReader(ArchiveReader):
    """Takes filters; Spark allows no such reader where its setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if isinstance(test, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(test.attribute) == 1 and test.attribute[0] in _COLUMNS:
                self.tests.append(test)
            yield test  # rows are for Spark to filter


def _batches(stream) -> Iterator[pa.RecordBatch]:
    text = io.TextIOWrapper(stream, "utf-8", errors="replace", newline="")
    rows = csv.DictReader((line.replace("\0", "") for line in text), restkey="__rest")
    part: list[list[str | None]] = []
    for row in rows:
        low = {k.strip().lower().lstrip("﻿"): v for k, v in row.items() if k and k != "__rest"}
        part.append([low.get(n) or low.get(_OLD_NAMES.get(n, n)) for n in _FIELDS])
        if len(part) == ROWS:
            yield _batch(part)
            part = []
    if part:
        yield _batch(part)


def _batch(rows: list[list[str | None]]) -> pa.RecordBatch:
    columns = dict(zip(_FIELDS, map(list, zip(*rows, strict=True)), strict=True))
    typed = {
        "day": pa.array([_day(v) for v in columns["acq_date"]], pa.date32()),
        "lat": pa.array([_coordinate(v) for v in columns["latitude"]], pa.float64()),
        "lon": pa.array([_coordinate(v) for v in columns["longitude"]], pa.float64()),
    }
    return pa.RecordBatch.from_pydict({**{n: pa.array(v, pa.string()) for n, v in columns.items()}, **typed})


class DetectionArchives(DataSource):
    """Text columns of detections, with their day and position typed for filters."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return schemas.DETECTION_CSV + ", day date, lat double, lon double"

    def reader(self, schema) -> ArchiveReader:
        kind = PruningReader if self.options.get("prune", "false").lower() == "true" else ArchiveReader
        return kind(self.options["path"])


def raw(spark: SparkSession, path: str) -> DataFrame:
    """All text columns, and day, lat and lon."""
    spark.dataSource.register(DetectionArchives)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(FORMAT).option("prune", prune).load(path)


def read(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Typed detections in a box (lat_min, lat_max, lon_min, lon_max) and between two days, edges included."""
    rows = raw(spark, path)
    if box is not None:
        rows = rows.where((F.col("lat") >= box[0]) & (F.col("lat") <= box[1]) & (F.col("lon") >= box[2]) & (F.col("lon") <= box[3]))
    for day, test in ((first, F.col("day").__ge__), (last, F.col("day").__le__)):
        if day is not None:
            rows = rows.where(test(F.lit(datetime.date.fromisoformat(day))))
    return fires.detections(rows.drop(*_COLUMNS))

"""Satellite fire detections from CSV files, ZIP archives and raw lines."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acacia import schemas
from acacia.functions import geo, text


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def detections(raw: DataFrame) -> DataFrame:
    """Typed detections from text columns: blanks are null, both names of the brightness columns work, times have four digits.

    A missing coordinate counts as 0; a row with one that is no number, or without a date, is dropped.
    """
    lower = {c.lower(): c for c in raw.columns}
    rows = raw.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(k) for k, c in lower.items()])

    def either(*names: str) -> Column:
        there = [_number(n) for n in names if n in lower]
        return F.coalesce(*there) if there else F.lit(None).cast("double")

    def plain(name: str) -> Column:
        return F.col(name) if name in lower else F.lit(None).cast("string")

    def coordinate(name: str) -> Column:
        return F.when(F.col(name).isNull(), F.lit(0.0)).otherwise(_number(name))

    out = rows.select(
        coordinate("latitude").alias("latitude"), coordinate("longitude").alias("longitude"), either("bright_ti4", "brightness").alias("brightness"),
        either("scan").alias("scan"), either("track").alias("track"), F.try_to_date(F.col("acq_date")).alias("acq_date"), text.padded_time(plain("acq_time")).alias("acq_time"),
        *[plain(n).alias(n) for n in ("satellite", "instrument", "confidence", "version")], either("bright_ti5", "bright_t31").alias("bright_t31"), either("frp").alias("frp"), plain("daynight").alias("daynight"),
    )
    return out.where("latitude is not null and longitude is not null and acq_date is not null")


def read_csv(spark: SparkSession, paths: str | list[str], box: tuple[float, float, float, float] | None = None, months: tuple[int, ...] | None = None) -> DataFrame:
    """Files with a header, of any column order; lines and files that can't be read are left out."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).csv(paths)
    out = detections(raw)
    if box is not None:
        out = in_box(out, box)
    return out if months is None else out.where(F.month("acq_date").isin(*months))


def in_box(rows: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Edges included; box is lat_min, lat_max, lon_min, lon_max."""
    return rows.where(F.col("latitude").between(box[0], box[1]) & F.col("longitude").between(box[2], box[3]))


def read_lines(lines: DataFrame) -> DataFrame:
    """Raw lines (column value) of fourteen fields or more."""
    names = [f.split()[0] for f in schemas.DETECTION_CSV.split(", ")]
    fields = F.split("value", ",")
    return detections(lines.where(F.size(fields) >= len(names)).select(*[fields[i].alias(n) for i, n in enumerate(names)]))


def read_zip(spark: SparkSession, path: str, year: int | None = None, countries: list[str] | None = None) -> DataFrame:
    """CSV members of ZIP files; members of other years and countries, and file-system leftovers, are skipped. Each task streams its archives' members."""
    names = [f.split()[0] for f in schemas.DETECTION_CSV.split(", ")]

    def wanted(member: str) -> bool:
        base = member.rsplit("/", 1)[-1]
        if "__MACOSX" in member or base.startswith("._") or not base.lower().endswith(".csv"):
            return False
        return (year is None or str(year) in member) and (countries is None or any(c in member for c in countries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in filter(wanted, archive.namelist()):
                        with archive.open(member) as stream:
                            rows = csv.DictReader(io.TextIOWrapper(stream, "utf-8", errors="replace"))
                            part: list[list[str | None]] = []
                            for row in rows:
                                part.append([row.get(n) or row.get({"bright_ti4": "brightness", "bright_ti5": "bright_t31"}.get(n, n)) for n in names])
                                if len(part) == 10_000:
                                    yield pd.DataFrame(part, columns=names)
                                    part = []
                            if part:
                                yield pd.DataFrame(part, columns=names)

    binary = spark.read.format("binaryFile").load(path).select("content")
    return detections(binary.mapInPandas(run, T.StructType([T.StructField(n, T.StringType()) for n in names])))


def with_country(rows: DataFrame, path_column: str = "path") -> DataFrame:
    return rows.withColumn("country", text.country_of_file(path_column))


def keyed(rows: DataFrame) -> DataFrame:
    """Distinct detections by natural key, with their fire cell."""
    return rows.dropDuplicates(schemas.DETECTION_KEY).withColumn("grid_cell_id", geo.fire_cell_id("latitude", "longitude"))


def near_parks(rows: DataFrame, parks: DataFrame, degrees: float = 0.5) -> DataFrame:
    """Distinct detections within some degrees of any park's centre (lat, lon)."""
    from acacia.operators import spatial

    boxes = parks.select("park_id", *[(F.col(c) + s * degrees).alias(f"{c}_{n}") for c in ("lat", "lon") for n, s in (("min", -1), ("max", 1))])
    return spatial.areas_near(rows, boxes).drop("park_id").distinct()


def country_file(root: str, country: str, year: int) -> list[str]:
    """Where a country's file of a year may be, the nested place first."""
    name = f"viirs-jpss1_{year}_{country}.csv"
    return [f"{root}/{year}/{name}", f"{root}/{name}"]


def chunks_of(landing: str, spark: SparkSession) -> DataFrame:
    """Responses of the area service that a fetcher has put into a folder, a CSV for each request."""
    return read_csv(spark, f"{landing}/*.csv")

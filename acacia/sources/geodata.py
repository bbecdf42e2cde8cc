"""Tracks, areas, places, roads, rasters and publications from files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acacia import schemas
from acacia.functions import geo, text

_GPX = (
    "metadata struct<name:string>, trk array<struct<name:string,trkseg:array<struct<trkpt:array<struct<_lat:string,_lon:string,ele:string,time:string,desc:string>>>>>>"
)
#: Uploads above this are refused.
MOST_UPLOAD_BYTES = 100 << 20


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Every track file below a path, as file and text; members of ZIP files included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                if name.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for member in archive.namelist():
                            if member.lower().endswith(".gpx") and "__macosx" not in member.lower():
                                yield pd.DataFrame({"file": [f"{name}!{member}"], "xml": [archive.read(member).decode("utf-8", "replace")]})
                elif name.lower().endswith(".gpx"):
                    yield pd.DataFrame({"file": [name], "xml": [content.decode("utf-8", "replace")]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= MOST_UPLOAD_BYTES)
    return files.select("path", "content").mapInPandas(run, "file string, xml string")


def tracks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Track points of files (file, xml), and the files that are no tracks. Waypoints are ignored; a time that is none is null."""
    parsed = files.select("file", F.from_xml("xml", _GPX, {"rowTag": "gpx", "ignoreNamespace": "true"}).alias("g"))
    bad = parsed.where("g.trk is null").select("file")
    points = (
        parsed.select("file", F.col("g.metadata.name").alias("name"), F.posexplode("g.trk").alias("track_no", "t"))
        .select("file", "name", "track_no", F.posexplode("t.trkseg").alias("seg_no", "s"))
        .select("file", "name", "track_no", "seg_no", F.posexplode("s.trkpt").alias("pt_no", "p"))
        .select(
            "file", "name", "track_no", "seg_no", "pt_no", F.col("p._lat").try_cast("double").alias("lat"), F.col("p._lon").try_cast("double").alias("lon"),
            F.col("p.ele").try_cast("double").alias("ele"), F.try_to_timestamp(F.col("p.time")).alias("ts"), F.coalesce(F.trim("p.desc"), F.lit("")).alias("description"),
        )
    )
    return points, bad


def largest_rings(kind: Column, coordinates: Column) -> Column:
    """Rings of a polygon, or of the part of a multi-polygon whose outer ring has the largest box; coordinates are JSON text."""
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    sized = F.transform(many, lambda p: F.struct(geo.bbox_area(geo.ring_bbox(p[0])).alias("size"), p.alias("rings")))
    best = F.aggregate(sized, sized[0], lambda a, b: F.when(b["size"] > a["size"], b).otherwise(a))
    return F.when(kind == "MultiPolygon", best["rings"]).when(kind == "Polygon", F.from_json(coordinates, "array<array<array<double>>>"))


def all_rings(kind: Column, coordinates: Column) -> Column:
    many = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    return F.when(kind == "MultiPolygon", many).when(kind == "Polygon", F.from_json(coordinates, "array<array<array<double>>>"))


def whole_box(kind: Column, coordinates: Column) -> Column:
    """Box of all corners of all parts."""
    return geo.ring_bbox(F.flatten(all_rings(kind, coordinates)))


def areas(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of areas; those without a geometry become a circle about their coordinates."""
    schema = (
        "id string, name string, country string, country_code string, wdpa_id string, area_km2 double, partner string, buffer_km double, "
        "coordinates struct<lat:double,lon:double>, geometry struct<type:string,coordinates:string>"
    )
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    rings = largest_rings(F.col("geometry.type"), F.col("geometry.coordinates"))
    circle = F.array(geo.circle_ring("coordinates.lat", "coordinates.lon", "area_km2"))
    # The order of the list decides which of two areas a point belongs to.
    numbered = raw.withColumn("ord", F.monotonically_increasing_id())
    return numbered.withColumn("rings", F.coalesce(rings, F.when(F.col("coordinates").isNotNull(), circle))).withColumn("buffer_km", F.coalesce("buffer_km", F.lit(0.0))).drop("geometry")


def with_boundaries(basic: DataFrame, bounded: DataFrame) -> DataFrame:
    """Areas with the rings of their boundary where there is one."""
    return basic.join(bounded.select("id", F.col("rings").alias("__rings")), "id", "left").withColumn("rings", F.coalesce("__rings", "rings")).drop("__rings")


#: Which tag makes which place type; the first that fits counts.
PLACE_TAGS = (
    ("place", "village", "village"), ("place", "town", "town"), ("place", "city", "city"), ("place", "hamlet", "hamlet"), ("waterway", "river", "river"),
    ("waterway", "stream", "stream"), ("natural", "peak", "mountain"), ("natural", "hill", "hill"), ("natural", "water", "lake"),
)
#: Road classes that count as roads.
HIGHWAYS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "track", "path", "service", "road", "living_street")

_ELEMENTS = (
    "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
)


def places(responses: DataFrame) -> DataFrame:
    """Places of map-service responses (park_id, json): named elements with a type and a centre, once each."""
    e = responses.select("park_id", F.explode(F.from_json("json", _ELEMENTS)["elements"]).alias("e"))
    kind = F.coalesce(*[F.when(F.col("e.tags")[key] == value, F.lit(name)) for key, value, name in PLACE_TAGS])
    out = e.select(
        "park_id", kind.alias("place_type"), F.col("e.tags")["name"].alias("name"), F.coalesce("e.lat", "e.center.lat").alias("lat"),
        F.coalesce("e.lon", "e.center.lon").alias("lon"), F.col("e.id").alias("osm_id"), F.to_json("e.tags").alias("osm_tags"),
    )
    return out.where("place_type is not null and name is not null and name <> '' and lat is not null and lon is not null").dropDuplicates(["park_id", "osm_id", "place_type"])


def roads(responses: DataFrame) -> DataFrame:
    """Roads of map-service responses (park_id, json) as arrays of points."""
    e = responses.select("park_id", F.explode(F.from_json("json", _ELEMENTS)["elements"]).alias("e"))
    return e.where((F.col("e.type") == "way") & F.col("e.tags")["highway"].isin(*HIGHWAYS) & (F.size("e.geometry") >= 2)).select("park_id", F.col("e.tags")["highway"].alias("kind"), F.col("e.geometry").alias("points"))


def tile_index(names: DataFrame) -> DataFrame:
    """Row, column, product and resolution from raster file names; names without a tile are left out."""
    n = F.upper(text.last_part("name"))
    return names.select(
        "name", F.regexp_extract(n, r"R(\d+)_C(\d+)", 1).try_cast("int").alias("tile_row"), F.regexp_extract(n, r"R(\d+)_C(\d+)", 2).try_cast("int").alias("tile_col"),
        F.regexp_extract(n, r"GHS_(BUILT_S|POP|BUILT|SMOD)", 1).alias("product"), F.regexp_extract(n, r"_(\d+)_V\d", 1).try_cast("int").alias("resolution"),
    ).where("tile_row is not null")


def pixels(spark: SparkSession, path: str, decode) -> DataFrame:
    """Pixel table of raster files. ``decode(content)`` returns rows of (r, c, value) without nodata; what raster library is there decides the format."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = decode(content)
                yield pd.DataFrame({"park_id": None, "tile": name.rsplit("/", 1)[-1], "r": rows[:, 0], "c": rows[:, 1], "value": rows[:, 2]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schemas.PIXEL)


def works(responses: DataFrame) -> DataFrame:
    """Publications from scholarly-service responses (pa_id, json)."""
    w = responses.select("pa_id", F.explode(F.from_json("json", _WORKS)["results"]).alias("w"))
    return w.select(
        "pa_id", text.last_part("w.id").alias("openalex_id"), "w.title", F.transform("w.authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("w.publication_year").alias("year"),
        "w.doi", text.abstract_text("w.abstract_inverted_index").alias("abstract"), "w.cited_by_count",
    )


_WORKS = (
    "results array<struct<id:string,title:string,publication_year:int,doi:string,cited_by_count:int,"
    "authorships:array<struct<author:struct<display_name:string>>>,abstract_inverted_index:map<string,array<int>>>>"
)


def first_seen(entries: DataFrame) -> DataFrame:
    """Index entries (id, country, page) once each, as they came first."""
    order = Window.partitionBy("id").orderBy("country", "page")
    return entries.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def reported_area(value) -> Column:
    """The number at the start of a reported area."""
    return F.regexp_extract(value, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def legal_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Legislation by country code and by protected area."""
    one = "struct<name:string,legislation:array<struct<name:string,year:int,url:string>>>"
    raw = spark.read.option("multiLine", True).schema(f"countries map<string,{one}>, protected_areas map<string,{one}>").json(path)

    def entries(column: str, key: str) -> DataFrame:
        return raw.select(F.explode(column).alias(key, "v")).select(key, "v.name", "v.legislation")

    return entries("countries", "code"), entries("protected_areas", "id")


def checklist_schema(spark: SparkSession, path: str) -> DataFrame:
    schema = "categories array<struct<id:string,name:string,items:array<struct<id:string,name:string>>>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    c = raw.select(F.explode("categories").alias("c"))
    return c.select(F.col("c.id").alias("category"), F.col("c.name").alias("category_name"), F.explode("c.items").alias("i")).select("category", "category_name", F.col("i.id").alias("item_id"), F.col("i.name").alias("item_name"))


def admin_regions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Countries and regions of an administrative index."""
    raw = spark.read.option("multiLine", True).schema("countries array<struct<code:string,name:string>>, regions array<struct<id:string,name:string,country:string>>").json(path)
    return raw.select(F.inline("countries")), raw.select(F.inline("regions"))

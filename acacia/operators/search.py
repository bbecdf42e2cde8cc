"""Search over areas and documents, work selection, checklists and legal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acacia.functions import text


#: Items that a checklist document may have.
CHECKLIST_ITEMS = 10_000


def matches(rows: DataFrame, columns: list[str], query: str, most: int, order: list[str], kind: str) -> DataFrame:
    """The first rows in some order of which a column contains the query, whatever the case. No query, no rows."""
    condition = F.lit(False)
    for c in columns:
        condition = condition | text.contains_folded(F.coalesce(c, F.lit("")), query)
    found = rows.where(condition & F.lit(bool(query)))
    return found.orderBy(*order).limit(most).withColumn("kind", F.lit(kind))


def areas(query: str, loaded: DataFrame, countries: DataFrame, regions: DataFrame, index: DataFrame) -> DataFrame:
    """Loaded areas, countries, regions and the wide index, each up to its limit; the index without areas that are loaded."""
    rest = index.join(loaded.select(F.col("wdpa_id").alias("__loaded")).where("__loaded is not null"), index["wdpa_id"] == F.col("__loaded"), "left_anti")
    parts = [
        matches(loaded, ["name", "country"], query, 15, ["ord"], "area").select("kind", "id", "name"),
        matches(countries, ["name"], query, 3, ["code"], "country").select("kind", F.col("code").alias("id"), "name"),
        matches(regions, ["name", "country"], query, 3, ["id"], "region").select("kind", "id", "name"),
        matches(rest, ["name"], query, 25, ["wdpa_id"], "index").select("kind", F.col("wdpa_id").alias("id"), "name"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def index_search(query: str, index: DataFrame, loaded: DataFrame, most: int = 30) -> DataFrame:
    """Index entries by name, with whether they are loaded as areas."""
    known = loaded.select(F.col("wdpa_id").alias("wdpa_id"), F.lit(True).alias("loaded")).where("wdpa_id is not null").distinct()
    return matches(index, ["name"], query, most, ["wdpa_id"], "index").join(known, "wdpa_id", "left").fillna(False, ["loaded"])


def by_any_id(areas_: DataFrame, wanted: DataFrame) -> DataFrame:
    """Areas by either of their ids; the first in list order for each wanted id."""
    by_wdpa = wanted.join(areas_, wanted["wanted"] == areas_["wdpa_id"]).select("wanted", "ord", "id", "name")
    by_id = wanted.join(areas_, wanted["wanted"] == areas_["id"]).select("wanted", "ord", "id", "name")
    order = Window.partitionBy("wanted").orderBy("ord")
    return by_wdpa.unionByName(by_id).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def to_sync(areas_: DataFrame, synced: DataFrame, now: str, most: int = 3, days: int = 7) -> DataFrame:
    """Areas that were never synced, else the ones synced longest ago and more than some days."""
    fresh = areas_.join(synced.select(F.col("pa_id").alias("id")), "id", "left_anti").select("id", F.lit(None).cast("timestamp").alias("last_sync"), F.lit(0).alias("turn"))
    stale = synced.where(F.col("last_sync") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")).select(F.col("pa_id").alias("id"), F.col("last_sync").cast("timestamp").alias("last_sync"), F.lit(1).alias("turn"))
    both = fresh.unionByName(stale)
    first = both.agg(F.min("turn").alias("first_turn"))
    return both.join(F.broadcast(first), F.col("turn") == F.col("first_turn")).orderBy(F.col("last_sync"), "id").limit(most).select("id", "last_sync")


def relevant_works(works: DataFrame, parks: DataFrame) -> DataFrame:
    """Works of each park (works have pa_id) whose title or abstract names it."""
    return works.join(parks, works["pa_id"] == parks["id"]).where(text.about_park("title", "abstract", "name")).select(works["*"])


def publications(works: DataFrame, most: int = 50) -> DataFrame:
    order = Window.partitionBy("pa_id").orderBy(F.desc_nulls_last("year"), F.desc("cited_by_count"), "openalex_id")
    return works.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def page(rows: DataFrame, order: list, size: int, number: int = 0) -> DataFrame:
    """A page of rows in an order; pages count from 0."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def publication_counts(works: DataFrame) -> DataFrame:
    return works.groupBy("pa_id").agg(F.count(F.lit(1)).alias("publications"))


def documents(rows: DataFrame) -> DataFrame:
    """Place of each document in its park: by category, newest year and upload first."""
    order = Window.partitionBy("pa_id").orderBy("category", F.desc_nulls_last("year"), F.desc_nulls_last("uploaded_at"), "id")
    return rows.withColumn("place", F.row_number().over(order))


def first_of_title(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("pa_id", "title").orderBy("id")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def checklist(schema: DataFrame, status: DataFrame) -> DataFrame:
    """Every item of the schema (category, item_id) for every park with a status, pending where there is none.

    The schema is one document (``CHECKLIST_ITEMS`` bounds it) and becomes a literal that each park's row is opened by, so that nothing is joined for it.
    """
    items = schema.select("item_id").distinct().limit(CHECKLIST_ITEMS + 1).collect()
    if len(items) > CHECKLIST_ITEMS:
        raise ValueError(f"a checklist of more than {CHECKLIST_ITEMS} items")
    ids = F.array(*[F.lit(i["item_id"]) for i in items]) if items else F.array().cast("array<string>")
    rows = status.select("pa_id").distinct().select("pa_id", F.explode(ids).alias("item_id"))
    return rows.join(status.select("pa_id", "item_id", "status"), ["pa_id", "item_id"], "left").fillna("pending", ["status"])


def checklist_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("pa_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "in_progress").alias("in_progress"), F.count_if(F.col("status") == "pending").alias("pending")
    )


def legal_of_area(pa_ids: DataFrame, pa_texts: DataFrame, country_texts: DataFrame) -> DataFrame:
    """An area's own legal texts, else those of the country its id begins with."""
    country = F.split("id", "_")[0]
    own = pa_ids.join(pa_texts, "id", "left")
    joined = own.withColumn("country", country).join(country_texts.select(F.col("code").alias("country"), F.col("legislation").alias("of_country")), "country", "left")
    return joined.select("id", "country", F.coalesce("legislation", "of_country").alias("legislation"), F.col("legislation").isNotNull().alias("own"))


def legal_of_country(code: str, pa_texts: DataFrame) -> DataFrame:
    return pa_texts.where(F.col("id").startswith(f"{code}_"))


def readiness(tables: dict[str, tuple[DataFrame, str]], park_id: str) -> DataFrame:
    """Rows and newest time of each table for a park, and whether it is ready."""
    out = None
    for name, (rows, column) in tables.items():
        one = rows.where(F.col("park_id") == park_id).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(column).cast("string")).alias("latest")).select(F.lit(name).alias("dataset"), "n", "latest")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("status", F.when(F.col("n") > 0, "ready").otherwise("pending"))


def grams(value) -> Column:
    """The distinct runs of one, two and three letters of a text, folded as ``matches`` folds it."""
    low = F.lower(F.coalesce(value, F.lit("")))

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(low) - (n - 1))
        return F.when(F.length(low) >= n, F.transform(starts, lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


class NameIndex:
    """An inverted index of rows by the runs of letters in some of their columns, so that a search reads no other rows.

    Each run's rows lie in one of ``parts`` folders, sorted by run, and the runs' counts beside them. A search reads the counts of its own
    runs, takes the rarest run's rows, and leaves it to ``matches`` to verify them: the same rows as a search over all. Rows are stored once for each
    distinct run, for short texts such as names. A run that most rows have is spread over ``writers`` files.

    Defined cases: null columns count as empty; an empty query finds nothing; one or two letters have runs of their own; repeated rows are all
    found; rows without a letter are found by no query, as without an index; columns named ``gram`` or ``part`` aren't allowed.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _part(self, gram) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.parts)).cast("int")

    def build(self, rows: DataFrame, columns: list[str], writers: int = 16) -> NameIndex:
        if clash := {"gram", "part"} & set(rows.columns):
            raise ValueError(f"columns of the index: {sorted(clash)}")
        found = F.array_distinct(F.flatten(F.array(*map(grams, columns))))
        postings = rows.withColumn("gram", F.explode(found)).withColumn("part", self._part("gram"))
        dealt = postings.repartition("part", F.pmod(F.xxhash64(*columns), F.lit(writers))).sortWithinPartitions("part", "gram")
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings")
        self._keep_schema("postings", postings)
        counts = self._read("postings").groupBy("part", "gram").agg(F.count(F.lit(1)).alias("rows"))
        self._keep_schema("counts", counts)
        counts.repartition("part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/counts")
        return self

    def _keep_schema(self, table: str, rows: DataFrame) -> None:
        """An empty file beside a table says what its columns are, even where the table has no rows."""
        self.spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{table}-schema")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/{table}-schema").schema).parquet(f"{self.path}/{table}")

    def _of(self, table: str, wanted: list[str]) -> DataFrame:
        """Rows of some runs; parts and runs are literals, so that the scan is pruned by both."""
        parts = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*[self._part(F.lit(g)) for g in wanted]))).distinct().collect()]
        return self._read(table).where(F.col("part").isin(parts) & F.col("gram").isin(wanted))

    def candidates(self, query: str) -> DataFrame:
        """All rows that can contain a query: those of its rarest run."""
        runs = self.spark.range(1).select(grams(F.lit(query))).first()[0]  # as many as the query has letters, thrice at most
        longest = max(map(len, runs), default=0)
        runs = [g for g in runs if len(g) == longest]
        if not runs:
            return self._read("postings").drop("gram", "part").limit(0)
        counts = {r["gram"]: r["rows"] for r in self._of("counts", runs).collect()}  # a row for each run of the query
        rarest = min(runs, key=lambda g: (counts.get(g, 0), g))
        return self._of("postings", [rarest]).drop("gram", "part")

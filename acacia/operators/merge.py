"""Writes that combine a batch with a target, as functions of two DataFrames.

Keys are compared null-safely: a null in a key is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    place = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(place)).where("__place = 1").drop("__place")


def _matching(left: DataFrame, right: DataFrame, key: list[str]) -> tuple[DataFrame, Column]:
    """Right's keys renamed, and the null-safe condition."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    condition = F.lit(True)
    for k in key:
        condition = condition & left[k].eqNullSafe(renamed[f"__{k}"])
    return renamed, condition


def without(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left rows whose key is not in right."""
    renamed, condition = _matching(left, right, key)
    return left.join(renamed, condition, "left_anti")


def insert_new(target: DataFrame, batch: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Keys that exist are left alone; of a batch's equal keys the first counts."""
    fresh = _one(batch, key, order) if order else batch.dropDuplicates(key)
    return target.unionByName(without(fresh, target, key))


def replace(target: DataFrame, batch: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The batch's row counts; of equal keys the first in ``order``."""
    return without(target, batch, key).unionByName(_one(batch, key, order))


def add_up(target: DataFrame, batch: DataFrame, key: list[str], sums: list[str], highest: list[str] = ()) -> DataFrame:
    """Numbers of equal keys are added, or the highest kept."""
    both = target.select(*key, *sums, *highest).unionByName(batch.select(*key, *sums, *highest))
    return both.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in highest])


def add_up_nulls_apart(target: DataFrame, batch: DataFrame, key: list[str], nullable: str, sums: list[str]) -> DataFrame:
    """Like ``add_up``, but rows whose ``nullable`` key is null never match and stay apart, as a unique index treats them."""
    both = target.select(*key, *sums).unionByName(batch.select(*key, *sums))
    return add_up(both.where(F.col(nullable).isNotNull()), both.limit(0), key, sums).unionByName(both.where(F.col(nullable).isNull()).select(*key, *sums))


def replace_partition(target: DataFrame, batch: DataFrame, by: str) -> DataFrame:
    """All rows of the batch's parks give way to the batch."""
    return without(target, batch, [by]).unionByName(batch)


def update(target: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Columns of matching rows take the new values, null ones excepted; columns the target lacks are added."""
    renamed = changes.select(*[F.col(k).alias(f"__{k}") for k in key], *[F.col(c).alias(f"__{c}") for c in columns])
    condition = F.lit(True)
    for k in key:
        condition = condition & target[k].eqNullSafe(renamed[f"__{k}"])
    joined = target.join(renamed, condition, "left")
    old = {c: F.col(c) if c in target.columns else F.lit(None) for c in columns}
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), old[c]) for c in columns}).drop(*[f"__{c}" for c in (*key, *columns)])


def resumed(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a ledger does not have as completed."""
    return without(wanted, done.where("status = 'completed'"), key)


def sync_window(state: DataFrame, today: str, default_start: str) -> DataFrame:
    """From the day after the last one synced, else a fixed day, to today; parks that are up to date are left out."""
    start = F.coalesce(F.date_add("last_date", 1), F.lit(default_start).cast("date"))
    return state.withColumn("start_date", start).withColumn("end_date", F.lit(today).cast("date")).where("start_date <= end_date")


def date_chunks(windows: DataFrame, days: int = 10) -> DataFrame:
    """Windows cut into requests of at most some days."""
    start = F.explode(F.sequence("start_date", "end_date", F.expr(f"INTERVAL {days} DAYS")))
    return windows.withColumn("chunk_start", start).withColumn("chunk_end", F.least(F.date_add("chunk_start", days - 1), "end_date"))


def add_tiles(target: DataFrame, taken: DataFrame, batch: DataFrame, key: str, sums: list[str], firsts: list[str] = (), tile: str = "tile") -> tuple[DataFrame, DataFrame]:
    """Sums by ``key`` grow by the batch's tiles that weren't taken yet; the second result is the ledger with these tiles in it.

    A tile that comes again, in the batch or in a later one, counts once, so that a batch can be run again after a failure.
    ``firsts`` are values of the first tile in the order of names and stay; ``tiles_available`` counts tiles. ``target`` has
    key, sums, firsts and tiles_available, ``taken`` has key and tile. Of a tile's several rows the one with the least values counts.
    """
    fresh = without(_one(batch, [key, tile], [F.asc(c) for c in (*sums, *firsts)]), taken, [key, tile])
    added = fresh.groupBy(key).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.min_by(F.struct(c), F.struct(tile))[c].alias(c) for c in firsts], F.count(F.lit(1)).alias("tiles_available")
    )
    both = target.select(key, *sums, *firsts, "tiles_available", F.lit(0).alias("__turn")).unionByName(added.withColumn("__turn", F.lit(1)))
    grown = both.groupBy(key).agg(*[F.sum(c).alias(c) for c in (*sums, "tiles_available")], *[F.min_by(F.struct(c), "__turn")[c].alias(c) for c in firsts])
    return grown.select(key, *sums, *firsts, "tiles_available"), taken.select(key, tile).unionByName(fresh.select(key, tile))

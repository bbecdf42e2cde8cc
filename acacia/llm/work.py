"""Written intermediate tables and small helpers that the operators share.

Lineage is cut with Parquet tables in the shared folder that the session names in
``spark.checkpoint.dir``, so that a lost executor costs a re-read and no recomputation.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from acacia.operators.work import discard, shared_folder, written

__all__ = ["discard", "free_name", "partitions", "shared_folder", "written"]


def partitions(spark: SparkSession) -> int:
    """How many parts a keyed exchange of packed rows is dealt into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name that no given column has, whatever its case."""
    lower = {name.lower() for name in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted

"""Written intermediate tables in the shared folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. A session that runs in one process, as tests do, may leave it out and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.conf.get("spark.app.id")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="spark-")
        folder = _local[app]
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where this session's intermediate tables lie."""
    return f"{shared_folder(spark)}/acacia-{spark.conf.get('spark.app.id')}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once and returns the table read back; a lost executor then costs a re-read and no recomputation."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Deletes this session's intermediate tables. Results that are not written yet still read them."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session on one machine may lack one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame, *by: str) -> DataFrame:
    """df with its lineage cut: written in the shared folder, in folders by the columns by if any, and read again."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.stored_at = path
    return read


def spread(df: DataFrame, made: Column, most: int = 1_000_000) -> DataFrame:
    """df stored and dealt out anew, so that tasks whose rows become made rows each make about most, however few bytes the rows are."""
    kept = checkpointed(df)
    total = int(kept.agg(F.sum(made)).first()[0] or 0)
    return kept.repartition(max(-(-total // most), df.sparkSession.sparkContext.defaultParallelism))


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discarded(*tables: DataFrame) -> None:
    """Delete tables made by checkpointed() that nothing reads any more."""
    for df in tables:
        deleted(df.sparkSession, df.stored_at)


@contextlib.contextmanager
def few_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this, jobs send Python so many rows at a time at most; for rows that may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(key)
    spark.conf.set(key, str(rows) if int(given) <= 0 else str(min(rows, int(given))))
    try:
        yield
    finally:
        spark.conf.set(key, given)

"""Pieces shared by the corpus operators: word patterns, reading tables, storing intermediate tables."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the words between white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only a session on one machine may go without that setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Folders of the tables that stored() has made in the settled() that is at work, of each thread its own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written as a table in the shared folder, in folders by the columns by if there are any, and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    made = _made.get()
    if made is not None:
        made.append(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.stored_at = path
    return read


def _deleted(spark: SparkSession, paths: Iterable[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by stored()."""
    _deleted(df.sparkSession, [df.stored_at])


def swept(spark: SparkSession) -> None:
    """Let the driver collect what it holds of finished jobs, so that Spark deletes their shuffle files now and not at some later time."""
    spark._jvm.System.gc()


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives as a stored table; all tables stored on the way to it are deleted."""
    own: list[str] = []
    token = _made.set(own)
    try:
        made = stored(make(), name)
    finally:
        _made.reset(token)
    _deleted(made.sparkSession, own[:-1])
    return made


def modest_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """From now on whole texts go to Python in batches of so many rows at most, so that neither side holds thousands of long ones at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def rows_under(df: DataFrame, bound: int) -> bool:
    """Whether df has at most bound rows; reads no more than that."""
    return df.limit(bound + 1).count() <= bound


def others(df: DataFrame, made: Iterable[str]) -> list[str]:
    """Names of df's columns but for those named like the ones to be made, in whatever case of letters."""
    names = {c.lower() for c in made}
    return [c for c in df.columns if c.lower() not in names]


def fresh_columns(df: DataFrame, made: Iterable[str]) -> DataFrame:
    """df without its columns named like those to be made, in whatever case of letters."""
    return df.select(*(F.col(f"`{c}`") for c in others(df, made)))


def names_apart(f: Callable) -> Callable:
    """f(docs, ...) with columns of docs whose names begin with an underscore renamed while it works.

    Names of that kind are the operators' own; a user's column of such a name comes back as it was.
    """

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        given = {c.lower() for c in docs.columns}
        aside = {}
        for c in docs.columns:
            if c.startswith("_"):
                name = f"own{c}"
                while name.lower() in given:
                    name = f"own_{name}"
                given.add(name.lower())
                aside[c] = name
        made = f(docs.withColumnsRenamed(aside), *args, **kwargs)
        return made.withColumnsRenamed({v: k for k, v in aside.items()})

    return run

"""Resumed ingest: a manifest by content digest, batches that count once all of their rows are there, a table of what failed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timex
from ..operators.tables import there
from .artifacts import NOISE

MANIFEST = "path string, sha256 string, length long, modified long, batch string, rows long, error string"


class Store:
    """Folders of a store: rows by batch, failed by batch, and the manifest, whose lines make a batch count.

    A batch is written in three appends, and the manifest's is the last. If a run breaks off before it, the rows of that batch are
    never read, its files are still new to the next run, and that run writes them under another batch. Nothing is changed in place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def manifest(self) -> DataFrame:
        """(path, sha256, length, modified, batch, rows, error) of all files that were taken in."""
        read = self.spark.read.schema(MANIFEST)
        return read.parquet(self._at("manifest")) if there(self.spark, self._at("manifest")) else self.spark.createDataFrame([], MANIFEST)

    def _finished(self, name: str) -> DataFrame:
        done = self.manifest().select("batch").distinct()
        return self.spark.read.option("mergeSchema", "true").parquet(self._at(name)).join(F.broadcast(done), "batch", "left_semi")  # a batch a line

    def rows(self) -> DataFrame:
        return self._finished("rows")

    def failed(self) -> DataFrame:
        """(sha256, path, error) of the files that could not be read; their rows are in no other table."""
        return self._finished("failed")


def listed(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, sha256, length, modified, content) of the files under a folder, noise apart."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).filter(~F.rlike("path", F.lit(NOISE)))
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length", timex.micros(F.col("modificationTime")).alias("modified"), "content")


def new_files(store: Store, files: DataFrame) -> DataFrame:
    """One file of each content that the manifest doesn't have: the resume anti-join. Of equal files the first path is taken."""
    first = files.groupBy("sha256").agg(F.min("path").alias("path"))
    return files.join(first, ["sha256", "path"], "left_semi").join(store.manifest().select("sha256"), "sha256", "left_anti")


def ingest(
    store: Store, folder: str, decode: Callable[[DataFrame], DataFrame], glob: str = "*", batches: int = 8, after_batch: Callable[[int], None] | None = None
) -> int:
    """Take in the files of a folder that the store doesn't have, by content; the number of those taken.

    decode makes rows from files (path, sha256, content): any columns with sha256, and error where a file could not be read, which
    then is one row without others. Files are dealt into batches by their digest, so that a run that breaks off loses the batch under way
    and no more; after_batch is called as each is done. Running again takes in what is left, and nothing twice. A file that gives no
    row is in the manifest too, so it isn't tried again.
    """
    spark, taken = store.spark, 0
    fresh = new_files(store, listed(spark, folder, glob))
    of = F.pmod(F.xxhash64("sha256"), F.lit(batches))
    todo = sorted(r["k"] for r in fresh.select(of.alias("k")).distinct().collect())  # numbers of batches
    for k in todo:
        batch = uuid.uuid4().hex
        own = new_files(store, listed(spark, folder, glob)).filter(of == k)
        rows = decode(own.select("path", "sha256", "content"))
        rows = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
        marked = rows.withColumn("batch", F.lit(batch))
        whole = f"{store._at('rows')}"
        marked.write.mode("append").parquet(f"{store._at('staged')}/{batch}")  # decoded once
        staged = spark.read.parquet(f"{store._at('staged')}/{batch}")
        staged.filter("error is null").drop("error").write.mode("append").parquet(whole)
        paths = own.select("sha256", "path")
        bad = staged.filter("error is not null").select("sha256", "error", "batch").join(paths, "sha256")
        bad.select("sha256", "path", "error", "batch").write.mode("append").parquet(store._at("failed"))
        counts = staged.groupBy(F.col("sha256").alias("_sha")).agg(F.count(F.when(F.col("error").isNull(), 1)).alias("rows"), F.max("error").alias("error"))
        met = own.drop("content").join(counts, F.col("sha256") == F.col("_sha"), "left")
        lines = met.select("path", "sha256", "length", "modified", F.lit(batch).alias("batch"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "error")
        lines.coalesce(1).write.mode("append").parquet(store._at("manifest"))
        taken += store.manifest().filter(F.col("batch") == batch).count()
        if after_batch is not None:
            after_batch(k)
    return taken


def decode_message_xml(files: DataFrame) -> DataFrame:
    """Messages of backup files of <sms …/> elements: (sha256, address, date, type, body), with error for files that are no such XML."""
    body = F.col("content").cast("string")
    whole = files.select("sha256", body.alias("xml"), F.regexp_extract_all(body, F.lit(r"(<sms\s[^>]*>)")).alias("found"))
    good = F.rlike("xml", F.lit(r"(?s)<smses\b.*</smses>"))
    attribute = lambda n: F.nullif(F.regexp_extract("one", rf'\s{n}="([^"]*)"', 1), F.lit(""))
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    each = whole.withColumn("one", F.explode_outer(F.when(good, F.col("found")))).withColumn("error", F.when(~good, F.lit("no backup of messages")))
    rows = each.select("sha256", attribute("address").alias("address"), attribute("date").cast("long").alias("date"), attribute("type").cast("int").alias("type"), plain(attribute("body")).alias("body"), "one", "error")
    return rows.filter("one is not null or error is not null").drop("one")

"""Facets, statistics and gap-based windows over dated artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import timex
from .order import in_order, previous, running

MINUTE_US, HOUR_US = 60_000_000, 3_600_000_000


def facets(df: DataFrame, columns: Sequence[str] = ("category", "app", "direction", "recovery")) -> DataFrame:
    """(dimension, label, n) of several columns in one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(none)")).alias("label")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("dimension", "label").agg(F.count(F.lit(1)).alias("n"))


def hourly(df: DataFrame, offset_minutes: int = 0) -> DataFrame:
    """All 24 hours with their counts, empty ones too."""
    spark = df.sparkSession
    counted = df.groupBy(F.hour(timex.shifted(F.col("timestamp"), offset_minutes)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    spine = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return spine.join(counted.filter("hour is not null"), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def by_weekday(df: DataFrame, monday_first: bool = False) -> DataFrame:
    """Counts with Sunday as 0, or Monday if it comes first."""
    at = timex.at(F.col("timestamp"))
    day = (F.weekday(at) if monday_first else F.dayofweek(at) - 1).alias("weekday")
    return df.groupBy(day).agg(F.count(F.lit(1)).alias("n"))


def by_day(df: DataFrame) -> DataFrame:
    return df.groupBy(timex.day_of(F.col("timestamp")).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("recovery") != "allocated", 1)).alias("deleted")
    )


def heat(df: DataFrame) -> DataFrame:
    t = timex.at(F.col("timestamp"))
    return df.groupBy((F.dayofweek(t) - 1).alias("weekday"), F.hour(t).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def day_by_category(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    return df.groupBy(timex.day_of(F.col("timestamp")).alias("day")).pivot("category", list(categories)).agg(F.count(F.lit(1))).na.fill(0)


def buckets(df: DataFrame, resolution: str) -> DataFrame:
    """(bucket, category, n); resolution is minute, hour, day or week, the last by ISO."""
    t = timex.at(F.col("timestamp"))
    if resolution == "week":
        monday = F.date_trunc("week", t)
        thursday = F.dateadd(monday, 3)
        label = F.concat(F.year(thursday), F.lit("-W"), F.lpad(F.weekofyear(t), 2, "0"))
    else:
        form = {"minute": "yyyy-MM-dd HH:mm", "hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd"}[resolution]
        label = F.date_format(t, form)
    return df.groupBy(label.alias("bucket"), "category").agg(F.count(F.lit(1)).alias("n"))


def overview(df: DataFrame) -> DataFrame:
    """One row of totals, bounds, deleted, located and night counts."""
    night = F.hour(timex.at(F.col("timestamp"))) < 6
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count("timestamp").alias("dated"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.count(F.when(F.col("recovery") != "allocated", 1)).alias("deleted"),
        F.count(F.when(F.col("latitude").isNotNull(), 1)).alias("located"), F.count(F.when(night, 1)).alias("night"),
    )


def call_seconds(df: DataFrame) -> DataFrame:
    """(app, direction) with calls, those answered, seconds, their mean and the longest."""
    s = F.floor((F.col("timestamp_end") - F.col("timestamp")) / 1_000_000)
    spoken = F.when(s > 0, s)
    return df.filter("category = 'Calls'").groupBy("app", "direction").agg(
        F.count(F.lit(1)).alias("calls"), F.count(spoken).alias("answered"), F.coalesce(F.sum(spoken), F.lit(0)).alias("seconds"), F.round(F.avg(spoken), 1).alias("mean"), F.max(spoken).alias("longest")
    )


def duration_bands(calls: DataFrame) -> DataFrame:
    s = (F.col("timestamp_end") - F.col("timestamp")) / 1_000_000
    band = F.when(s < 10, "under 10 s").when(s < 60, "under 1 min").when(s < 300, "under 5 min").otherwise("longer")
    return calls.filter("timestamp_end is not null").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def sessions(df: DataFrame, keys: Sequence[str], gap_us: int, tie: str = "artifact_id") -> DataFrame:
    """df with session, counted up where more than gap_us lies between rows of a key. Keys of any size are dealt out in ranges of time."""
    order = ("timestamp", tie)
    t = previous(in_order(df.filter("timestamp is not null"), keys, order), keys, order, {"_before": F.col("timestamp")})
    new = F.when(F.col("timestamp") - F.col("_before") > gap_us, 1).otherwise(0)
    return running(t, keys, order, new, "session").drop("_before", "_part")


def bursts(df: DataFrame, keys: Sequence[str] = ("party",), gap_us: int = 45 * MINUTE_US, least: int = 3) -> DataFrame:
    """Runs of at least that many rows with no gap over 45 minutes; a gap of just that keeps a run."""
    found = sessions(df.select(*keys, "timestamp", "artifact_id"), keys, gap_us).groupBy(*keys, "session")
    made = found.agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("start"), F.max("timestamp").alias("stop"))
    return made.filter(F.col("n") >= least).drop("session")


def gaps(df: DataFrame, keys: Sequence[str] = ("party",), least_us: int = 8 * HOUR_US, tie: str = "artifact_id") -> DataFrame:
    """Silences of at least 8 hours with what stands before and after."""
    order = ("timestamp", tie)
    own = df.filter("timestamp is not null").select(*dict.fromkeys((*keys, *order, "subtype")))
    t = previous(in_order(own, keys, order), keys, order, {"start": F.col("timestamp"), "before": F.col("subtype")})
    made = t.select(*keys, "start", F.col("timestamp").alias("stop"), "before", F.col("subtype").alias("after"))
    return made.withColumn("gap_us", F.col("stop") - F.col("start")).filter(F.col("gap_us") >= least_us)


def anomalies(df: DataFrame, now_us: int, order: str = "artifact_id") -> DataFrame:
    """Instants after tomorrow or before 2007, and per app the share of steps back of over an hour in stored order."""
    own = df.select(*dict.fromkeys(("app", order, "timestamp")))
    t = previous(in_order(own, ("app",), (order,)), ("app",), (order,), {"_before": F.col("timestamp")})
    made = t.withColumn("_back", F.col("_before") - F.col("timestamp") > HOUR_US).groupBy("app").agg(
        F.count("timestamp").alias("n"),
        F.count(F.when(F.col("timestamp") > now_us + timex.DAY_US, 1)).alias("future"),
        F.count(F.when(F.col("timestamp") < 1_167_609_600_000_000, 1)).alias("early"),
        F.count(F.when(F.col("_back"), 1)).alias("back"),
    )
    return made.withColumn("disordered", (F.col("n") >= 10) & (F.col("back") > F.col("n") * 0.05))


def reactivated(df: DataFrame, keys: Sequence[str] = ("party",), least: int = 8, gap_us: int = 21 * timex.DAY_US, later: int = 4) -> DataFrame:
    """Parties silent for 21 days or more in a longest gap, and active again at least four times."""
    w = W.partitionBy(*keys).orderBy("timestamp", "artifact_id")
    made = df.filter("timestamp is not null").withColumn("gap_us", F.col("timestamp") - F.lag("timestamp").over(w))
    made = made.withColumn("rest", F.count(F.lit(1)).over(W.partitionBy(*keys)) - F.row_number().over(w) + 1)
    best = F.max(F.struct("gap_us", "timestamp", "rest"))
    out = made.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), best.alias("b"))
    out = out.select(*keys, "n", F.col("b.gap_us").alias("gap_us"), F.col("b.timestamp").alias("resumed"), F.col("b.rest").alias("after"))
    return out.filter((F.col("n") >= least) & (F.col("gap_us") >= gap_us) & (F.col("after") >= later))

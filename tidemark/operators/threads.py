"""Conversations: turns in order, replies, silences, and relationships across apps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

THREAD = ("party", "app", "exhibit")
#: Fixed value: apps that carry voice only and don't count as channels of messages.
VOICE_CATEGORIES = ("Calls",)


def turns(df: DataFrame, keys: Sequence[str] = THREAD, tie: str = "artifact_id") -> DataFrame:
    """Rows with pos, their place from 0 in the thread; undated rows come last."""
    w = W.partitionBy(*keys).orderBy(F.col("timestamp").asc_nulls_last(), tie)
    return df.withColumn("pos", F.row_number().over(w) - 1)


def replies(df: DataFrame, keys: Sequence[str] = THREAD, tie: str = "artifact_id") -> DataFrame:
    """Dated turns with reply_us, the time to the next turn the other way.

    Each thread is read once from its end, with the latest time each way carried along.
    """
    w = W.partitionBy(*keys).orderBy(F.col("timestamp").desc(), F.col(tie).desc()).rowsBetween(W.unboundedPreceding, -1)
    nxt = lambda d: F.last(F.when(F.col("direction") == d, F.col("timestamp")), ignorenulls=True).over(w)
    other = F.when(F.col("direction") == "incoming", nxt("outgoing")).when(F.col("direction") == "outgoing", nxt("incoming"))
    return df.filter("timestamp is not null").withColumn("reply_us", other - F.col("timestamp"))


def metrics(df: DataFrame, keys: Sequence[str] = THREAD, least_silence_us: int = 6 * 3_600_000_000) -> DataFrame:
    """One row per thread: counts each way, reciprocity, deletions, span, replies, longest silence, who began."""
    w = W.partitionBy(*keys).orderBy(F.col("timestamp").asc_nulls_last(), "artifact_id")
    made = replies(df, keys).withColumn("silence_us", F.col("timestamp") - F.lag("timestamp").over(w))
    made = made.withColumn("pos", F.row_number().over(w) - 1)
    count = lambda c: F.count(F.when(c, 1))
    gone = F.col("recovery") != "allocated"
    out = made.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("turns"),
        count(F.col("direction") == "incoming").alias("n_in"),
        count(F.col("direction") == "outgoing").alias("n_out"),
        count(gone).alias("n_deleted"),
        F.min(F.when(gone & (F.col("pos") > 0), F.col("pos"))).alias("_gone_at"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.percentile("reply_us", F.lit(0.5)).alias("median_reply_us"), F.min("reply_us").alias("fastest_reply_us"),
        F.max(F.when(F.col("silence_us") >= least_silence_us, F.struct("silence_us", "timestamp"))).alias("s"),
        F.min_by("direction", F.struct("timestamp", "artifact_id")).alias("begun"),
    )
    least, most = F.least("n_in", "n_out"), F.greatest("n_in", "n_out")
    interior = F.coalesce(F.col("_gone_at") < F.col("turns") - 1, F.lit(False))  # the first that is gone after the first turn isn't the last
    return out.select(
        *keys, "turns", "n_in", "n_out", "n_deleted", interior.alias("embedded_deletion"), "first", "last", "median_reply_us",
        "fastest_reply_us", F.col("s.silence_us").alias("silence_us"), F.col("s.timestamp").alias("silence_ended"), "begun",
        F.when(most > 0, least / most).otherwise(0.0).alias("reciprocity"),
    )


def relationships(df: DataFrame) -> DataFrame:
    """Per party over all apps: channels that carry messages, exhibits, counts and bounds."""
    spoken = F.col("category").isin(*VOICE_CATEGORIES)
    return df.groupBy("party").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(~spoken, F.col("app"))).alias("channels"),
        F.count_distinct("exhibit").alias("exhibits"), F.count(F.when(spoken, 1)).alias("calls"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
    )


def transcript(df: DataFrame, keys: Sequence[str] = THREAD) -> DataFrame:
    """Threads with their turns in order, for export of chosen threads."""
    turn = F.struct("timestamp", "artifact_id", "direction", "body")
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def chat_shapes(turns_of: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: per conversation the turns of each role, characters and longest turn."""
    return turns_of.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count(F.when(F.col("role") == "user", 1)).alias("n_in"),
        F.count(F.when(F.col("role") == "assistant", 1)).alias("n_out"),
        F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"),
        F.min_by("role", "turn").alias("begun"),
    )

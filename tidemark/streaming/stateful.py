"""Streams that keep state: telemetry joined to acts by interval, bursts with a gap that counts in, checks of chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state of these operators is kept by key in a store that spills to disk; the session must name it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fused(acts: DataFrame, log: DataFrame, minutes: int = 15) -> DataFrame:
    """Pairs (artifact_id, usage_id, away_us) of acts and usage of the same exhibit within the minutes, both streams with a watermark on at.

    An interval join: each side is kept as long as a row of the other that fits it may still come, and no longer.
    """
    a = acts.select("artifact_id", F.col("exhibit").alias("exhibit_act"), F.col("at").alias("at_act"))
    b = log.select(F.col("artifact_id").alias("usage_id"), F.col("exhibit").alias("exhibit_log"), F.col("at").alias("at_log"))
    near = F.expr(f"at_log >= at_act - INTERVAL {minutes} MINUTES AND at_log <= at_act + INTERVAL {minutes} MINUTES")
    met = a.join(b, (F.col("exhibit_act") == F.col("exhibit_log")) & near)
    return met.select("artifact_id", "usage_id", F.abs(F.unix_micros("at_act") - F.unix_micros("at_log")).alias("away_us"))


class Bursts(StatefulProcessor):
    """Runs of a party's rows with no gap over gap_ms, a gap of just that keeping a run; rows may come in any order within the watermark.

    State: the open runs as (start, stop, n), which rows join, widen or bring together; a timer a run gives it out once no row can join any more.
    """

    def __init__(self, gap_ms: int, least: int):
        self.gap_ms, self.least = gap_ms, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "start long, stop long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        old = {stop for _, stop, _ in runs}
        for f in rows:
            runs += [(t, t, 1) for t in (f["at"].astype("int64") // {"ns": 10**6, "us": 10**3, "ms": 1}[f["at"].dt.unit]).tolist()]
        merged: list[tuple[int, int, int]] = []
        for start, stop, n in sorted(runs):
            if merged and start - merged[-1][1] <= self.gap_ms:
                a, b, m = merged[-1]
                merged[-1] = (a, max(b, stop), m + n)
            else:
                merged.append((start, stop, n))
        self.runs.put(merged)
        for _, stop, _ in merged:
            if stop not in old:
                self.handle.registerTimer(stop + self.gap_ms + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        runs = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        over = [r for r in runs if r[1] + self.gap_ms + 1 <= now]
        left = [r for r in runs if r[1] + self.gap_ms + 1 > now]
        self.runs.put(left) if left else self.runs.clear()
        made = [(key[0], n, start * 1000, stop * 1000) for start, stop, n in over if n >= self.least]
        if made:
            yield pd.DataFrame(made, columns=["party", "n", "start", "stop"])

    def close(self) -> None:
        pass


def bursts(df: DataFrame, gap_minutes: int = 45, least: int = 3) -> DataFrame:
    """(party, n, start, stop) as timeline.bursts() gives for the whole table, from a stream (party, at) with a watermark; times to the millisecond."""
    given = df.select("party", "at").filter("party is not null and at is not null")
    return given.groupBy("party").transformWithStateInPandas(
        statefulProcessor=Bursts(gap_minutes * 60_000, least), outputStructType="party string, n long, start long, stop long", outputMode="Append", timeMode="EventTime"
    )


class Chain(StatefulProcessor):
    """Entries of logs, each of which names the digest of the one before it. State: the last number and digest of a log."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, own string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, own = self.last.get() if self.last.exists() else (None, None)
        broken = []
        entries = [r for f in rows for r in zip(f["seq"].tolist(), f["previous"].tolist(), f["own"].tolist(), f["content"].tolist(), strict=True)]
        for at, previous, digest, content in sorted(entries):
            if hashlib.sha256(f"{previous}|{content}".encode()).hexdigest() != digest:
                broken.append((key[0], at, "own digest"))
            elif seq is not None and at != seq + 1:
                broken.append((key[0], at, "gap"))
            elif seq is not None and own != previous:
                broken.append((key[0], at, "previous digest"))
            seq, own = at, digest
        if seq is not None:
            self.last.update((seq, own))
        if broken:
            yield pd.DataFrame(broken, columns=["log", "seq", "broken"])

    def close(self) -> None:
        pass


def chain_checks(df: DataFrame) -> DataFrame:
    """(log, seq, broken) of the entries (log, seq, previous, own, content) that break their log's chain, as digests.verify_chain() finds them.

    Entries of one micro-batch may come in any order; those of later ones follow. The state of a log is one number and one digest.
    """
    return df.groupBy("log").transformWithStateInPandas(statefulProcessor=Chain(), outputStructType="log string, seq long, broken string", outputMode="Append", timeMode="None")

"""Fusion: acts on a device held against its telemetry. Unknown is not a negative."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import asof, nearest

WIDE_US, NARROW_US = 15 * 60_000_000, 2 * 60_000_000


def acts(df: DataFrame) -> DataFrame:
    """What a person did: outgoing messages and calls."""
    return df.filter(F.col("category").isin("Messages", "Calls") & (F.col("direction") == "outgoing") & F.col("timestamp").isNotNull())


def telemetry(df: DataFrame) -> DataFrame:
    return df.filter((F.col("category") == "User activity log") & F.col("timestamp").isNotNull())


#: Parts of subtype, stream and event that tell a kind of telemetry, the first kind that fits.
MARKERS = (
    ("lock", ("islocked", "lock state", "keyguard")),
    ("screen", ("screen on", "isbacklit", "display")),
    ("usage", ("foreground", "app usage", "knowledgec", "powerlog", "usage event", "app runtime")),
)


def classified(df: DataFrame) -> DataFrame:
    """df with kind (lock, screen, usage or blank) and in_use: whether someone was at the device, null where that is open.

    A background service is no person; a locked or dark screen is none either; an unlocked one is.
    """
    attribute = lambda name: F.coalesce(F.get_json_object("attributes", f"$.{name}"), F.lit(""))
    event, value = F.lower(attribute("event")), F.trim(attribute("value"))
    blob = F.concat_ws(" ", F.lower("subtype"), F.lower(attribute("stream")), event)
    kind = F.lit("")
    for name, parts in reversed(MARKERS):
        kind = F.when(F.rlike(blob, F.lit("|".join(parts))), name).otherwise(kind)
    off, on = value.isin("0", "false", "False"), value.isin("1", "true", "True")
    used = (
        F.when(kind == "usage", F.when(~F.rlike(event, F.lit("background|service|stopped")), True))
        .when(kind == "screen", ~off)
        .when(kind == "lock", F.when(on, False).when(off, True))
    )
    return df.withColumns({"kind": kind, "in_use": used})


def usage(act: DataFrame, log: DataFrame, most: int = 6, pool: bool = False) -> DataFrame:
    """For each act the nearest usage records within 15 minutes, same app and within two minutes first.

    Records of the same exhibit only, unless pooled. No pairs are listed: what comes before a record in its class (by app) is nearer in that class, or,
    for other apps, nearer among all, so the most of an act are among the most nearest of its app, of any app and of none.
    """
    a = act.select("artifact_id", "exhibit", "app", F.col("timestamp").alias("at"))
    b = log.select(F.col("artifact_id").alias("usage_id"), "exhibit", "app", F.col("timestamp").alias("at"))
    known = F.col("app").isNotNull()
    among = {"own": (["app"], known), "any": ([], known), "none": ([], ~known)}
    value = F.struct("usage_id", F.col("app").alias("usage_app"))
    met = nearest(a, b, [] if pool else ["exhibit"], "at", value, WIDE_US, most, among)

    def judged(x):
        away, same = F.abs(F.col("at") - x["time"]), F.col("app") == x["value"]["usage_app"]
        return F.struct(
            (away > NARROW_US).alias("wide"), F.when(same, 0).when(~same, 1).otherwise(2).alias("class"), away.alias("away_us"), x["value"]["usage_id"].alias("usage_id"),
            (away <= NARROW_US).alias("close"), same.alias("same_app"),
        )

    others = F.filter("any", lambda x: F.coalesce(x["value"]["usage_app"] != F.col("app"), F.lit(True)))  # of its own app there are enough in own
    every = F.transform(F.concat("own", others, "none"), judged)
    ranked = met.select("artifact_id", F.posexplode(F.slice(F.sort_array(every), 1, most)).alias("_pos", "_r"))
    return ranked.select("artifact_id", "_r.usage_id", "_r.away_us", "_r.close", "_r.same_app", (F.col("_pos") + 1).alias("rank"))


def nearest_places(act: DataFrame, places: DataFrame) -> DataFrame:
    """Acts with the place before and after them within 15 minutes, of the same exhibit."""
    p = places.filter("latitude is not null and timestamp is not null")
    value = F.col("artifact_id")
    before = asof(act.select("artifact_id", "exhibit", "timestamp"), p, ["exhibit"], "timestamp", value, WIDE_US).withColumnRenamed("near", "before")
    return asof(before, p, ["exhibit"], "timestamp", value, WIDE_US, backward=False).withColumnRenamed("near", "after")


def verdicts(act: DataFrame, found: DataFrame, log: DataFrame) -> DataFrame:
    """attributed: close and same app; probable: close or same app; unattributed: the exhibit logs that day but not then; else unknown."""
    day = F.floor(F.col("timestamp") / 86_400_000_000)
    logged = log.select(F.col("exhibit"), day.alias("day")).distinct().withColumn("logged", F.lit(True))
    best = found.groupBy("artifact_id").agg(
        F.max(F.col("close") & F.col("same_app")).alias("both"), F.max(F.col("close") | F.col("same_app")).alias("either")
    )
    made = act.withColumn("day", day).join(best, "artifact_id", "left").join(logged, ["exhibit", "day"], "left")
    verdict = F.when(F.col("both"), "attributed").when(F.col("either"), "probable").when(F.col("logged"), "unattributed").otherwise("unknown")
    return made.select("artifact_id", "exhibit", "app", "timestamp", verdict.alias("verdict"))


def summary(judged: DataFrame) -> DataFrame:
    return judged.groupBy("exhibit", "verdict").agg(F.count(F.lit(1)).alias("n"))


def fusion_findings(judged: DataFrame, log: DataFrame, recovered: DataFrame) -> DataFrame:
    """(rule_id, subject, n, severity, score, caveat) per exhibit that has telemetry; recovered has the artifact_id of what was deleted."""
    gone = recovered.select("artifact_id").distinct().withColumn("_gone", F.lit(1))
    count = lambda c: F.count(F.when(c, 1))
    v = F.col("verdict")
    each = judged.join(gone, "artifact_id", "left").groupBy("exhibit").agg(
        count(v == "attributed").alias("sure"), count((v == "attributed") & F.col("_gone").isNotNull()).alias("sure_gone"),
        count(v == "unattributed").alias("idle"), count(v != "unknown").alias("covered"), F.count(F.lit(1)).alias("n"),
    )
    each = each.join(log.select("exhibit").distinct(), "exhibit", "left_semi")
    say = lambda rule, n, severity, score, caveat: F.struct(
        F.lit(rule).alias("rule_id"), F.col("exhibit").alias("subject"), n.cast("long").alias("n"), severity.alias("severity"), score.alias("score"), F.lit(caveat).alias("caveat")
    )
    high = F.col("sure_gone") > 0
    told = F.array(
        F.when(F.col("sure") > 0, say("fusion.attributed_activity", F.col("sure"), F.when(high, "high").otherwise("medium"), F.when(high, 3.8).otherwise(2.8), "Telemetry shows that someone was there, not who.")),
        F.when(F.col("idle") > 0, say("fusion.unattributed_activity", F.col("idle"), F.lit("medium"), F.lit(2.65), "What comes in does so with nobody there.")),
        F.when(F.col("covered") / F.col("n") < 0.15, say("fusion.low_coverage", F.col("covered"), F.lit("info"), F.lit(0.95), "Unknown says nothing either way.")),
    )
    return each.select(F.inline(F.array_compact(told)))

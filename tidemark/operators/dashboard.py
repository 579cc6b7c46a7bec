"""Figures of a case at a glance: matrices, coverage, readiness, temporal signs, summaries and next steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import timex
from .joins import beside

COMMS = ("Calls", "Messages", "Chats")


def _pct(part: Column, whole: Column) -> Column:
    return F.round(100 * part / F.greatest(whole, F.lit(1)), 1)


def app_by_category(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif("app", F.lit("")), F.lit("(none)")).alias("app"), "category").agg(F.count(F.lit(1)).alias("n"))


def sources(df: DataFrame) -> DataFrame:
    """Per source what was read from it: rows, tables, categories, exhibits."""
    return df.groupBy("source_path").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source_table").alias("tables"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count_distinct("exhibit").alias("exhibits"),
    )


def tag_counts(tags: DataFrame) -> DataFrame:
    """Artifacts of each tag, a tag set twice on one counting once."""
    return tags.select("artifact_id", "name").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame) -> DataFrame:
    """One row: share of artifacts with an instant, a place, a payload, deleted; categories, apps, sources, traffic a day."""
    span = (F.max("timestamp") - F.min("timestamp")) / timex.DAY_US
    count = lambda c: F.count(F.when(c, 1))
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"), F.count("timestamp").alias("timestamped"), _pct(F.count("timestamp"), total).alias("timestamped_pct"),
        _pct(count(F.col("latitude").isNotNull()), total).alias("geolocated_pct"), _pct(count(F.col("recovery") != "allocated"), total).alias("deleted_pct"),
        _pct(count(F.col("blob_sha256") != ""), total).alias("blob_pct"), F.count_distinct("category").alias("categories"),
        F.count_distinct(F.nullif("app", F.lit(""))).alias("apps"), F.count_distinct("source_path").alias("sources"),
        F.round(count(F.col("category").isin(*COMMS)) / F.greatest(F.coalesce(span, F.lit(1.0)), F.lit(1.0)), 1).alias("comms_per_day"),
    )


def health(covered: DataFrame, intact: bool = True, alerts: int = 0, encrypted: int = 0) -> DataFrame:
    """coverage() with its readiness: 35 for integrity, 25 for instants, 20 for six categories, 10 for fifty rows, less penalties."""
    total, some = F.col("total"), F.col("total") > 0
    instants = F.when(some, F.bround(25 * F.least(F.lit(1.0), F.col("timestamped") / total))).otherwise(0)
    richness = F.when(some, F.bround(20 * F.least(F.lit(1.0), F.col("categories") / 6))).otherwise(0)
    volume = F.when(total >= 50, 10).otherwise(F.bround(10 * total / 50))
    penalty = min(15, 4 * alerts + 2 * encrypted)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(35 * intact - penalty) + instants + richness + volume)).cast("int")
    made = covered.withColumn("score", score)
    label = F.when(F.col("score") >= 85, "excellent").when(F.col("score") >= 70, "good").when(F.col("score") >= 50, "fair").otherwise("limited")
    return made.withColumn("label", label)


def _days(df: DataFrame) -> DataFrame:
    return df.filter("timestamp is not null").groupBy(timex.day_of(F.col("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def busy_days(df: DataFrame) -> DataFrame:
    """Days with twice the upper median of a day's rows, and 12 at least, with the ratio to it. There is a row a day."""
    days = _days(df)
    # the middle of the days in order of their counts, the later one of two
    place = F.row_number().over(W.orderBy("n", "day"))
    median = days.withColumn("_place", place).join(F.broadcast(days.agg(F.floor(F.count(F.lit(1)) / 2).alias("_half"))), F.expr("_place = _half + 1")).select(F.col("n").alias("median"))
    out = beside(days, median).filter(F.col("n") >= F.greatest(F.lit(12), 2 * F.col("median")))
    return out.select("day", "n", F.round(F.col("n") / F.greatest("median", F.lit(1)), 1).alias("ratio"))


def longest_gap(df: DataFrame, over_days: int = 2) -> DataFrame:
    """The longest stretch between two days with rows, the first of equal ones, if over so many days."""
    w = W.orderBy("day")
    made = _days(df).select(F.lag("day").over(w).alias("from_day"), F.col("day").alias("to_day"))
    made = made.withColumn("days", F.datediff(F.col("to_day").cast("date"), F.col("from_day").cast("date")))
    best = made.agg(F.max_by(F.struct("from_day", "to_day", "days"), F.struct("days", -F.unix_date(F.col("to_day").cast("date")))).alias("b"))
    return best.select("b.*").filter(F.col("days") > over_days)


def signs(df: DataFrame) -> DataFrame:
    """One row: active days, rows an active day, busiest day, night share, peak hour; earlier wins a tie."""
    dated = df.filter("timestamp is not null").select(timex.day_of(F.col("timestamp")).alias("day"), F.hour(timex.at(F.col("timestamp"))).alias("hour"))
    by = dated.groupBy("day", "hour").agg(F.count(F.lit(1)).alias("n"))
    first = lambda key: F.max_by(key, F.struct("n", "_order"))
    days = by.groupBy("day").agg(F.sum("n").alias("n")).withColumn("_order", -F.unix_date(F.col("day").cast("date")))
    hours = by.groupBy("hour").agg(F.sum("n").alias("n")).withColumn("_order", -F.col("hour"))
    one = days.agg(F.count(F.lit(1)).alias("active_days"), F.round(F.sum("n") / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("rows_a_day"), first("day").alias("busiest_day"), F.max("n").alias("busiest_n"))
    two = hours.agg(first("hour").alias("peak_hour"), F.round(100 * F.sum(F.when(F.col("hour") < 6, F.col("n")).otherwise(0)) / F.sum("n"), 1).alias("night_pct"))
    return beside(one, two)


def normalised(counted: DataFrame, n: str = "n") -> DataFrame:
    """counted with pct of its peak. Counts by hour, weekday or day: few rows."""
    peak = counted.agg(F.greatest(F.max(n), F.lit(1)).alias("_peak"))
    return beside(counted, peak).withColumn("pct", F.round(100 * F.col(n) / F.col("_peak"), 1)).drop("_peak")


#: The tiles that show their first labels only, and how many; the others show all of theirs.
MOST_SHOWN = {"subtypes": 24, "media": 12, "domains": 14, "ssids": 12, "accounts": 12, "message_apps": 12, "web_subtypes": 8, "places": 80}


def tiles(df: DataFrame, offset_minutes: int = 0) -> DataFrame:
    """(tile, label, n, sample): every tile of the analysis dashboard from one pass over the artifacts, labels by number and then by name.

    subtypes, media, media_located, domains, ssids, accounts, message_apps, call_directions, call_durations, web_subtypes, weekday_hour (Sunday 0),
    day_category, places (thousandths of a degree, with the first artifact as sample) and with_payload. Each row is counted under the
    tiles that it belongs to, partly before anything is shuffled. Blank labels aren't shown, and of MOST_SHOWN's tiles only
    the first labels are; ranks are cut in each task before a tile's labels meet.
    """
    kind = lambda *names: F.col("category").isin(*names)
    named = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    attribute = lambda n: F.nullif(F.get_json_object("attributes", f"$.{n}"), F.lit(""))
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    t = timex.shifted(F.col("timestamp"), offset_minutes)
    s = (F.col("timestamp_end") - F.col("timestamp")) / 1_000_000
    band = F.when(s < 10, "<10s").when(s < 60, "10-60s").when(s < 300, "1-5m").when(s < 900, "5-15m").otherwise(">15m")
    shown = {
        "subtypes": F.concat_ws(" · ", "category", named("subtype", "(none)")),
        "media": F.when(kind("Files & Media"), named("subtype", "File")),
        "media_located": F.when(kind("Files & Media"), F.when(located, "located").otherwise("not located")),
        "domains": F.when(kind("Web"), attribute("domain")),
        "ssids": F.when(kind("Networks"), F.coalesce(attribute("ssid"), F.nullif("body", F.lit("")))),
        "accounts": F.when(kind("Accounts"), F.coalesce(attribute("account_name"), named("app", "account"))),
        "message_apps": F.when(kind("Messages", "Chats"), named("app", "(unknown app)")),
        "call_directions": F.when(kind("Calls"), F.col("direction")),
        "call_durations": F.when(kind("Calls"), F.when(F.coalesce(s, F.lit(0.0)) <= 0, "unknown").otherwise(band)),
        "web_subtypes": F.when(kind("Web"), named("subtype", "Visit")),
        "weekday_hour": F.concat_ws(" ", F.dayofweek(t) - 1, F.hour(t)),
        "day_category": F.concat_ws(" ", F.date_format(t, "yyyy-MM-dd"), "category"),
        "places": F.when(located, F.concat_ws(",", *(F.format_string("%.3f", F.floor(F.col(c) * 1000 + 0.5) / 1000) for c in ("latitude", "longitude")))),
        "with_payload": F.when(F.col("blob_sha256") != "", "payload"),
    }
    dated = ("weekday_hour", "day_category")
    pairs = F.array(*(F.struct(F.lit(k).alias("tile"), (F.when(F.col("timestamp").isNotNull(), c) if k in dated else c).alias("label")) for k, c in shown.items()))
    each = df.select("artifact_id", F.inline(pairs)).filter("trim(label) <> ''")
    counted = each.groupBy("tile", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("tile") == "places", F.col("artifact_id"))).alias("sample"))
    some = counted.filter(F.col("tile").isin(*MOST_SHOWN))
    rank = F.row_number().over(W.partitionBy("tile").orderBy(F.col("n").desc(), "label"))
    most = F.create_map(*(F.lit(x) for kv in MOST_SHOWN.items() for x in kv))[F.col("tile")]
    first = some.withColumn("_rank", rank).filter(F.col("_rank") <= max(MOST_SHOWN.values())).filter(F.col("_rank") <= most).drop("_rank")
    return first.unionByName(counted.filter(~F.col("tile").isin(*MOST_SHOWN)))


def triage(summary: DataFrame, files: DataFrame) -> DataFrame:
    """(exhibit, level, alert, n): what an examiner is told first, from case_summary() and stores (exhibit, path, notes) that may be encrypted.

    Encrypted stores are known by their names and notes. An exhibit of no artifacts has no summary and shows by its stores alone.
    """
    marks = "sqlcipher|encrypted|crypt12|crypt14|crypt15|not decoded|key required"
    closed = files.filter(F.rlike(F.lower(F.concat_ws(" ", "path", "notes")), F.lit(marks))).groupBy("exhibit").agg(F.count(F.lit(1)).alias("closed"))
    met = summary.select("exhibit", "n", "deleted", "gap").join(closed, "exhibit", "full")
    say = lambda level, alert, n: F.struct(F.lit(level).alias("level"), F.lit(alert).alias("alert"), n.cast("long").alias("n"))
    told = F.array(
        F.when(F.col("deleted") > 0, say("high", "recovered deleted records", F.col("deleted"))),
        F.when(F.col("closed") > 0, say("warn", "encrypted stores", F.col("closed"))),
        F.when(F.coalesce("n", F.lit(0)) == 0, say("warn", "nothing decoded", F.lit(0))),
        F.when(F.col("gap") != "", say("warn", "communications gap", F.lit(1))),
    )
    return met.select("exhibit", F.inline(F.array_compact(told)))


#: What next_steps() reads of a case; what a table of facts lacks is taken as nothing.
FACTS = {
    "gap": "", "vivo": False, "messages": 0, "contacts": 0, "calls": 0, "method": "", "coverage_pct": 0.0, "folders_missing": 0, "backups_tried": 0,
    "backups_opened": 0, "encrypted": 0, "vaults": 0, "owners": 0, "findings": 0, "critical": 0, "high": 0,
}


def next_steps(facts: DataFrame, case: str, most: int = 10) -> DataFrame:
    """(case, rank, step, severity): what to do next on each case, in the order of the rules; facts has a row a case, with any of FACTS."""
    have = {c: F.coalesce(F.col(c), F.lit(v)) if c in facts.columns else F.lit(v) for c, v in FACTS.items()}
    f = lambda c: have[c]
    say = lambda when, step, severity: F.when(when, F.struct(F.lit(step).alias("step"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity")))
    none_found = f("findings") == 0
    steps = F.array_compact(
        F.array(
            say(f("gap") != "", "close the gap in communications", "high"),
            say(f("vivo") & (f("messages") > 0) & (f("contacts") == 0) & (f("calls") == 0), "review fallback sources", "medium"),
            say((F.lower(f("method")) == "mtp") & (f("messages") == 0), "acquire again with debugging", "high"),
            say((f("coverage_pct") > 0) & (f("coverage_pct") < 35), "low decode coverage", "medium"),
            say(f("folders_missing") > 0, "copy is incomplete", "high"),
            say((f("backups_tried") > 0) & (f("backups_opened") == 0), "backup needs its key", "high"),
            say(f("backups_opened") > 0, "decode opened backups", "medium"),
            say((f("encrypted") > 0) | (f("vaults") > 0), "review signs of hiding", F.when(f("encrypted") > 0, "high").otherwise("medium")),
            say(none_found & (f("owners") > 0), "run the rules with the owner's identity", "medium"),
            say(none_found & (f("owners") == 0), "run the rules", "low"),
            say((f("critical") > 0) | (f("high") > 0), "review grave findings", F.when(f("critical") > 0, "critical").otherwise("high")),
            say(f("encrypted") > 0, "content of encrypted stores is missing", "critical"),
        )
    )
    return facts.select(case, F.posexplode(F.slice(steps, 1, most)).alias("_k", "_s")).select(case, (F.col("_k") + 1).alias("rank"), "_s.step", "_s.severity")


def slices(df: DataFrame) -> DataFrame:
    """(slice, label, n): the tiles of the dashboard in one pass, each row of df counted once in each."""
    tiles = {
        "category": F.col("category"), "app": F.col("app"), "direction": F.col("direction"), "recovery": F.col("recovery"), "subtype": F.col("subtype"),
        "exhibit": F.col("exhibit"), "month": F.date_format(timex.at(F.col("timestamp")), "yyyy-MM"),
        "confidence": F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low"),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("slice"), F.coalesce(F.nullif(c, F.lit("")), F.lit("(none)")).alias("label")) for k, c in tiles.items()))
    return df.select(F.inline(pairs)).groupBy("slice", "label").agg(F.count(F.lit(1)).alias("n"))


def case_summary(df: DataFrame) -> DataFrame:
    """Per exhibit: rows, bounds, traffic by kind, deleted, parties, and whether calls or contacts are missing where messages are not."""
    count = lambda c: F.count(F.when(c, 1))
    kind = lambda *names: F.col("category").isin(*names)
    out = df.groupBy("exhibit").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), count(kind("Calls")).alias("calls"),
        count(kind("Messages", "Chats")).alias("messages"), count(kind("Contacts")).alias("contacts"), count(F.col("recovery") != "allocated").alias("deleted"),
        F.count_distinct(F.when(kind(*COMMS), F.nullif("party", F.lit("")))).alias("parties"),
    )
    gap = F.when((F.col("messages") > 0) & (F.col("calls") == 0), "no calls").when((F.col("messages") > 0) & (F.col("contacts") == 0), "no contacts").otherwise("")
    return out.withColumn("gap", gap)


def owner_suggestions(df: DataFrame, most: int = 3) -> DataFrame:
    """Per exhibit the parties that send most, who may be its holder: ties by party."""
    sent = df.filter((F.col("direction") == "outgoing") & F.col("category").isin(*COMMS) & (F.col("party") != ""))
    counted = sent.groupBy("exhibit", "party").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("exhibit").orderBy(F.col("n").desc(), "party"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= most)


def recommendations(summary: DataFrame, covered: DataFrame, findings: DataFrame) -> DataFrame:
    """(rank, step, severity): next steps that the figures call for, gravest first; ten at most.

    summary, covered and findings as case_summary(), coverage() and findings() give them.
    """
    kind = F.when(F.col("gap") == "no calls", "comms_gap_calls").otherwise("comms_gap_contacts")
    gaps = summary.filter("gap <> ''").select(kind.alias("step"), F.lit("high").alias("severity")).distinct()
    low = covered.filter("timestamped_pct < 35").select(F.lit("low_decode").alias("step"), F.lit("medium").alias("severity"))
    grave = findings.agg(F.count(F.when(F.col("severity") == "high", 1)).alias("high"), F.count(F.lit(1)).alias("n"))
    review = grave.filter("high > 0").select(F.lit("review_findings").alias("step"), F.lit("medium").alias("severity"))
    run = grave.filter("n = 0").select(F.lit("run_intel").alias("step"), F.lit("low").alias("severity"))
    every = gaps.unionByName(low).unionByName(review).unionByName(run)
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return every.withColumn("rank", F.row_number().over(W.orderBy(order, "step"))).filter("rank <= 10")

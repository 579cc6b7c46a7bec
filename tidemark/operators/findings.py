"""Rules that turn aggregates into ranked findings, each with a caveat."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, timex
from . import correlate, entities, fusion, graph, joins, places, threads, timeline

SEVERITY = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
RULES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def rule(name: str, severity: str, confidence: float, caveat: str) -> Callable:
    """Register a rule: a function of artifacts giving (subject, n), and severity if it varies. The finding adds score and caveat."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def run(df: DataFrame) -> DataFrame:
            found = f(df)
            level = F.col("severity") if "severity" in found.columns else F.lit(severity)
            rank = F.lit(SEVERITY["info"])
            for k, v in SEVERITY.items():
                rank = F.when(level == k, v).otherwise(rank)
            return found.select(
                F.lit(name).alias("rule_id"), F.col("subject").cast("string").alias("subject"), F.col("n").cast("long").alias("n"),
                level.alias("severity"), (rank + F.lit(confidence)).alias("score"), F.lit(caveat).alias("caveat"),
            )

        RULES[name] = run
        return f

    return register


def traffic(df: DataFrame) -> DataFrame:
    return df.filter(F.col("category").isin("Calls", "Messages", "Chats"))


def _deleted() -> Column:
    return F.col("recovery") != "allocated"


@rule("deleted.volume", "medium", 0.8, "Deletion can be routine; the share says nothing of intent.")
def deleted_volume(df: DataFrame) -> DataFrame:
    out = traffic(df).filter(_deleted()).groupBy(F.col("exhibit").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("severity", F.when(F.col("n") > 20, "high").otherwise("medium"))


@rule("deleted.entire_thread", "high", 0.85, "Live rows may be missing from the acquisition.")
def entire_thread(df: DataFrame) -> DataFrame:
    out = traffic(df).groupBy(F.col("party").alias("subject"), "exhibit", "app").agg(
        F.count(F.when(_deleted(), 1)).alias("n"), F.count(F.when(~_deleted(), 1)).alias("live")
    )
    return out.filter("n >= 3 and live = 0")


@rule("pattern.burner", "medium", 0.6, "Short use of a number has innocent explanations.")
def burner(df: DataFrame) -> DataFrame:
    """Parties that no contact of the exhibit has, in heavy use for a short time."""
    saved = df.filter(F.col("category") == "Contacts").select("party", "exhibit").distinct()
    out = traffic(df).join(saved, ["party", "exhibit"], "left_anti").groupBy(F.col("party").alias("subject"), "exhibit").agg(
        F.count("timestamp").alias("n"), ((F.max("timestamp") - F.min("timestamp")) / timex.DAY_US).alias("days")
    )
    return out.filter((F.col("n") >= 4) & (F.col("days") <= 14) & (F.col("n") / F.greatest("days", F.lit(0.5)) >= 2))


@rule("pattern.nocturnal", "low", 0.5, "Hours are UTC; the holder's zone may differ.")
def nocturnal(df: DataFrame) -> DataFrame:
    hour = F.hour(timex.at(F.col("timestamp")))
    out = traffic(df).filter("timestamp is not null").groupBy(F.col("exhibit").alias("subject")).agg(
        F.count(F.when(hour.between(1, 5), 1)).alias("n"), F.count(F.lit(1)).alias("total")
    )
    return out.filter("total >= 30 and n >= 12 and n / total >= 0.22")


@rule("location.cluster", "low", 0.55, "A cell is about a kilometre wide.")
def location_cluster(df: DataFrame) -> DataFrame:
    """Per exhibit of ten points or more the five cells after the fullest, which may be home, that hold four points on two days."""
    good = df.filter(geo.plausible(F.col("latitude"), F.col("longitude")) & F.col("timestamp").isNotNull())
    cell = F.concat(geo.cell(F.col("latitude")), F.lit(","), geo.cell(F.col("longitude")))
    out = good.groupBy("exhibit", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(timex.day_of(F.col("timestamp"))).alias("days"))
    w = W.partitionBy("exhibit")
    out = out.withColumns({"rank": F.row_number().over(w.orderBy(F.col("n").desc(), "cell")), "points": F.sum("n").over(w)})
    return out.filter("points >= 10 and rank between 2 and 6 and n >= 4 and days >= 2").select(F.concat_ws("/", "exhibit", "cell").alias("subject"), "n")


@rule("graph.one_way", "low", 0.5, "Replies may have gone by another channel.")
def one_way(df: DataFrame) -> DataFrame:
    return graph.one_way(graph.owner_edges(df)).select(F.concat("exhibit", F.lit("/"), "party").alias("subject"), F.col("weight").alias("n"))


@rule("pattern.dormant_reactivation", "low", 0.55, "A gap may be one of acquisition.")
def dormant(df: DataFrame) -> DataFrame:
    return timeline.reactivated(traffic(df)).select(F.col("party").alias("subject"), F.col("after").alias("n"))


@rule("activity.device_in_use", "info", 0.6, "Use of a device doesn't show by whom.")
def device_in_use(df: DataFrame) -> DataFrame:
    out = df.filter(F.col("category") == "User activity log").groupBy(F.col("exhibit").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    return out.filter("n >= 10")


@rule("correlate.shared_parties", "medium", 0.7, "Service numbers are shared by many.")
def shared_parties(df: DataFrame) -> DataFrame:
    return correlate.shared(traffic(df), "party").select(F.col("party").alias("subject"), "n")


@rule("correlate.asymmetric_deletion", "high", 0.7, "Retention differs between devices.")
def asymmetric(df: DataFrame) -> DataFrame:
    return correlate.asymmetric_deletion(traffic(df)).select(F.col("party").alias("subject"), F.col("deleted").alias("n"))


#: Phrases that speak of hiding or destroying traces.
HIDING = (
    "wipe", "factory reset", "erase everything", "delete this", "burn the", "clear your", "don't put this in writing", "not on this phone", "use signal",
    "switch to", "new number", "burner", "airplane mode", "faraday", "encrypt", "vpn", "incognito", "delete the app", "remove the sim", "destroy the",
)


@rule("pattern.counter_forensic", "high", 0.55, "Words have no context; read every hit.")
def counter_forensic(df: DataFrame) -> DataFrame:
    """Messages by the first of the phrases that they hold."""
    first = F.lit(None).cast("string")
    for p in reversed(HIDING):
        first = F.when(F.contains(F.lower("body"), F.lit(p)), p).otherwise(first)
    return traffic(df).select(first.alias("subject")).filter("subject is not null").groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


def _flagged(df: DataFrame, attribute: str) -> DataFrame:
    flag = F.lower(F.coalesce(F.get_json_object("attributes", f"$.{attribute}"), F.lit("")))
    return df.filter(~flag.isin("", "0", "false", "null")).groupBy(F.col("app").alias("subject")).agg(F.count(F.lit(1)).alias("n"))


@rule("antiforensics.extension_mismatch", "medium", 0.7, "Some apps name files by use and not by kind.")
def extension_mismatch(df: DataFrame) -> DataFrame:
    return _flagged(df.filter(F.col("category") == "Files & Media"), "extension_mismatch")


@rule("crosssource.notification_leak", "high", 0.85, "A preview may be cut.")
def notification_leak(df: DataFrame) -> DataFrame:
    return _flagged(df, "previews_encrypted_app")


@rule("antiforensics.encrypted_artifacts", "medium", 0.8, "Encryption is common and no sign of intent.")
def encrypted_artifacts(df: DataFrame) -> DataFrame:
    return _flagged(df, "encrypted")


@rule("integrity.timestamps", "info", 0.9, "Clocks are set wrong by accident too.")
def wrong_times(df: DataFrame) -> DataFrame:
    """Per app the instants before 2007 or after the latest one that lies in the plausible range, and steps back out of order."""
    early = F.col("timestamp") < 1_167_609_600_000_000
    late = F.col("timestamp") > timex.LAST * 1_000_000
    out = df.groupBy(F.col("app").alias("subject")).agg(F.count(F.when(early | late, 1)).alias("n"))
    return out.filter("n > 0")


@rule("vivo.backup_exports", "info", 0.6, "Names of folders only.")
def backup_exports(df: DataFrame) -> DataFrame:
    found = df.filter(F.rlike(F.lower("source_path"), F.lit("vivobackup|\\.vivo")))
    return found.groupBy(F.col("source_path").alias("subject")).agg(F.count(F.lit(1)).alias("n"))


@rule("correlate.shared_media", "medium", 0.75, "Forwarded pictures are shared by many.")
def shared_media(df: DataFrame) -> DataFrame:
    return correlate.shared(df, "blob_sha256").select(F.col("blob_sha256").alias("subject"), "n")


@rule("correlate.shared_locations", "low", 0.5, "A cell is about a kilometre wide.")
def shared_locations(df: DataFrame) -> DataFrame:
    return correlate.shared_cells(df).select(F.col("cell").alias("subject"), "n")


@rule("colocation.rendezvous", "high", 0.6, "Near is not together.")
def rendezvous(df: DataFrame) -> DataFrame:
    """Pairs of exhibits with their encounters; those that travel together or meet again and again are graver."""
    found = places.pair_summary_of(places.presence(df))
    level = F.when(F.col("kind") == "single", "medium").otherwise("high")
    return found.select(F.concat_ws("/", "exhibit_a", "exhibit_b").alias("subject"), F.col("encounters").alias("n"), level.alias("severity"))


@rule("conversation.channel_switching", "medium", 0.6, "Many people use several apps.")
def channel_switching(df: DataFrame) -> DataFrame:
    found = threads.relationships(traffic(df)).filter("channels >= 3 and n >= 4")
    return found.select(F.col("party").alias("subject"), "n")


@rule("conversation.embedded_deletions", "medium", 0.75, "A gap inside a thread may be one of sync.")
def embedded(df: DataFrame) -> DataFrame:
    found = threads.metrics(traffic(df)).filter("embedded_deletion")
    return found.select(F.concat_ws("/", "exhibit", "app", "party").alias("subject"), F.col("n_deleted").alias("n"))


@rule("conversation.rapid_exchange", "low", 0.5, "Automatic replies are fast too.")
def rapid(df: DataFrame) -> DataFrame:
    found = threads.metrics(traffic(df)).filter("turns >= 8 and median_reply_us < 45000000")
    return found.select(F.concat_ws("/", "exhibit", "app", "party").alias("subject"), F.col("turns").alias("n"))


def fused(df: DataFrame) -> DataFrame:
    """Findings of what telemetry says of acts."""
    act, log = fusion.acts(df), fusion.telemetry(df)
    judged = fusion.verdicts(act, fusion.usage(act, log), log)
    return fusion.fusion_findings(judged, log, df.filter(_deleted()))


#: Kinds of entities that are findings by being there, with their severity and confidence.
TELLING = {"btc": ("high", 0.9), "eth": ("high", 0.8), "xmr": ("high", 0.85), "onion": ("high", 0.9), "card": ("high", 0.8), "iban": ("medium", 0.85), "imei": ("medium", 0.8)}


def entity_findings(df: DataFrame) -> DataFrame:
    """Findings of telling entities in bodies and attributes, one for each kind; n counts the rows that have one."""
    kinds = tuple(k for k in entities.KINDS if k.name in TELLING)
    found = entities.mentions(entities.texts_of(df), "artifact_id", "text", kinds)
    counted = found.groupBy("kind").agg(F.count_distinct("artifact_id").alias("n"), F.count_distinct("value").alias("values"))
    level, sure = (F.create_map(*(F.lit(x) for k, v in TELLING.items() for x in (k, v[i])))[F.col("kind")] for i in (0, 1))
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[level]
    return counted.select(
        F.concat(F.lit("entity."), "kind").alias("rule_id"), F.col("values").cast("string").alias("subject"), "n", level.alias("severity"), (rank + sure).alias("score"),
        F.lit("A string that passes a check may still be something else.").alias("caveat"),
    )


@rule("vivo.comms_fallback", "medium", 0.75, "Common on some makes; no sign of concealment.")
def comms_fallback(df: DataFrame) -> DataFrame:
    """Exhibits with messages but without calls or contacts, whose communications came from fallback sources."""
    count = lambda c: F.count(F.when(c, 1))
    paths = F.rlike(F.lower("source_path"), F.lit(r"dumpsys|vivobackup|content/|comms_logical|smsbackup|\.vcf"))
    kind = F.col("category")
    by = df.filter(kind.isin("Messages", "Contacts", "Calls")).groupBy("exhibit").agg(count(kind == "Messages").alias("m"), count(kind == "Contacts").alias("c"), count(kind == "Calls").alias("k"), count(paths).alias("n"))
    return by.filter("m > 0 and (c = 0 or k = 0) and n > 0").select(F.col("exhibit").alias("subject"), "n")


def _told(found: DataFrame, rule_id: Column | str, severity: Column | str, confidence: float, caveat: str) -> DataFrame:
    """Findings from (subject, n)."""
    level = severity if isinstance(severity, Column) else F.lit(severity)
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[level]
    name = rule_id if isinstance(rule_id, Column) else F.lit(rule_id)
    return found.select(name.alias("rule_id"), F.col("subject").cast("string").alias("subject"), F.col("n").cast("long").alias("n"), level.alias("severity"), (rank + F.lit(confidence)).alias("score"), F.lit(caveat).alias("caveat"))


def hashset_findings(screened: DataFrame) -> DataFrame:
    """Findings of digests.screen(): files of known bad sets, critical, and of known good ones, for information; one a set."""
    hit = screened.filter("verdict in ('known-bad', 'known-good')").groupBy("verdict", F.col("set_name").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    bad = F.col("verdict") == "known-bad"
    name = F.when(bad, "hashset.known_bad").otherwise("hashset.known_good")
    return _told(hit, name, F.when(bad, "critical").otherwise("info"), 0.9, "As good as the list that the digest is on.")


def media_findings(images: DataFrame, clusters: DataFrame) -> DataFrame:
    """Findings of pictures: images (id, exhibit, digest, hash), clusters (node, root) of those that look alike, as digests.clusters() gives.

    media.re_encoded_duplicates: a cluster of several digests; media.cross_exhibit_images: one on several exhibits; media.perceptual_unavailable:
    images without a hash, which no cluster can hold.
    """
    met = images.join(clusters.select(F.col("node").alias("id"), "root"), "id").groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("digest").alias("files"), F.count_distinct("exhibit").alias("exhibits")
    ).withColumn("subject", F.col("root"))
    wide = F.col("exhibits") > 1
    alike = "The same picture is not the same file; much of what circulates recurs."
    again = _told(met.filter("files > 1"), "media.re_encoded_duplicates", F.when(wide, "high").otherwise("medium"), 0.85, alike)
    cross = _told(met.filter(wide), "media.cross_exhibit_images", "high", 0.8, alike)
    without = images.filter("hash is null").agg(F.count(F.lit(1)).alias("n")).filter("n > 0").withColumn("subject", F.lit("images"))
    return again.unionByName(cross).unionByName(_told(without, "media.perceptual_unavailable", "info", 0.9, "No match says nothing of these."))


def name_findings(people: DataFrame, least: float = 0.86) -> DataFrame:
    """correlate.name_similarity: like names under different keys on different exhibits; people (exhibit, key, name).

    Two who are one key on any exhibit, or share a key, are not told of: the key has joined them already.
    """
    pairs = correlate.similar_names(people.select("key", "name"), least)
    of = people.select("key", "exhibit").distinct()
    side = lambda s: of.select(F.col("key").alias(f"key_{s}"), F.col("exhibit").alias(f"exhibit_{s}"))
    apart = pairs.join(side("a"), "key_a").join(side("b"), "key_b").filter("exhibit_a <> exhibit_b")
    found = apart.groupBy(F.concat_ws("~", "key_a", "key_b").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    return _told(found, "correlate.name_similarity", "low", 0.4, "Common names are alike; a prompt to look.")


def community_findings(e: DataFrame, labels: DataFrame, owner: str, least: int = 3) -> DataFrame:
    """graph.communities: groups of at least so many without the owner, if the communities (node, label) of edges e mean something."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("node") == owner).alias("_owner"))
    met = joins.beside(sizes, graph.meaningful(e, labels).select("meaningful"))
    return _told(met.filter(f"meaningful and n >= {least} and not _owner").withColumn("subject", F.col("label")), "graph.communities", "medium", 0.65, "Family and colleagues are groups too.")


def engine_errors(spark: SparkSession, failed: dict[str, str]) -> DataFrame:
    """engine.error.<rule>: a finding for each rule that failed, with why, so that nobody takes its silence for an answer."""
    made = spark.createDataFrame(sorted(failed.items()), "rule string, subject string").withColumn("n", F.lit(1))
    return _told(made, F.concat(F.lit("engine.error."), "rule"), "info", 1.0, "The rule did not run.")


def findings(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Findings of the rules, of fusion and of entities, by score and rule. Rules read df each on its own: store or cache it first if it is dear.

    A rule that can't be planned on df, for want of a column say, is a finding of its own and the others go on.
    """
    planned, failed = [], {}
    for n in names or sorted(RULES):
        try:
            planned.append(RULES[n](df))
        except AnalysisException as e:
            failed[n] = str(e).split("\n")[0][:200]
    if failed or not planned:
        planned.append(engine_errors(df.sparkSession, failed))
    out = reduce(lambda a, b: a.unionByName(b), planned)
    if names is None:
        out = out.unionByName(fused(df)).unionByName(entity_findings(df))
    return out.orderBy(F.col("score").desc(), "rule_id", F.col("n").desc(), "subject")


def confusion(df: DataFrame, truth: Column, predicted: Column, by: str) -> DataFrame:
    """Recall, precision and F1 by a column, null where nothing can be said."""
    out = df.groupBy(by).agg(
        F.count(F.when(truth & predicted, 1)).alias("tp"), F.count(F.when(~truth & predicted, 1)).alias("fp"),
        F.count(F.when(truth & ~predicted, 1)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return out.select(by, "tp", "fp", "fn", ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))

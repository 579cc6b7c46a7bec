"""The artifact schema and readers into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, timex

#: The categories of artifacts.
CATEGORIES = (
    "Calls", "Contacts", "Messages", "Chats", "Files & Media", "Web", "Places", "Security", "User activity log",
    "Accounts", "Applications", "Networks", "Device info", "Calendar", "Notes", "Other",
)
#: Their member names, in the same order.
MEMBERS = (
    "CALL", "CONTACT", "MESSAGE", "CHAT", "FILE", "WEB", "PLACE", "SECURITY", "ACTIVITY", "ACCOUNT", "APP", "NETWORK", "DEVICE", "CALENDAR",
    "NOTE", "OTHER",
)
DIRECTIONS = ("incoming", "outgoing", "missed", "draft", "local", "unknown")
COLUMNS = (
    "artifact_id", "exhibit", "category", "subtype", "timestamp", "timestamp_end", "direction", "app", "body", "recovery",
    "latitude", "longitude", "confidence", "party", "attributes", "source_path", "source_table", "source_row", "blob_sha256",
)


def coerce_category(c: Column) -> Column:
    """The category of that name or member name in any case, else Other."""
    found = F.lit("Other")
    for name, member in zip(CATEGORIES, MEMBERS, strict=True):
        found = F.when(F.lower(F.trim(c)).isin(name.lower(), member.lower()), F.lit(name)).otherwise(found)
    return found


def content_id(*parts: Column) -> Column:
    """Identity from content, so that reading again gives the same rows."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    """events (event_id, ts, user_id, event_type, value, props) as artifacts: a stated projection for tests."""
    kind = F.col("event_type")
    category = (
        F.when(kind == "purchase", "Messages").when(kind == "signup", "Calls").when(kind == "view", "Places").when(kind == "click", "Web")
    ).otherwise("User activity log")
    deleted = F.col("event_id") % 10 == 0
    k = F.get_json_object("props", "$.k").cast("double")
    us = timex.micros(F.col("ts"))
    party = F.concat(F.lit("+91"), (F.lit(9800000000) + F.col("user_id")).cast("string"))
    return events.select(
        F.concat(F.lit("ev-"), F.col("event_id")).alias("artifact_id"),
        F.concat(F.lit("EXH-"), F.col("event_id") % 3).alias("exhibit"),
        category.alias("category"),
        F.when(kind == "error", "App usage event").otherwise(kind).alias("subtype"),
        us.alias("timestamp"),
        F.when(kind == "signup", us + F.floor("value").cast("long") * 1_000_000).alias("timestamp_end"),
        F.when(F.col("event_id") % 2 == 0, "incoming").otherwise("outgoing").alias("direction"),
        F.concat(F.lit("app"), F.col("user_id") % 5).alias("app"),
        kind.alias("body"),
        F.when(deleted, "wal").otherwise("allocated").alias("recovery"),
        (19 + k / 1000).alias("latitude"),
        (72 + k / 1000).alias("longitude"),
        F.when(deleted, 0.7).otherwise(1.0).alias("confidence"),
        keys.party_key(party).alias("party"),
        F.col("props").alias("attributes"),
        F.lit("events.parquet").alias("source_path"), F.lit("events").alias("source_table"), F.col("event_id").cast("long").alias("source_row"),
        F.lit("").alias("blob_sha256"),
    )


def in_schema(rows: DataFrame, **given: Column) -> DataFrame:
    """rows with the columns of the schema; those that aren't given have their defaults, and there is no time. Any others given follow."""
    rest = {
        "timestamp": F.lit(None).cast("long"), "timestamp_end": F.lit(None).cast("long"), "latitude": F.lit(None).cast("double"),
        "longitude": F.lit(None).cast("double"), "confidence": F.lit(1.0), "recovery": F.lit("allocated"), "direction": F.lit("unknown"),
    }
    return rows.select(*(given.get(c, rest.get(c, F.lit(""))).alias(c) for c in COLUMNS), *(v.alias(c) for c, v in given.items() if c not in COLUMNS))


def from_documents(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang, source) as undated files, the source as their app: a stated projection for tests."""
    attributes = F.to_json(F.struct(F.col("lang").alias("lang"), F.length("text").alias("chars")))
    return in_schema(
        documents, artifact_id=F.concat(F.lit("doc-"), "doc_id"), exhibit=F.concat(F.lit("EXH-"), F.col("doc_id") % 3), category=F.lit("Files & Media"),
        subtype=F.lit("Document"), app=F.coalesce("source", F.lit("")), body=F.coalesce("text", F.lit("")), attributes=attributes,
        source_path=F.lit("documents.parquet"), source_table=F.lit("documents"), source_row=F.col("doc_id").cast("long"), blob_sha256=F.sha2("text", 256),
    )


def from_conversations(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as undated chats: a stated projection for tests."""
    way = F.when(F.col("role") == "user", "incoming").when(F.col("role") == "assistant", "outgoing").otherwise("local")
    return in_schema(
        conversations, artifact_id=F.concat_ws("-", F.lit("conv"), "conv_id", "turn"), exhibit=F.lit("EXH-C"), category=F.lit("Chats"),
        subtype=F.coalesce("role", F.lit("")), app=F.lit("chat"), body=F.coalesce("text", F.lit("")), direction=way, party=F.col("conv_id").cast("string"),
        attributes=F.lit("{}"), source_path=F.lit("conversations.parquet"), source_table=F.lit("conversations"), source_row=F.col("turn").cast("long"),
    )


def union(*stores: DataFrame) -> DataFrame:
    """Several stores as one, by name; what only some have is null in the others."""
    made = stores[0]
    for s in stores[1:]:
        made = made.unionByName(s, allowMissingColumns=True)
    return made


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


#: Files that are noise in any tree, by name, ending and folder.
NOISE = r"(?i)(/(\.ds_store|thumbs\.db|\.nomedia|desktop\.ini)|\.(lock|tmp|pid|shm))$|/(cache/webviewcachechromium|code_cache|lib|oat)/"


def read_folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a folder, without noise, with size, digests and the type their first bytes show, which beats the name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    files = files.filter(~F.rlike("path", F.lit(NOISE)))
    head = F.hex(F.substring("content", 1, 12))
    sniffed = (
        F.when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg")
        .when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png")
        .when(F.startswith(head, F.lit("474946383")), "image/gif")
        .when(F.startswith(head, F.lit("25504446")), "application/pdf")
        .when(F.startswith(head, F.lit("504B0304")), "application/zip")
        .when(F.startswith(head, F.lit("53514C69746520666F726D61")), "application/x-sqlite3")
        .otherwise("application/octet-stream")
    )
    named = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    images = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "pdf": "application/pdf", "zip": "application/zip"}
    told = F.create_map(*(F.lit(x) for kv in images.items() for x in kv))[named]
    return files.select(
        "path", "length", timex.micros(F.col("modificationTime")).alias("modified"), sniffed.alias("mime"),
        (told.isNotNull() & (told != sniffed)).alias("mismatch"),
        F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"),
    )


def read_message_xml(spark: SparkSession, path: str) -> DataFrame:
    """Backup files of <sms address date type body contact_name> as artifacts."""
    rows = spark.read.format("xml").option("rowTag", "sms").option("attributePrefix", "").schema(
        "address string, date long, type int, body string, contact_name string"
    ).load(path)
    direction = F.when(F.col("type") == 1, "incoming").when(F.col("type") == 2, "outgoing").when(F.col("type") == 3, "draft").otherwise("unknown")
    return rows.select(
        content_id(F.col("address"), F.col("date"), F.col("type"), F.col("body")).alias("artifact_id"),
        F.lit("Messages").alias("category"), F.lit("SMS").alias("subtype"),
        timex.from_epoch(F.col("date"), "unix_ms").alias("timestamp"), direction.alias("direction"), "body",
        keys.party_key(F.col("address"), F.col("contact_name")).alias("party"),
    )


def read_call_xml(spark: SparkSession, path: str) -> DataFrame:
    """Backup files of <call number duration date type contact_name> as artifacts."""
    rows = spark.read.format("xml").option("rowTag", "call").option("attributePrefix", "").schema(
        "number string, duration long, date long, type int, contact_name string"
    ).load(path)
    direction = F.when(F.col("type") == 1, "incoming").when(F.col("type") == 2, "outgoing").when(F.col("type").isin(3, 5), "missed").otherwise("unknown")
    begun = timex.from_epoch(F.col("date"), "unix_ms")
    return rows.select(
        content_id(F.col("number"), F.col("date"), F.col("type"), F.col("duration")).alias("artifact_id"),
        F.lit("Calls").alias("category"), F.lit("Call").alias("subtype"), begun.alias("timestamp"),
        (begun + F.coalesce("duration", F.lit(0)) * 1_000_000).alias("timestamp_end"), direction.alias("direction"),
        keys.party_key(F.col("number"), F.col("contact_name")).alias("party"),
    )


def read_vcards(spark: SparkSession, path: str) -> DataFrame:
    """Files of vCards as contacts: one row for each card and number or address, with its party key and name.

    Files are cut at END:VCARD by the reader, folded lines are joined, and group names and parameters of a property dropped.
    """
    cards = spark.read.option("lineSep", "END:VCARD").text(path).filter(F.contains(F.upper("value"), F.lit("BEGIN:VCARD")))
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), "\n[ \t]", ""), "\n")
    value = lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:", ""))
    of = lambda kinds: F.filter("lines", lambda x: F.rlike(x, F.lit(rf"(?i)^([\w-]+\.)?({kinds})[;:]")))
    cut = cards.select(lines.alias("lines")).select(
        value(F.coalesce(F.get(of("FN"), F.lit(0)), F.get(of("N"), F.lit(0)))).alias("name"), F.transform(of("TEL|EMAIL"), value).alias("values")
    )
    each = cut.select("name", F.explode_outer("values").alias("identifier"))
    return each.select(
        content_id(F.col("name"), F.col("identifier")).alias("artifact_id"), F.lit("Contacts").alias("category"), "name", "identifier",
        keys.party_key(F.col("identifier"), F.col("name")).alias("party"),
    )


def append_tags(tags: DataFrame, path: str) -> None:
    """Add tags (artifact_id, name, created_at) to a table that is only ever appended to; latest_tags() reads it."""
    tags.select("artifact_id", "name", "created_at").write.mode("append").parquet(path)


def latest_tags(tags: DataFrame) -> DataFrame:
    """One row for each artifact and tag, the latest."""
    return tags.groupBy("artifact_id", "name").agg(F.max("created_at").alias("created_at"))


def read_export_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A tool's CSV export; columns gives the artifact column of each of its headers."""
    rows = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    return rows.select(*(F.col(f"`{a}`").alias(b) for a, b in columns.items() if a in rows.columns))


def write_artifacts(df: DataFrame, path: str) -> None:
    """Parquet by exhibit and category, in time order within files so that ranges prune."""
    df.repartition("exhibit", "category").sortWithinPartitions("timestamp").write.partitionBy("exhibit", "category").mode("overwrite").parquet(path)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Query results without a cap; kind is csv, json, parquet or xml."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", "true").csv(path)
    elif kind == "xml":
        writer.format("xml").option("rowTag", "artifact").save(path)
    else:
        writer.format(kind).save(path)

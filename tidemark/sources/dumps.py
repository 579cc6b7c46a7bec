"""Records of text dumps: read by record delimiter, over line and split boundaries, without a file ever being held whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, keys, text, timex
from .artifacts import content_id, in_schema

#: A record of a provider dump begins with this on a line of its own beginning; its number follows.
RECORD = "\nRow: "
#: A field begins with its name and an equals sign, after a comma and a space.
FIELD = r"(?:^|, )([A-Za-z_][A-Za-z0-9_]*)="


def provider_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, fields) of dumps of content providers: ``Row: 7 _id=1, body=some text, date=…``.

    Spark's reader cuts the files at the delimiter itself, also where splits begin inside a record, so texts of many lines stay in their
    record. A comma inside a value starts a field only if a name and an equals sign follow. Names are lower-cased, of a name that comes twice
    the first counts, and NULL is null.
    """
    lines = spark.read.option("lineSep", RECORD).text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^Row: ", "").alias("line"))
    rows = lines.select("file", F.regexp_extract("line", "^([0-9]+) ", 1).cast("long").alias("number"), F.regexp_replace(F.regexp_replace("line", "^[0-9]+ ", ""), r"\s+$", "").alias("line")).filter("number is not null")
    mark = "\x1e"
    parts = F.filter(F.split(F.regexp_replace("line", FIELD, f"{mark}$1="), mark), lambda p: p != "")
    pair = lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("key"), F.nullif(F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))), F.lit("NULL")).alias("value"))
    pairs = F.transform(parts, pair)
    first = F.filter("_pairs", lambda p, i: F.array_position(F.transform("_pairs", lambda q: q["key"]), p["key"]) == i + 1)
    return rows.withColumn("_pairs", pairs).select("file", "number", F.map_from_entries(first).alias("fields"))


def _of(*names: str) -> Column:
    return F.coalesce(*(F.nullif(F.element_at("fields", n), F.lit("")) for n in names), F.lit(""))


def dumped_messages(spark: SparkSession, path: str, exhibit: str = "") -> DataFrame:
    """Text messages of provider dumps as artifacts."""
    rows = provider_rows(spark, path)
    kind = _of("type", "msg_box").try_cast("int")
    way = F.when(kind == 1, "incoming").when(kind.isin(2, 4, 5, 6), "outgoing").when(kind == 3, "draft").otherwise("unknown")
    return in_schema(
        rows, artifact_id=content_id(F.lit("dump"), _of("_id"), _of("date", "date_sent"), _of("body")), exhibit=F.lit(exhibit), category=F.lit("Messages"), subtype=F.lit("SMS"), app=F.lit("Messages"),
        timestamp=timex.guess(_of("date", "date_sent").try_cast("long"), "date"), direction=way, body=_of("body"), party=keys.party_key(_of("address", "number")),
        source_path=F.col("file"), source_table=F.lit("sms"), source_row=F.col("number"), attributes=F.to_json("fields"),
    )


def dumped_calls(spark: SparkSession, path: str, exhibit: str = "") -> DataFrame:
    """Calls of provider dumps as artifacts."""
    rows = provider_rows(spark, path)
    kind, begun = _of("type").try_cast("int"), timex.guess(_of("date").try_cast("long"), "date")
    way = F.when(kind == 1, "incoming").when(kind == 2, "outgoing").when(kind.isin(3, 5), "missed").otherwise("unknown")
    seconds = F.coalesce(_of("duration").try_cast("long"), F.lit(0))
    return in_schema(
        rows.filter(_of("number", "address") != ""), artifact_id=content_id(F.lit("dumped call"), _of("_id"), _of("date"), _of("number", "address")), exhibit=F.lit(exhibit), category=F.lit("Calls"),
        subtype=F.lit("Call"), app=F.lit("Phone"), timestamp=begun, timestamp_end=F.when(seconds > 0, begun + seconds * 1_000_000), direction=way, party=keys.party_key(_of("number", "address"), _of("name")),
        source_path=F.col("file"), source_table=F.lit("calls"), source_row=F.col("number"), attributes=F.to_json("fields"),
    )


# How lines of service dumps name the number and the time of a call, and a place.
CALL_LINE = r"(?i)(?:number|addr|phone)=([^,\s]+).*?(?:date|time|when)=([0-9]+)"
LATITUDE, LONGITUDE = (rf"(?i)(?:{n})\s*[=:]\s*(-?[0-9]+\.[0-9]+)" for n in ("lat(?:itude)?", "lon(?:gitude)?|lng"))
FIX = r"(?i)\b(gps|network|fused|passive)\s+(-?[0-9]{1,2}\.[0-9]+),\s*(-?[0-9]{1,3}\.[0-9]+)"
PHONE = r"\+?[0-9][0-9 ()-]{6,}[0-9]"


def service_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of dumps of system services, of whatever length the files are."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def service_calls(spark: SparkSession, path: str, exhibit: str = "") -> DataFrame:
    """Calls told of by service dumps, each number and time once."""
    lines = service_lines(spark, path).select("file", text.clean_number(F.regexp_extract("line", CALL_LINE, 1)).alias("number"), F.regexp_extract("line", CALL_LINE, 2).alias("at")).filter("number <> ''")
    once = lines.groupBy("number", "at").agg(F.min("file").alias("file"))
    return in_schema(
        once, artifact_id=content_id(F.lit("service call"), F.col("number"), F.col("at")), exhibit=F.lit(exhibit), category=F.lit("Calls"), subtype=F.lit("Call of a service dump"), app=F.lit("System"),
        timestamp=timex.guess(F.col("at").try_cast("long"), "date"), party=keys.party_key(F.col("number")), body=F.concat(F.lit("Call with "), "number"), source_path=F.col("file"),
    )


def service_contacts(spark: SparkSession, path: str, exhibit: str = "") -> DataFrame:
    """Contacts told of by lines with a name and up to three numbers."""
    lines = service_lines(spark, path).filter(F.rlike(F.lower("line"), F.lit("display|name")))
    name = F.substring(F.trim(F.substring(F.col("line"), F.instr("line", "=") + 1, F.length("line"))), 1, 120)
    each = lines.select("file", name.alias("name"), F.explode(F.slice(F.regexp_extract_all("line", F.lit(f"({PHONE})")), 1, 3)).alias("raw"))
    each = each.withColumn("number", text.clean_number(F.col("raw"))).filter("number <> ''")
    return in_schema(
        each, artifact_id=content_id(F.lit("service contact"), F.col("name"), F.col("number")), exhibit=F.lit(exhibit), category=F.lit("Contacts"), subtype=F.lit("Contact of a service dump"), app=F.lit("System"),
        body=F.col("name"), party=keys.party_key(F.col("number"), F.col("name")), source_path=F.col("file"),
    )


def service_places(spark: SparkSession, path: str, exhibit: str = "") -> DataFrame:
    """Places told of by lines of service dumps, as named coordinates or as a provider's fix, each once, with the time where given."""
    at = lambda pattern, k: F.regexp_extract("line", pattern, k).try_cast("double")
    when = F.regexp_extract("line", r"(?i)(?:date|time|when|et)=([0-9]{10,13})", 1)
    found = service_lines(spark, path).select(
        "file", F.coalesce(at(LATITUDE, 1), at(FIX, 2)).alias("lat"), F.coalesce(at(LONGITUDE, 1), at(FIX, 3)).alias("lon"), F.lower(F.regexp_extract("line", FIX, 1)).alias("provider"), when.alias("when")
    )
    good = found.filter(geo.plausible(F.col("lat"), F.col("lon")))
    once = good.groupBy("lat", "lon", "provider", "when").agg(F.min("file").alias("file"))
    return in_schema(
        once, artifact_id=content_id(F.lit("service place"), F.col("provider"), F.col("lat"), F.col("lon"), F.col("when")), exhibit=F.lit(exhibit), category=F.lit("Places"), subtype=F.lit("Fix of a service dump"),
        app=F.lit("System"), timestamp=timex.guess(F.col("when").try_cast("long"), "time"), latitude=F.col("lat"), longitude=F.col("lon"), attributes=F.to_json(F.struct("provider")), source_path=F.col("file"),
    )

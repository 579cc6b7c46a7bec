"""Registered queries of lists, dashboards, entities of graphs, fusion and rules, with the SQL they must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text, timex
from ..operators import correlate, dashboard, digests, findings, fusion, graph, joins, keywords, places, search, tables, threads
from ..operators.index import TextIndex
from ..sources import artifacts as A
from ..sources import exports
from ..sources.artifacts import table
from . import predicates as P
from .catalog import ART, CELL, CLUSTERS, DAY, MET, NOW, OWNER, SQL, THREADS, TOKENS, TRADE, USAGE, query, trade

DOCS = """WITH docs AS (SELECT 'doc-' || doc_id AS artifact_id, 'EXH-' || (doc_id % 3) AS exhibit, 'Files & Media' AS category, 'Document' AS subtype, NULL::BIGINT AS timestamp,
 coalesce(source, '') AS app, coalesce(text, '') AS body, sha256(text) AS blob_sha256, 1.0::DOUBLE AS confidence, doc_id::BIGINT AS source_row FROM documents) """
CHAT = """WITH chat AS (SELECT 'conv-' || conv_id || '-' || turn AS artifact_id, coalesce(role, '') AS subtype, coalesce(text, '') AS body, conv_id::VARCHAR AS party,
 CASE role WHEN 'user' THEN 'incoming' WHEN 'assistant' THEN 'outgoing' ELSE 'local' END AS direction, turn::BIGINT AS source_row FROM conversations) """
TAGS = """tags AS (SELECT 'doc-' || doc_id AS artifact_id, name FROM (SELECT doc_id, 'toxic' AS name FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'poor' FROM labels WHERE quality = 0)) """


def documents(spark: SparkSession, d: str) -> DataFrame:
    return A.from_documents(table(spark, d, "documents"))


def chats(spark: SparkSession, d: str) -> DataFrame:
    return A.from_conversations(table(spark, d, "conversations"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of documents by their labels."""
    found = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "poor")))
    return table(spark, d, "labels").select(F.concat(F.lit("doc-"), "doc_id").alias("artifact_id"), F.explode(found).alias("name"))


_indexes: dict[tuple[str, str], TextIndex] = {}


def text_index(spark: SparkSession, d: str) -> TextIndex:
    """The index of the documents' texts, made once a session in two batches, the second of which finds the first half there."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexes:
        made = TextIndex(spark, f"{tables.shared_folder(spark)}/index-{uuid.uuid4().hex}")
        docs = table(spark, d, "documents").select("doc_id", "text")
        made.append(docs.filter("doc_id % 2 = 0"), "doc_id", ["text"])
        made.append(docs, "doc_id", ["text"])
        _indexes[key] = made
    return _indexes[key]


def folded(c: str) -> str:
    return "' ' || array_to_string(" + TOKENS.replace("text", c) + ", ' ') || ' '"


@query("search_anywhere", DOCS + f"SELECT artifact_id FROM docs WHERE {' OR '.join(f'contains({folded(c)}, {chr(39)} the and {chr(39)})' for c in ('body', 'app', 'subtype'))}")
def _(df, spark, d):
    return documents(spark, d).filter(P.anywhere("The and")).select("artifact_id")


@query("search_body", CHAT + "SELECT artifact_id, party FROM chat WHERE contains(lower(body), 'th') AND direction = 'outgoing'")
def _(df, spark, d):
    return chats(spark, d).filter(P.body_part("TH") & P.direction("outgoing")).select("artifact_id", "party")


@query("filter_recovery", "SELECT artifact_id, recovery FROM art WHERE recovery = 'wal' AND category = 'Messages' AND contains(source_path, 'events')")
def _(df, spark, d):
    return df.filter(P.recovery("wal") & P.category("message") & P.like("source_path", "EVENTS")).select("artifact_id", "recovery")


@query("filter_time", "SELECT artifact_id, timestamp FROM art WHERE timestamp > 1704931199999999 AND timestamp < 1705104000000000")
def _(df, spark, d):
    return df.filter(P.timestamp(">", "2024-01-10") & P.timestamp("<", "2024-01-13")).select("artifact_id", "timestamp")


@query("filter_before", "SELECT artifact_id, timestamp FROM art WHERE timestamp <= 1704585599999999")
def _(df, spark, d):
    return df.filter(P.before("2024-01-06")).select("artifact_id", "timestamp")


@query("filter_id", "SELECT artifact_id, category, app FROM art WHERE artifact_id = 'ev-7'")
def _(df, spark, d):
    return df.filter(P.identity(" ev-7 ")).select("artifact_id", "category", "app")


@query("filter_tag", DOCS + ", " + TAGS + "SELECT artifact_id, app FROM docs WHERE artifact_id IN (SELECT artifact_id FROM tags WHERE name = 'toxic')")
def _(df, spark, d):
    return P.tagged(documents(spark, d), tags(spark, d), "toxic").select("artifact_id", "app")


@query("filter_media", DOCS + "SELECT artifact_id, exhibit FROM docs WHERE blob_sha256 <> '' AND app = 'web'")
def _(df, spark, d):
    return documents(spark, d).filter(P.has("media") & (F.col("app") == "web")).select("artifact_id", "exhibit")


@query("field_suggestions", """, p AS (SELECT field, value, count(*) AS n FROM (SELECT unnest(['category', 'app', 'party']) AS field, unnest([category, app, party]) AS value FROM art) GROUP BY ALL)
 SELECT field, value, n FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS r FROM p) WHERE r <= 12""")
def _(df, spark, d):
    return search.suggestions(df, ["category", "app", "party"])


@query("row_projection", "SELECT artifact_id, category, timestamp, body AS line, json_extract_string(attributes, '$.k') AS k FROM art")
def _(df, spark, d):
    return search.rows(df, ["k"])


@query("column_view_calls", """SELECT artifact_id, strftime(make_timestamp(timestamp), '%Y-%m-%dT%H:%M:%S+00:00') AS time, direction, party, (timestamp_end - timestamp) // 1000000 AS seconds, app
 FROM art WHERE category = 'Calls'""")
def _(df, spark, d):
    return search.column_view(df, "Calls")


@query("column_view_places", """SELECT artifact_id, strftime(make_timestamp(timestamp), '%Y-%m-%dT%H:%M:%S+00:00') AS time, latitude, longitude, subtype AS what, app FROM art WHERE category = 'Places'""")
def _(df, spark, d):
    return search.column_view(df, "Places")


@query("list_page", "SELECT artifact_id, app, timestamp FROM art WHERE category = 'Web' ORDER BY app DESC NULLS LAST, artifact_id LIMIT 50 OFFSET 25")
def _(df, spark, d):
    return search.page(df.filter(P.category("Web")), "app", descending=True, limit=50, offset=25).select("artifact_id", "app", "timestamp")


@query("list_merged", ART + """, docs AS (SELECT 'doc-' || doc_id AS artifact_id, NULL::BIGINT AS timestamp FROM documents) SELECT artifact_id, timestamp FROM
 (SELECT artifact_id, timestamp FROM art UNION ALL SELECT * FROM docs) ORDER BY timestamp ASC NULLS LAST, artifact_id LIMIT 300 OFFSET (SELECT count(*) - 100 FROM art)""")
def _(df, spark, d):
    both = A.union(df, documents(spark, d))
    return search.page(both, limit=300, offset=df.count() - 100).select("artifact_id", "timestamp")


@query("deleted_view", "SELECT artifact_id, confidence, timestamp FROM art WHERE recovery <> 'allocated' ORDER BY confidence DESC, timestamp DESC NULLS LAST, artifact_id LIMIT 200")
def _(df, spark, d):
    return search.deleted_view(df).limit(200).select("artifact_id", "confidence", "timestamp")


@query("gallery", DOCS + "SELECT artifact_id, app, blob_sha256 FROM docs WHERE app = 'web'")
def _(df, spark, d):
    return search.gallery(documents(spark, d), ["Document"], app="web").select("artifact_id", "app", "blob_sha256")


RANKED = f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'licensed')) AS t1, len(list_filter(w, lambda x: x = 'attion')) AS t2 FROM w),
 t AS (SELECT count(*) AS rows, avg(n) AS mean, count(*) FILTER (WHERE t1 > 0) AS d1, count(*) FILTER (WHERE t2 > 0) AS d2 FROM c)
 SELECT doc_id, round(ln(1 + (rows - d2 + 0.5::DOUBLE) / (d2 + 0.5::DOUBLE)) * t2 * 2.2::DOUBLE / (t2 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))
  + ln(1 + (rows - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * t1 * 2.2::DOUBLE / (t1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)), 4) AS score FROM c, t WHERE t1 + t2 > 0"""


@query("scan_ranked", RANKED)
def _(df, spark, d):
    return search.ranked(table(spark, d, "documents"), "doc_id", "text", ["attion", "licensed"])


@query("text_ranked", RANKED)
def _(df, spark, d):
    return text_index(spark, d).ranked("attion licensed", "text").withColumnRenamed("doc", "doc_id")


@query("text_word", SQL["scan_word"])
def _(df, spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang")
    return text_index(spark, d).word("Éauouon").join(docs, "doc").select(F.col("doc").alias("doc_id"), "lang")


@query("text_phrase", SQL["scan_phrase"])
def _(df, spark, d):
    return text_index(spark, d).phrase("the AND attion").select(F.col("doc").alias("doc_id"))


@query("phrase_counts", f"""WITH x AS (SELECT lang, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS line FROM documents), p AS (SELECT unnest(['of the', 'de la', 'und die', 'que la', 'licensed']) AS phrase)
 SELECT phrase, lang, count(*) AS docs FROM x JOIN p ON contains(line, ' ' || phrase || ' ') GROUP BY ALL""")
def _(df, spark, d):
    """Documents by phrase and language, each phrase from the index."""
    found = text_index(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "lang")
    each = [found.phrase(p).withColumn("phrase", F.lit(p)) for p in ("of the", "de la", "und die", "que la", "licensed")]
    return A.union(*each).join(docs, "doc").groupBy("phrase", "lang").agg(F.count(F.lit(1)).alias("docs"))


@query("bounded_samples", """SELECT party, list(artifact_id ORDER BY artifact_id) AS samples FROM (SELECT party, artifact_id, row_number() OVER (PARTITION BY party ORDER BY artifact_id) AS r FROM art)
 WHERE r <= 5 GROUP BY party""".replace("list(artifact_id ORDER BY artifact_id)", "string_agg(artifact_id, ',' ORDER BY artifact_id)"))
def _(df, spark, d):
    return search.samples(df, ["party"], "artifact_id").withColumn("samples", F.array_join("samples", ","))


@query("term_list", "SELECT lower(trim(p_name)) AS folded, arg_min(trim(p_name), p_partkey) AS term FROM part WHERE trim(p_name) <> '' GROUP BY 1")
def _(df, spark, d):
    return search.terms_of(table(spark, d, "part"), "p_name", "p_partkey")


@query("keyword_report", f"""WITH x AS (SELECT doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS line FROM documents), t AS (SELECT unnest(['The and', 'licensed', 'nowhere at all', 'und']) AS term),
 h AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY term) AS rows FROM x JOIN t ON contains(line, ' ' || lower(term) || ' '))
 SELECT term, coalesce(rows, 0) AS rows, samples, row_number() OVER (ORDER BY coalesce(rows, 0) DESC, lower(term))::INTEGER AS rank FROM t
 LEFT JOIN (SELECT term, any_value(rows) AS rows, string_agg(doc_id, ',' ORDER BY doc_id) AS samples FROM h WHERE r <= 3 GROUP BY term) USING (term)""")
def _(df, spark, d):
    lines = spark.createDataFrame([(1, "# what to look for"), (2, "The and, licensed"), (3, "LICENSED"), (4, '"nowhere at all"'), (5, " und "), (6, "")], "at int, line string")
    found = keywords.keyword_report(table(spark, d, "documents"), "doc_id", "text", search.terms_of(lines, "line", "at"))
    return found.withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query("place_bounds", """SELECT exhibit, count(*) AS n, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude
 FROM art WHERE latitude IS NOT NULL GROUP BY exhibit""")
def _(df, spark, d):
    return places.bounds(df)


@query("correlation_summary", f"""SELECT 'parties' AS what, count(*) AS n FROM (SELECT party FROM comm GROUP BY 1 HAVING count(DISTINCT exhibit) >= 2)
 UNION ALL SELECT 'media', count(*) FROM (SELECT blob_sha256 FROM art WHERE blob_sha256 <> '' GROUP BY 1 HAVING count(DISTINCT exhibit) >= 2)
 UNION ALL SELECT 'cells', count(*) FROM (SELECT {CELL.format('latitude')} AS y, {CELL.format('longitude')} AS x FROM art GROUP BY 1, 2 HAVING count(DISTINCT exhibit) >= 2)
 UNION ALL SELECT 'asymmetric', count(*) FROM (SELECT party FROM (SELECT party, exhibit, count(*) FILTER (WHERE recovery <> 'allocated') AS gone FROM comm GROUP BY 1, 2) GROUP BY party
  HAVING count(*) FILTER (WHERE gone > 0) BETWEEN 1 AND count(*) - 1)""")
def _(df, spark, d):
    return correlate.summary(df, findings.traffic(df))


@query("hydrated_tags", DOCS + ", " + TAGS + """SELECT artifact_id, coalesce(t, '') AS tags FROM docs LEFT JOIN
 (SELECT artifact_id, string_agg(name, ',' ORDER BY name) AS t FROM tags GROUP BY 1) USING (artifact_id)""")
def _(df, spark, d):
    held = joins.hydrated(documents(spark, d).select("artifact_id"), tags(spark, d), "artifact_id", "tags", ["name"])
    return held.select("artifact_id", F.array_join(F.col("tags")["name"], ",").alias("tags"))


@query("app_contacts", """SELECT c_custkey::BIGINT AS source_row, c_name AS body, (9800000000 + c_custkey)::VARCHAR AS party FROM customer WHERE c_name <> ''""")
def _(df, spark, d):
    c = table(spark, d, "customer")
    raw = c.select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("account_type"))
    phone = F.concat(F.lit("+91 "), (F.lit(9800000000) + F.col("c_custkey")).cast("string"))
    pairs = F.array(F.struct(F.lit(5).alias("mimetype_id"), phone.alias("data1")), F.struct(F.lit(7).alias("mimetype_id"), F.col("c_name").alias("data1")))
    data = c.select(F.col("c_custkey").alias("raw_contact_id"), F.inline(pairs))
    kinds = spark.createDataFrame([(5, "vnd.android.cursor.item/phone_v2"), (7, "vnd.android.cursor.item/name")], "_id int, mimetype string")
    return exports.android_contacts(raw, data, kinds).select("source_row", "body", "party")


@query("contact_names", """SELECT artifact_id, party, name FROM comm LEFT JOIN (SELECT (9800000000 + c_custkey)::VARCHAR AS party, c_name AS name FROM customer WHERE c_acctbal > 0) USING (party)""")
def _(df, spark, d):
    saved = table(spark, d, "customer").filter("c_acctbal > 0")
    names = saved.select((F.lit(9800000000) + F.col("c_custkey")).cast("string").alias("party"), F.col("c_name").alias("name"), F.col("c_custkey").alias("order"))
    return joins.named(findings.traffic(df).select("artifact_id", "party"), names, "party")


for name, left, right, key in (("residue", "customer", "orders", "custkey"), ("pending", "documents", "labels", "doc_id"), ("missing_payloads", "part", "lineitem", "partkey")):
    a, b = {"custkey": ("c_custkey", "o_custkey"), "doc_id": ("doc_id", "doc_id"), "partkey": ("p_partkey", "l_partkey")}[key]

    @query(name, f"SELECT {a} AS id FROM {left} WHERE {a} NOT IN (SELECT {b} FROM {right} WHERE {b} IS NOT NULL)")
    def _(df, spark, d, left=left, right=right, a=a, b=b):
        return joins.missing(table(spark, d, left).select(F.col(a).alias("id")), table(spark, d, right).select(F.col(b).alias("id")), ["id"])


@query("union_counts", ART + ", " + DOCS.removeprefix("WITH ") + "SELECT exhibit, category, count(*) AS n FROM (SELECT exhibit, category FROM art UNION ALL SELECT exhibit, category FROM docs) GROUP BY ALL")
def _(df, spark, d):
    return A.union(df, documents(spark, d)).groupBy("exhibit", "category").agg(F.count(F.lit(1)).alias("n"))


@query("parties_only_there", "SELECT DISTINCT party FROM comm WHERE exhibit = 'EXH-1' EXCEPT SELECT party FROM comm WHERE exhibit = 'EXH-2' AND recovery <> 'allocated'")
def _(df, spark, d):
    there = lambda x: findings.traffic(df).filter(F.col("exhibit") == x)
    return joins.missing(there("EXH-1").select("party").distinct(), there("EXH-2").filter(P.deleted()), ["party"])


@query("common_keys", """SELECT a.c_nationkey AS nation, count(*) AS n FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000) a
 JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 0) b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment GROUP BY 1""")
def _(df, spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("x"))
    poor = table(spark, d, "customer").filter("c_acctbal < 0").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("y"))
    met = rich.join(poor, "c_nationkey").filter(F.arrays_overlap("x", "y"))
    return met.select(F.col("c_nationkey").alias("nation"), F.size(F.array_intersect("x", "y")).cast("long").alias("n"))


@query("app_by_category", "SELECT app, category, count(*) AS n FROM art GROUP BY 1, 2")
def _(df, spark, d):
    return dashboard.app_by_category(df)


@query("source_summary", "SELECT source_path, count(*) AS n, count(DISTINCT source_table) AS tables, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(DISTINCT exhibit) AS exhibits FROM art GROUP BY 1")
def _(df, spark, d):
    return dashboard.sources(df)


@query("tag_counts", "WITH " + TAGS + "SELECT name, count(DISTINCT artifact_id) AS n FROM tags GROUP BY 1")
def _(df, spark, d):
    return dashboard.tag_counts(tags(spark, d))


COVERAGE = """SELECT count(*) AS total, count(timestamp) AS timestamped, round(100 * count(timestamp) / count(*), 1) AS timestamped_pct, round(100 * count(latitude) / count(*), 1) AS geolocated_pct,
 round(100 * count(*) FILTER (WHERE recovery <> 'allocated') / count(*), 1) AS deleted_pct, round(100 * count(*) FILTER (WHERE blob_sha256 <> '') / count(*), 1) AS blob_pct,
 count(DISTINCT category) AS categories, count(DISTINCT app) AS apps, count(DISTINCT source_path) AS sources,
 round(count(*) FILTER (WHERE category IN ('Calls', 'Messages', 'Chats')) / greatest((max(timestamp) - min(timestamp)) / 86400000000, 1), 1) AS comms_per_day FROM art"""


@query("coverage", COVERAGE)
def _(df, spark, d):
    return dashboard.coverage(df)


@query("health", f", c AS ({COVERAGE}) SELECT *, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'limited' END AS label FROM (SELECT *, (35 - 6 + round(25 * timestamped / total) + round(20 * least(1.0, categories / 6)) + 10)::INTEGER AS score FROM c)")
def _(df, spark, d):
    return dashboard.health(dashboard.coverage(df), alerts=1, encrypted=1)


DAYS = f", days AS (SELECT {DAY} AS day, count(*) AS n FROM art GROUP BY 1) "


@query("busy_days", ART + DAYS.replace("FROM art", "FROM art WHERE category = 'Calls'") + """, m AS (SELECT n AS median FROM (SELECT n, row_number() OVER (ORDER BY n, day) AS r, (count(*) OVER ()) // 2 AS half FROM days) WHERE r = half + 1)
 SELECT day, n, round(n / greatest(median, 1), 1) AS ratio FROM days, m WHERE n >= greatest(12, 2 * median)""")
def _(df, spark, d):
    return dashboard.busy_days(df.filter(P.category("Calls")))


@query("longest_gap", ART + f", days AS (SELECT {DAY} AS day FROM art WHERE party = '9800000003' GROUP BY 1), g AS (SELECT lag(day) OVER (ORDER BY day) AS from_day, day AS to_day, datediff('day', lag(day) OVER (ORDER BY day)::DATE, day::DATE)::INTEGER AS days FROM days) SELECT * FROM g WHERE days > 2 ORDER BY days DESC, to_day LIMIT 1")
def _(df, spark, d):
    return dashboard.longest_gap(df.filter(P.party("9800000003")).filter("party = '9800000003'"))


@query("temporal_signs", f""", days AS (SELECT {DAY} AS day, count(*) AS n FROM art GROUP BY 1), hours AS (SELECT hour(make_timestamp(timestamp))::INTEGER AS hour, count(*) AS n FROM art GROUP BY 1)
 SELECT (SELECT count(*) FROM days) AS active_days, (SELECT round(sum(n) / count(*), 1) FROM days) AS rows_a_day, (SELECT day FROM days ORDER BY n DESC, day LIMIT 1) AS busiest_day,
 (SELECT max(n) FROM days) AS busiest_n, (SELECT hour FROM hours ORDER BY n DESC, hour LIMIT 1) AS peak_hour, (SELECT round(100 * sum(n) FILTER (WHERE hour < 6) / sum(n), 1) FROM hours) AS night_pct""")
def _(df, spark, d):
    return dashboard.signs(df)


@query("chart_daily", DAYS + "SELECT day, n, round(100 * n / max(n) OVER (), 1) AS pct FROM days")
def _(df, spark, d):
    return dashboard.normalised(df.groupBy(timex.day_of(F.col("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n")))


@query("dashboard_slices", """SELECT slice, label, count(*) AS n FROM (SELECT unnest(['category', 'app', 'direction', 'recovery', 'subtype', 'exhibit', 'month', 'confidence']) AS slice,
 unnest([category, app, direction, recovery, subtype, exhibit, strftime(make_timestamp(timestamp), '%Y-%m'), CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END]) AS label FROM art) GROUP BY ALL""")
def _(df, spark, d):
    return dashboard.slices(df)


@query("case_summary", """SELECT exhibit, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last, count(*) FILTER (WHERE category = 'Calls') AS calls, count(*) FILTER (WHERE category IN ('Messages', 'Chats')) AS messages,
 count(*) FILTER (WHERE category = 'Contacts') AS contacts, count(*) FILTER (WHERE recovery <> 'allocated') AS deleted, count(DISTINCT CASE WHEN category IN ('Calls', 'Messages') THEN party END) AS parties,
 CASE WHEN messages > 0 AND calls = 0 THEN 'no calls' WHEN messages > 0 AND contacts = 0 THEN 'no contacts' ELSE '' END AS gap FROM art GROUP BY exhibit""")
def _(df, spark, d):
    return dashboard.case_summary(df)


@query("owner_suggestions", """SELECT exhibit, party, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY exhibit ORDER BY n DESC, party) AS rank FROM (SELECT exhibit, party, count(*) AS n FROM comm WHERE direction = 'outgoing' GROUP BY 1, 2)) WHERE rank <= 3""")
def _(df, spark, d):
    return dashboard.owner_suggestions(df)


@query("recommendations", "SELECT 'comms_gap_contacts' AS step, 'high' AS severity, 1::INTEGER AS rank FROM (SELECT count(*) AS n FROM comm) WHERE n > 0 UNION ALL SELECT 'review_findings', 'medium', 2 FROM (SELECT count(*) AS n FROM comm WHERE recovery <> 'allocated') WHERE n > 0")
def _(df, spark, d):
    found = findings.findings(df, ["deleted.volume", "deleted.entire_thread", "correlate.asymmetric_deletion"])
    return dashboard.recommendations(dashboard.case_summary(df), dashboard.coverage(df), found)


@query("label_vote", """SELECT c_nationkey AS key, coalesce(n_name, (SELECT NULL), label) AS label FROM (SELECT c_nationkey, arg_min(c_mktsegment, (-n, c_mktsegment)) AS label
 FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1) LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 0) ON n_nationkey = c_nationkey""".replace("c_nationkey AS key", "c_nationkey::VARCHAR AS key"))
def _(df, spark, d):
    named = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("key"), F.col("c_mktsegment").alias("name"))
    saved = table(spark, d, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"))
    return graph.labelled(named, saved)


@query("pairs_within", """WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS weight FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2""")
def _(df, spark, d):
    return graph.pairs_within(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("graph_trimmed", TRADE + """, o AS (SELECT *, row_number() OVER (ORDER BY weight DESC, a, b) AS r FROM e WHERE weight >= 2),
 f AS (SELECT node FROM (SELECT node, min(r) AS r FROM (SELECT a AS node, r FROM o UNION ALL SELECT b, r FROM o) GROUP BY node) ORDER BY r, node LIMIT 60)
 SELECT a, b, weight, price FROM o WHERE a IN (SELECT node FROM f) AND b IN (SELECT node FROM f)""")
def _(df, spark, d):
    return graph.trimmed(trade(spark, d), 2, 60).select("a", "b", "weight", "price")


@query("top_contacts", OWNER + "SELECT exhibit, party, weight, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY exhibit ORDER BY weight DESC, party) AS rank FROM o) WHERE rank <= 20")
def _(df, spark, d):
    return graph.top_contacts(graph.owner_edges(df)).select("exhibit", "party", "weight", "rank")


NATIONS = TRADE + ", l AS (SELECT 'c' || c_custkey AS node, c_nationkey AS label FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier) "


def by_nation(spark: SparkSession, d: str) -> DataFrame:
    ends = (("customer", "c", "c_custkey", "c_nationkey"), ("supplier", "s", "s_suppkey", "s_nationkey"))
    return A.union(*(table(spark, d, t).select(F.concat(F.lit(x), k).alias("node"), F.col(n).alias("label")) for t, x, k, n in ends))


@query("modularity_of_nations", NATIONS + """, w AS (SELECT x.label AS la, y.label AS lb, weight FROM e JOIN l x ON x.node = a JOIN l y ON y.node = b),
 s AS (SELECT label, sum(weight) AS s FROM (SELECT la AS label, weight FROM w UNION ALL SELECT lb, weight FROM w) GROUP BY 1)
 SELECT round((SELECT sum(weight) FILTER (WHERE la = lb) / sum(weight) FROM w) - (SELECT sum(s::DOUBLE * s) FROM s) / pow(2 * (SELECT sum(weight) FROM w), 2), 6) AS q, (SELECT count(*) FROM s) AS communities""")
def _(df, spark, d):
    return graph.modularity(trade(spark, d), by_nation(spark, d)).select(F.round("q", 6).alias("q"), "communities")


@query("cohesion_of_nations", NATIONS + """, w AS (SELECT x.label AS la, y.label AS lb, weight FROM e JOIN l x ON x.node = a JOIN l y ON y.node = b),
 t AS (SELECT label, sum(weight)::BIGINT AS weight, coalesce(sum(weight) FILTER (WHERE within), 0)::BIGINT AS inside FROM (SELECT la AS label, weight, la = lb AS within FROM w UNION ALL SELECT lb, weight, false FROM w WHERE la <> lb) GROUP BY 1)
 SELECT label, size, weight, inside, round(inside / weight, 6) AS cohesion FROM (SELECT label, count(*) AS size FROM l GROUP BY 1) LEFT JOIN t USING (label)""")
def _(df, spark, d):
    return graph.community_report(trade(spark, d), by_nation(spark, d))


@query("telemetry_kinds", """SELECT exhibit, kind, in_use, count(*) AS n FROM (SELECT exhibit, CASE WHEN contains(lower(subtype), 'usage event') THEN 'usage' ELSE '' END AS kind,
 CASE WHEN contains(lower(subtype), 'usage event') THEN true END AS in_use FROM art) GROUP BY ALL""")
def _(df, spark, d):
    return fusion.classified(df).groupBy("exhibit", "kind", "in_use").agg(F.count(F.lit(1)).alias("n"))


FUSED = USAGE + """, v AS (SELECT artifact_id, bool_or(close AND same_app) AS both_, bool_or(close OR same_app) AS either FROM u GROUP BY artifact_id),
 ld AS (SELECT DISTINCT exhibit, timestamp // 86400000000 AS day FROM art WHERE category = 'User activity log'),
 ju AS (SELECT a.exhibit, a.recovery, CASE WHEN both_ THEN 'attributed' WHEN either THEN 'probable' WHEN ld.day IS NOT NULL THEN 'unattributed' ELSE 'unknown' END AS verdict
 FROM art a LEFT JOIN v USING (artifact_id) LEFT JOIN ld ON a.exhibit = ld.exhibit AND a.timestamp // 86400000000 = ld.day WHERE a.category IN ('Messages', 'Calls') AND a.direction = 'outgoing'),
 fu AS (SELECT exhibit, count(*) FILTER (WHERE verdict = 'attributed') AS sure, count(*) FILTER (WHERE verdict = 'attributed' AND recovery <> 'allocated') AS gone,
 count(*) FILTER (WHERE verdict = 'unattributed') AS idle, count(*) FILTER (WHERE verdict <> 'unknown') AS covered, count(*) AS n FROM ju WHERE exhibit IN (SELECT exhibit FROM ld) GROUP BY 1) """
FUSED_ROWS = """SELECT 'fusion.attributed_activity' AS rule_id, exhibit AS subject, sure AS n, CASE WHEN gone > 0 THEN 'high' ELSE 'medium' END AS severity FROM fu WHERE sure > 0
 UNION ALL SELECT 'fusion.unattributed_activity', exhibit, idle, 'medium' FROM fu WHERE idle > 0 UNION ALL SELECT 'fusion.low_coverage', exhibit, covered, 'info' FROM fu WHERE covered / n < 0.15"""


@query("fusion_findings", FUSED + FUSED_ROWS)
def _(df, spark, d):
    return findings.fused(df).select("rule_id", "subject", "n", "severity")


SIGNS = "list_transform(embedding, lambda x: CASE WHEN x > {0} THEN 1 ELSE 0 END)"
FAR = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INTEGER"


@query("perceptual_pairs", f"""WITH h AS (SELECT vec_id, {SIGNS.format('0')} AS a, {SIGNS.format('0.1')} AS d, {SIGNS.format('-0.1')} AS p FROM (SELECT vec_id, embedding FROM embeddings))
 SELECT x.vec_id AS id_a, y.vec_id AS id_b, {FAR.format('x.a', 'y.a')} AS far_a, {FAR.format('x.d', 'y.d')} AS far_d, {FAR.format('x.p', 'y.p')} AS far_p,
 CASE WHEN far_a = 0 AND far_d = 0 AND far_p = 0 THEN 'identical' WHEN (far_a <= 6)::INT + (far_d <= 6)::INT + (far_p <= 6)::INT >= 2 THEN 'near'
 WHEN (far_a <= 12)::INT + (far_d <= 12)::INT + (far_p <= 12)::INT >= 2 THEN 'similar' ELSE 'different' END AS verdict FROM h x JOIN h y ON y.vec_id = x.vec_id + 1""")
def _(df, spark, d):
    given = table(spark, d, "embeddings")
    bits = lambda least: F.conv(F.array_join(F.transform("embedding", lambda x: F.when(x > least, "1").otherwise("0")), ""), 2, -10).cast("long")
    h = given.select("vec_id", bits(0.0).alias("a"), bits(0.1).alias("d"), bits(-0.1).alias("p"))
    one, two = (h.select(F.col("vec_id").alias(f"id_{x}"), *(F.col(c).alias(f"{c}_{k}") for c in "adp")) for x, k in (("a", 1), ("b", 2)))
    return digests.perceptual(one.join(two, F.col("id_b") == F.col("id_a") + 1)).select("id_a", "id_b", "far_a", "far_d", "far_p", "verdict")


@query("screening_rates", """WITH s AS (""" + SQL["hashset_screen"] + """) SELECT count(*) AS files, count(*) FILTER (WHERE verdict = 'known-bad') AS bad, count(*) FILTER (WHERE verdict = 'known-good') AS good,
 round(count(*) FILTER (WHERE verdict = 'known-good') / count(*), 4) AS suppression FROM s""")
def _(df, spark, d):
    from .catalog import QUERIES

    return digests.screening_rates(QUERIES["hashset_screen"](spark, d))


@query("transcripts", """SELECT party, count(*) AS turns, sha256(string_agg(timestamp || ' ' || direction || ' ' || body, chr(10) ORDER BY timestamp, artifact_id)) AS digest FROM comm GROUP BY party, app, exhibit""")
def _(df, spark, d):
    line = F.transform("turns", lambda t: F.concat_ws(" ", t["timestamp"].cast("string"), t["direction"], t["body"]))
    return threads.transcript(findings.traffic(df)).select("party", F.size("turns").cast("long").alias("turns"), F.sha2(F.array_join(line, "\n"), 256).alias("digest"))


@query("scalar_text", """SELECT event_id, '+91' || (9800000000 + user_id) AS number, strftime(make_timestamp(epoch_us(ts) + 19800000000), '%Y-%m-%dT%H:%M:%S+05:30') AS local,
 regexp_replace(lower(hex(encode(event_type))), '(..)(?=.)', '\\1 ', 'g') AS bytes FROM events""".replace("regexp_replace(lower(hex(encode(event_type))), '(..)(?=.)', '\\1 ', 'g')", "rtrim(regexp_replace(lower(hex(encode(event_type))), '(..)', '\\1 ', 'g'))"))
def _(df, spark, d):
    e = table(spark, d, "events")
    number = F.concat(F.lit(" +91 (98) "), F.substring((F.lit(9800000000) + F.col("user_id")).cast("string"), 3, 8))
    return e.select("event_id", text.clean_number(number).alias("number"), timex.iso(timex.micros(F.col("ts")), 330).alias("local"), text.hex_dump(F.col("event_type")).alias("bytes"))


@query("text_context", """SELECT doc_id, CASE WHEN b > 1 THEN '…' ELSE '' END || substr(text, b, e - b) || CASE WHEN e <= length(text) THEN '…' ELSE '' END AS context FROM (
 SELECT doc_id, text, greatest(place - 60, 1) AS b, least(place + 8 + 60, length(text) + 1) AS e FROM (SELECT doc_id, text, strpos(lower(text), 'licensed') AS place FROM documents) WHERE place > 0)""")
def _(df, spark, d):
    found = table(spark, d, "documents").select("doc_id", text.context(F.col("text"), "licensed").alias("context"))
    return found.filter("context is not null")


@query("scalar_geo", """SELECT artifact_id, round((longitude + 180) / 360 * 1000, 6) AS x, round((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * 500, 6) AS y,
 (h // 360000) || '°' || (h % 360000 // 6000) || '''' || printf('%.2f', (h % 6000) / 100) || '"' || CASE WHEN latitude < 0 THEN 'S' ELSE 'N' END AS dms
 FROM (SELECT *, round(abs(latitude) * 360000)::BIGINT AS h FROM art)""")
def _(df, spark, d):
    x, y = geo.mercator(F.col("latitude"), F.col("longitude"), 1000, 500)
    return df.select("artifact_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), geo.dms(F.col("latitude"), "N", "S").alias("dms"))


#: SQL of each rule over art and comm: subject, n, and its severity.
RULE_SQL = {
    "deleted.volume": "SELECT exhibit AS subject, count(*) AS n, CASE WHEN count(*) > 20 THEN 'high' ELSE 'medium' END AS severity FROM comm WHERE recovery <> 'allocated' GROUP BY exhibit",
    "deleted.entire_thread": "SELECT party AS subject, count(*) AS n, 'high' AS severity FROM comm GROUP BY party, exhibit, app HAVING count(*) FILTER (WHERE recovery <> 'allocated') >= 3 AND count(*) FILTER (WHERE recovery = 'allocated') = 0",
    "pattern.burner": "SELECT party AS subject, count(timestamp) AS n, 'medium' AS severity FROM comm GROUP BY party, exhibit HAVING count(timestamp) >= 4 AND (max(timestamp) - min(timestamp)) / 86400000000 <= 14 AND count(timestamp) / greatest((max(timestamp) - min(timestamp)) / 86400000000, 0.5) >= 2",
    "pattern.nocturnal": "SELECT exhibit AS subject, count(*) FILTER (WHERE hour(make_timestamp(timestamp)) BETWEEN 1 AND 5) AS n, 'low' AS severity FROM comm GROUP BY exhibit HAVING count(*) >= 30 AND n >= 12 AND n / count(*) >= 0.22",
    "pattern.counter_forensic": "SELECT 'encrypt' AS subject, count(*) AS n, 'high' AS severity FROM comm WHERE regexp_matches(lower(body), '" + "|".join(p.replace("'", "''") for p in findings.HIDING) + "') HAVING count(*) > 0",
    "antiforensics.extension_mismatch": "SELECT app AS subject, count(*) AS n, 'medium' AS severity FROM art WHERE category = 'Files & Media' AND json_extract_string(attributes, '$.extension_mismatch') NOT IN ('', '0', 'false', 'null') GROUP BY app",
    "crosssource.notification_leak": "SELECT app AS subject, count(*) AS n, 'high' AS severity FROM art WHERE json_extract_string(attributes, '$.previews_encrypted_app') NOT IN ('', '0', 'false', 'null') GROUP BY app",
    "antiforensics.encrypted_artifacts": "SELECT app AS subject, count(*) AS n, 'medium' AS severity FROM art WHERE json_extract_string(attributes, '$.encrypted') NOT IN ('', '0', 'false', 'null') GROUP BY app",
    "location.cluster": CLUSTERS.replace("subject, n FROM", "subject, n, 'low' AS severity FROM", 1),
    "graph.one_way": "SELECT exhibit || '/' || party AS subject, count(*) AS n, 'low' AS severity FROM comm GROUP BY exhibit, party HAVING count(DISTINCT direction) = 1 AND count(*) >= 4",
    "pattern.dormant_reactivation": """SELECT party AS subject, rest AS n, 'low' AS severity FROM (SELECT *, row_number() OVER (PARTITION BY party ORDER BY gap DESC NULLS LAST, timestamp DESC, rest DESC) AS r, count(*) OVER (PARTITION BY party) AS total FROM
 (SELECT party, timestamp, timestamp - lag(timestamp) OVER (PARTITION BY party ORDER BY timestamp, artifact_id) AS gap, count(*) OVER (PARTITION BY party ORDER BY timestamp, artifact_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM comm))
 WHERE r = 1 AND total >= 8 AND gap >= 1814400000000 AND rest >= 4""",
    "activity.device_in_use": "SELECT exhibit AS subject, count(*) AS n, 'info' AS severity FROM art WHERE category = 'User activity log' GROUP BY exhibit HAVING count(*) >= 10",
    "integrity.timestamps": "SELECT app AS subject, count(*) AS n, 'info' AS severity FROM art WHERE timestamp < 1167609600000000 OR timestamp > 3000000000000000 GROUP BY app",
    "vivo.backup_exports": "SELECT source_path AS subject, count(*) AS n, 'info' AS severity FROM art WHERE contains(lower(source_path), 'vivo') GROUP BY 1",
    "correlate.shared_parties": "SELECT party AS subject, count(*) AS n, 'medium' AS severity FROM comm GROUP BY party HAVING count(DISTINCT exhibit) >= 2",
    "correlate.asymmetric_deletion": """SELECT party AS subject, sum(gone)::BIGINT AS n, 'high' AS severity FROM (SELECT party, exhibit, count(*) FILTER (WHERE recovery <> 'allocated') AS gone FROM comm GROUP BY 1, 2) GROUP BY party
 HAVING count(*) FILTER (WHERE gone > 0) BETWEEN 1 AND count(*) - 1""",
    "correlate.shared_media": "SELECT blob_sha256 AS subject, count(*) AS n, 'medium' AS severity FROM art WHERE blob_sha256 <> '' GROUP BY 1 HAVING count(DISTINCT exhibit) >= 2",
    "correlate.shared_locations": f"SELECT {CELL.format('latitude')} || ',' || {CELL.format('longitude')} AS subject, count(*) AS n, 'low' AS severity FROM art GROUP BY 1 HAVING count(DISTINCT exhibit) >= 2",
    "colocation.rendezvous": f"""SELECT exhibit_a || '/' || exhibit_b AS subject, count(*) AS n, CASE WHEN count(*) >= 3 AND count(DISTINCT strftime(make_timestamp(start), '%Y-%m-%d')) >= 3 THEN 'high' ELSE 'medium' END AS severity
 FROM rated GROUP BY exhibit_a, exhibit_b""",
    "conversation.channel_switching": "SELECT party AS subject, count(*) AS n, 'medium' AS severity FROM comm GROUP BY party HAVING count(DISTINCT CASE WHEN category <> 'Calls' THEN app END) >= 3 AND count(*) >= 4",
    "conversation.embedded_deletions": "SELECT exhibit || '/' || app || '/' || party AS subject, count(*) FILTER (WHERE recovery <> 'allocated') AS n, 'medium' AS severity FROM r GROUP BY party, app, exhibit HAVING bool_or(recovery <> 'allocated' AND pos > 0 AND pos < total - 1)",
    "conversation.rapid_exchange": "SELECT exhibit || '/' || app || '/' || party AS subject, count(*) AS n, 'low' AS severity FROM r GROUP BY party, app, exhibit HAVING count(*) >= 8 AND quantile_cont(reply::DOUBLE, 0.5) < 45000000",
}
COMMON = ART + THREADS + MET.replace(" q AS", " q AS", 1)

for rule_id, rule_sql in RULE_SQL.items():
    with_views = (THREADS if "FROM r " in rule_sql else "") + (MET if "rated" in rule_sql else "")

    @query("finding_" + rule_id.replace(".", "_"), ART + with_views + rule_sql)
    def _(df, spark, d, rule_id=rule_id):
        return findings.RULES[rule_id](df).select("subject", "n", "severity")


SQL["findings_ranked"] = (
    COMMON + FUSED.replace(", m AS", ", mu AS", 1).replace("FROM m)", "FROM mu)", 1)
    + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, subject, n, severity FROM ({s})" for k, s in RULE_SQL.items()) + " UNION ALL " + FUSED_ROWS + ")"
)

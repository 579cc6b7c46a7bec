"""Registered queries of the analytics operators with the SQL they must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text, timex
from ..operators import correlate, digests, entities, findings, fusion, graph, joins, places, threads, timeline
from ..sources.artifacts import artifacts, table
from . import predicates as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = timex.bound("2024-02-01")

ART = """WITH art AS (SELECT 'ev-' || event_id AS artifact_id, 'EXH-' || (event_id % 3) AS exhibit,
 CASE event_type WHEN 'purchase' THEN 'Messages' WHEN 'signup' THEN 'Calls' WHEN 'view' THEN 'Places' WHEN 'click' THEN 'Web' ELSE 'User activity log' END AS category,
 CASE WHEN event_type = 'error' THEN 'App usage event' ELSE event_type END AS subtype, epoch_us(ts) AS timestamp,
 CASE WHEN event_type = 'signup' THEN epoch_us(ts) + floor(value)::BIGINT * 1000000 END AS timestamp_end,
 CASE WHEN event_id % 2 = 0 THEN 'incoming' ELSE 'outgoing' END AS direction, 'app' || (user_id % 5) AS app, event_type AS body,
 CASE WHEN event_id % 10 = 0 THEN 'wal' ELSE 'allocated' END AS recovery,
 19 + json_extract_string(props, '$.k')::DOUBLE / 1000 AS latitude, 72 + json_extract_string(props, '$.k')::DOUBLE / 1000 AS longitude,
 CASE WHEN event_id % 10 = 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS confidence, (9800000000 + user_id)::VARCHAR AS party,
 props::VARCHAR AS attributes, 'events.parquet' AS source_path, 'events' AS source_table, event_id::BIGINT AS source_row, '' AS blob_sha256 FROM events),
comm AS (SELECT * FROM art WHERE category IN ('Calls', 'Messages', 'Chats'))
"""
DAY = "strftime(make_timestamp(timestamp), '%Y-%m-%d')"
CELL = "floor({0} * 100 + 0.5)::BIGINT"


def query(name: str, sql: str | None = None) -> Callable:
    """Register f(artifacts, spark, sf_dir) under a name; sql may begin with the view of artifacts."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, d: f(artifacts(spark, d), spark, d)
        if sql is not None:
            SQL[name] = ART + sql if re.search(r"\b(art|comm)\b", sql) and not sql.startswith("WITH") else sql
        return f

    return register


@query("filter_flagship", """ SELECT dimension, label, count(*) AS n FROM (SELECT unnest(['category', 'app', 'direction', 'recovery']) AS dimension,
 unnest([category, app, direction, recovery]) AS label FROM art WHERE category = 'Messages' AND recovery <> 'allocated' AND timestamp >= 1704844800000000) GROUP BY ALL""")
def _(df, spark, d):
    return timeline.facets(df.filter(P.category("messages") & P.deleted() & P.after("2024-01-10")))


@query("filter_party", "SELECT artifact_id, party, direction FROM art WHERE party = '9800000003' OR contains(party, '9800000003')")
def _(df, spark, d):
    return df.filter(P.party("+91 98000 00003")).select("artifact_id", "party", "direction")


@query("filter_span", """SELECT artifact_id, timestamp FROM art
 WHERE timestamp BETWEEN 1704931200000000 AND 1705190399999999 AND NOT (direction = 'incoming' AND app = 'app1')""")
def _(df, spark, d):
    return df.filter(P.span("2024-01-11..2024-01-13", NOW) & ~(P.direction("incoming") & P.like("app", "APP1"))).select("artifact_id", "timestamp")


@query("filter_has_confidence", "SELECT artifact_id, confidence FROM art WHERE latitude IS NOT NULL AND body <> '' AND confidence < 0.9")
def _(df, spark, d):
    return df.filter(P.has("gps") & P.has("body") & P.confidence("<", 0.9)).select("artifact_id", "confidence")


TOKENS = r"regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')"


@query("scan_word", f"SELECT doc_id, lang FROM documents WHERE list_contains({TOKENS}, 'eauouon')")
def _(df, spark, d):
    return table(spark, d, "documents").filter(P.word("text", "Éauouon")).select("doc_id", "lang")


@query("scan_phrase", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' the and attion ')")
def _(df, spark, d):
    return table(spark, d, "documents").filter(P.phrase("text", "the AND attion")).select("doc_id")


@query("keyword_scan", f"""SELECT term, count(*) AS docs, sum(hits)::BIGINT AS hits FROM (SELECT doc_id, term, len(list_filter({TOKENS}, lambda x: x = term)) AS hits
 FROM documents, (SELECT unnest(['the', 'licensed', 'leaux', 'und', 'que']) AS term)) WHERE hits > 0 GROUP BY term""")
def _(df, spark, d):
    terms = spark.createDataFrame([("the",), ("licensed",), ("leaux",), ("und",), ("que",)], "term string")
    found = table(spark, d, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term"))
    each = found.join(F.broadcast(terms), "term").groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("hits"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("hits").alias("hits"))


@query("topk_recent", "SELECT artifact_id, category, timestamp FROM art ORDER BY timestamp DESC NULLS LAST, artifact_id LIMIT 50")
def _(df, spark, d):
    return df.select("artifact_id", "category", "timestamp").orderBy(F.col("timestamp").desc_nulls_last(), "artifact_id").limit(50)


@query("body_summary", "SELECT conv_id, turn, CASE WHEN length(line) > 120 THEN substr(line, 1, 119) || '…' ELSE line END AS summary FROM (SELECT conv_id, turn, coalesce(nullif(trim(regexp_replace(coalesce(text, ''), '\\s*\\n\\s*', ' ', 'g')), ''), role) AS line FROM conversations)".replace("\\\\", "\\"))
def _(df, spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.summary(F.col("text"), F.col("role")).alias("summary"))


@query("facets", """SELECT dimension, label, count(*) AS n FROM (SELECT unnest(['category', 'app', 'direction', 'recovery']) AS dimension,
 unnest([category, app, direction, recovery]) AS label FROM art) GROUP BY ALL""")
def _(df, spark, d):
    return timeline.facets(df)


@query("overview", """SELECT count(*) AS total, count(timestamp) AS dated, min(timestamp) AS first, max(timestamp) AS last, count(*) FILTER (WHERE recovery <> 'allocated') AS deleted,
 count(latitude) AS located, count(*) FILTER (WHERE hour(make_timestamp(timestamp)) < 6) AS night FROM art""")
def _(df, spark, d):
    return timeline.overview(df)


@query("stats_hourly", """SELECT s.hour, count(art.artifact_id) AS n FROM (SELECT unnest(range(24)) AS hour) s
 LEFT JOIN art ON hour(make_timestamp(timestamp)) = s.hour GROUP BY s.hour""")
def _(df, spark, d):
    return timeline.hourly(df)


@query("stats_weekday", "SELECT dayofweek(make_timestamp(timestamp)) AS weekday, count(*) AS n FROM art GROUP BY 1")
def _(df, spark, d):
    return timeline.by_weekday(df)


@query("stats_daily", f"SELECT {DAY} AS day, count(*) AS n, count(*) FILTER (WHERE recovery <> 'allocated') AS deleted FROM art GROUP BY 1")
def _(df, spark, d):
    return timeline.by_day(df)


@query("heat_weekday_hour", "SELECT dayofweek(make_timestamp(timestamp)) AS weekday, hour(make_timestamp(timestamp)) AS hour, count(*) AS n FROM art GROUP BY 1, 2")
def _(df, spark, d):
    return timeline.heat(df)


@query("day_category_pivot", f"""SELECT {DAY} AS day, count(*) FILTER (WHERE category = 'Messages') AS Messages, count(*) FILTER (WHERE category = 'Calls') AS Calls,
 count(*) FILTER (WHERE category = 'Web') AS Web, count(*) FILTER (WHERE category = 'Places') AS Places,
 count(*) FILTER (WHERE category = 'User activity log') AS "User activity log" FROM art GROUP BY 1""")
def _(df, spark, d):
    return timeline.day_by_category(df, ["Messages", "Calls", "Web", "Places", "User activity log"])


for resolution, form in (("minute", "%Y-%m-%d %H:%M"), ("hour", "%Y-%m-%d %H:00"), ("week", "%G-W%V")):

    @query(f"buckets_{resolution}", f"SELECT strftime(make_timestamp(timestamp), '{form}') AS bucket, category, count(*) AS n FROM art GROUP BY 1, 2")
    def _(df, spark, d, resolution=resolution):
        return timeline.buckets(df, resolution)


@query("duration_bands", """SELECT CASE WHEN s < 10 THEN 'under 10 s' WHEN s < 60 THEN 'under 1 min' WHEN s < 300 THEN 'under 5 min' ELSE 'longer' END AS band, count(*) AS n
 FROM (SELECT (timestamp_end - timestamp) / 1000000 AS s FROM art WHERE timestamp_end IS NOT NULL) GROUP BY 1""")
def _(df, spark, d):
    return timeline.duration_bands(df)


@query("url_domains", r"SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS domain, count(*) AS n FROM pages GROUP BY 1")
def _(df, spark, d):
    pages = table(spark, d, "pages")
    return pages.groupBy(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1)).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


GAPS = """, g AS (SELECT *, timestamp - lag(timestamp) OVER w AS gap, lag(subtype) OVER w AS before FROM art WINDOW w AS (PARTITION BY party ORDER BY timestamp, artifact_id)),
 s AS (SELECT *, sum(CASE WHEN gap > 2700000000 THEN 1 ELSE 0 END) OVER (PARTITION BY party ORDER BY timestamp, artifact_id ROWS UNBOUNDED PRECEDING) AS session FROM g) """


@query("bursts", GAPS + "SELECT party, count(*) AS n, min(timestamp) AS start, max(timestamp) AS stop FROM s GROUP BY party, session HAVING count(*) >= 3 ")
def _(df, spark, d):
    return timeline.bursts(df)


@query("gaps", GAPS + "SELECT party, timestamp - gap AS start, timestamp AS stop, before, subtype AS after, gap AS gap_us FROM g WHERE gap >= 28800000000 ")
def _(df, spark, d):
    return timeline.gaps(df)


@query("anomalies", """, b AS (SELECT *, lag(timestamp) OVER (PARTITION BY app ORDER BY artifact_id) - timestamp > 3600000000 AS back FROM art)
 SELECT app, count(timestamp) AS n, count(*) FILTER (WHERE timestamp > 1706832000000000) AS future, count(*) FILTER (WHERE timestamp < 1167609600000000) AS early,
 count(*) FILTER (WHERE back) AS back, count(timestamp) >= 10 AND count(*) FILTER (WHERE back) > count(timestamp) * 0.05 AS disordered FROM b GROUP BY app """)
def _(df, spark, d):
    return timeline.anomalies(df, NOW)


@query("dormant_reactivation", """, g AS (SELECT party, exhibit, timestamp, timestamp - lag(timestamp) OVER (PARTITION BY party, exhibit ORDER BY timestamp, artifact_id) AS gap,
 count(*) OVER (PARTITION BY party, exhibit ORDER BY timestamp, artifact_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM comm)
 SELECT party, exhibit, n, gap_us, resumed, after FROM (SELECT party, exhibit, count(*) OVER (PARTITION BY party, exhibit) AS n, gap AS gap_us, timestamp AS resumed, rest AS after,
 row_number() OVER (PARTITION BY party, exhibit ORDER BY gap DESC NULLS LAST, timestamp DESC, rest DESC) AS r FROM g) WHERE r = 1 AND n >= 8 AND gap_us >= 604800000000 AND after >= 4 """)
def _(df, spark, d):
    # the table spans 30 days, so a week of silence is asked for in place of three
    return timeline.reactivated(findings.traffic(df), ["party", "exhibit"], gap_us=7 * timex.DAY_US)


THREADS = """, r AS (SELECT *, timestamp - lag(timestamp) OVER w AS silence, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY party, app, exhibit) AS total,
 first_value(direction) OVER w AS begun,
 CASE direction WHEN 'incoming' THEN min(CASE WHEN direction = 'outgoing' THEN timestamp END) OVER f WHEN 'outgoing' THEN min(CASE WHEN direction = 'incoming' THEN timestamp END) OVER f END - timestamp AS reply
 FROM comm WINDOW w AS (PARTITION BY party, app, exhibit ORDER BY timestamp, artifact_id),
 f AS (PARTITION BY party, app, exhibit ORDER BY timestamp, artifact_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) """


@query("thread_metrics", THREADS + """SELECT party, app, exhibit, count(*) AS turns, count(*) FILTER (WHERE direction = 'incoming') AS n_in, count(*) FILTER (WHERE direction = 'outgoing') AS n_out,
 count(*) FILTER (WHERE recovery <> 'allocated') AS n_deleted, coalesce(bool_or(recovery <> 'allocated' AND pos > 0 AND pos < total - 1), false) AS embedded_deletion,
 min(timestamp) AS first, max(timestamp) AS last, quantile_cont(reply::DOUBLE, 0.5) AS median_reply_us, min(reply) AS fastest_reply_us,
 max(CASE WHEN silence >= 21600000000 THEN silence END) AS silence_us, arg_max(timestamp, (silence, timestamp)) FILTER (WHERE silence >= 21600000000) AS silence_ended,
 any_value(begun) AS begun, least(count(*) FILTER (WHERE direction = 'incoming'), count(*) FILTER (WHERE direction = 'outgoing'))
 / greatest(count(*) FILTER (WHERE direction = 'incoming'), count(*) FILTER (WHERE direction = 'outgoing')) AS reciprocity FROM r GROUP BY party, app, exhibit """)
def _(df, spark, d):
    return threads.metrics(findings.traffic(df))


@query("reply_latency", THREADS + "SELECT artifact_id, direction, reply AS reply_us FROM r ")
def _(df, spark, d):
    return threads.replies(findings.traffic(df)).select("artifact_id", "direction", "reply_us")


@query("relationships", """SELECT party, count(*) AS n, count(DISTINCT CASE WHEN category <> 'Calls' THEN app END) AS channels, count(DISTINCT exhibit) AS exhibits,
 count(*) FILTER (WHERE category = 'Calls') AS calls, min(timestamp) AS first, max(timestamp) AS last FROM comm GROUP BY party""")
def _(df, spark, d):
    return threads.relationships(findings.traffic(df))


@query("chat_shapes", """SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS n_in, count(*) FILTER (WHERE role = 'assistant') AS n_out,
 sum(length(text))::BIGINT AS chars, max(length(text)) AS longest, arg_min(role, turn) AS begun FROM conversations GROUP BY conv_id""")
def _(df, spark, d):
    return threads.chat_shapes(table(spark, d, "conversations"))


PRESENCE = """, pp AS (SELECT artifact_id, exhibit, timestamp, latitude, longitude, round((CASE WHEN category = 'Places' THEN 1.0 ELSE 0.8 END)::DOUBLE * greatest(0.1, confidence), 3) AS weight FROM art
 WHERE (category = 'Places' OR (category = 'Messages' AND direction = 'outgoing')) AND latitude IS NOT NULL),
 h AS (SELECT *, 2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))) AS metres,
 a.artifact_id AS artifact_id_a, b.artifact_id AS artifact_id_b, abs(a.timestamp - b.timestamp) AS apart
 FROM pp a JOIN pp b ON a.exhibit < b.exhibit AND abs(a.timestamp - b.timestamp) <= 900000000) """


@query("presence_points", PRESENCE + "SELECT * FROM pp ")
def _(df, spark, d):
    return places.presence(df)


@query("colocation_hits", PRESENCE + "SELECT artifact_id_a, artifact_id_b, round(metres, 3) AS metres, apart FROM h WHERE metres <= 500 ")
def _(df, spark, d):
    hits = places.meetings(places.presence(df))
    apart = F.abs(F.col("timestamp_a") - F.col("timestamp_b")).alias("apart")
    return hits.select("artifact_id_a", "artifact_id_b", F.round("metres", 3).alias("metres"), apart)


METRES = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2))))"
MET = PRESENCE + f""", q AS (SELECT a_ex, b_ex, artifact_id_a, artifact_id_b, metres, apart, w, mid, lat, lon FROM (SELECT a.exhibit AS a_ex, b.exhibit AS b_ex, a.artifact_id AS artifact_id_a, b.artifact_id AS artifact_id_b,
 abs(a.timestamp - b.timestamp) AS apart, least(a.weight, b.weight) AS w, (a.timestamp + b.timestamp) // 2 AS mid, (a.latitude + b.latitude) / 2 AS lat, (a.longitude + b.longitude) / 2 AS lon,
 {METRES.format('a.latitude', 'b.latitude', 'a.longitude', 'b.longitude')} AS metres FROM pp a JOIN pp b ON a.exhibit < b.exhibit AND abs(a.timestamp - b.timestamp) <= 900000000) WHERE metres <= 500),
 z AS (SELECT *, CASE WHEN mid - lag(mid) OVER v > 900000000 OR {METRES.format('lag(lat) OVER v', 'lat', 'lag(lon) OVER v', 'lon')} > 500 THEN 1 ELSE 0 END AS fresh FROM q
  WINDOW v AS (PARTITION BY a_ex, b_ex ORDER BY mid, artifact_id_a, artifact_id_b)),
 y AS (SELECT *, sum(fresh) OVER (PARTITION BY a_ex, b_ex ORDER BY mid, artifact_id_a, artifact_id_b ROWS UNBOUNDED PRECEDING)::BIGINT AS encounter FROM z),
 enc AS (SELECT a_ex AS exhibit_a, b_ex AS exhibit_b, encounter, count(*) AS hits, min(mid) AS start, max(mid) AS stop, min(metres) AS nearest_m, min(apart) AS closest_us, min(w) AS weight FROM y GROUP BY 1, 2, 3),
 rated AS (SELECT *, least(0.95::DOUBLE, 0.45::DOUBLE + 0.20::DOUBLE * (1 - nearest_m / 500) + 0.15::DOUBLE * (1 - closest_us / 900000000) + least(0.15::DOUBLE, 0.03::DOUBLE * (hits - 1))) * weight AS confidence FROM enc) """


def met_in(df: DataFrame) -> DataFrame:
    return places.encounters_of(places.presence(df))


@query("encounters", MET + "SELECT exhibit_a, exhibit_b, encounter, hits, start, stop, round(nearest_m, 3) AS nearest_m, closest_us, weight, round(confidence, 3) AS confidence FROM rated")
def _(df, spark, d):
    return met_in(df).withColumns({"nearest_m": F.round("nearest_m", 3), "confidence": F.round("confidence", 3)})


@query("pair_summary", MET + f"""SELECT exhibit_a, exhibit_b, encounters, days, CASE WHEN encounters >= 8 AND days >= 5 THEN 'travelling' WHEN encounters >= 3 AND days >= 3 THEN 'repeated' ELSE 'single' END AS kind
 FROM (SELECT exhibit_a, exhibit_b, count(*) AS encounters, count(DISTINCT strftime(make_timestamp(start), '%Y-%m-%d')) AS days FROM rated GROUP BY 1, 2)""")
def _(df, spark, d):
    return places.pair_summary_of(places.presence(df)).drop("confidence")


@query("geo_grid", f"""SELECT {CELL.format('latitude')} AS y, {CELL.format('longitude')} AS x, count(*) AS n, count(DISTINCT exhibit) AS exhibits, count(DISTINCT {DAY}) AS days,
 min(timestamp) AS first, max(timestamp) AS last FROM art WHERE latitude IS NOT NULL GROUP BY 1, 2""")
def _(df, spark, d):
    return places.grid(df)


@query("daily_tracks", f""", st AS (SELECT exhibit, {DAY} AS day, {METRES.format('lag(latitude) OVER v', 'latitude', 'lag(longitude) OVER v', 'longitude')} AS step FROM art
 WINDOW v AS (PARTITION BY exhibit, {DAY} ORDER BY timestamp, artifact_id)) SELECT exhibit, day, count(*) AS n, round(sum(step), 0) AS metres FROM st GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(df, spark, d):
    return places.tracks(df).withColumn("metres", F.round("metres", 0))


USAGE = """, m AS (SELECT a.artifact_id, l.artifact_id AS usage_id, abs(a.timestamp - l.timestamp) AS away_us, abs(a.timestamp - l.timestamp) <= 120000000 AS close, a.app = l.app AS same_app
 FROM art a JOIN art l ON a.exhibit = l.exhibit AND l.category = 'User activity log' AND abs(a.timestamp - l.timestamp) <= 900000000
 WHERE a.category IN ('Messages', 'Calls') AND a.direction = 'outgoing'),
 u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY close DESC, same_app DESC, away_us, usage_id) AS rank FROM m) WHERE rank <= 6) """


@query("fuse_usage", USAGE + "SELECT * FROM u ")
def _(df, spark, d):
    return fusion.usage(fusion.acts(df), fusion.telemetry(df))


@query("fuse_nearest", """, a AS (SELECT artifact_id, exhibit, timestamp FROM art WHERE category IN ('Messages', 'Calls') AND direction = 'outgoing'),
 p AS (SELECT artifact_id AS place, exhibit, timestamp FROM art WHERE category = 'Places'),
 b AS (SELECT a.artifact_id, max(p.timestamp) AS before, arg_min(place, (-p.timestamp, place)) AS before_id FROM a JOIN p ON a.exhibit = p.exhibit AND p.timestamp BETWEEN a.timestamp - 900000000 AND a.timestamp GROUP BY ALL),
 f AS (SELECT a.artifact_id, min(p.timestamp) AS after, arg_min(place, (p.timestamp, place)) AS after_id FROM a JOIN p ON a.exhibit = p.exhibit AND p.timestamp BETWEEN a.timestamp AND a.timestamp + 900000000 GROUP BY ALL)
 SELECT a.artifact_id, b.before, b.before_id, f.after, f.after_id FROM a LEFT JOIN b USING (artifact_id) LEFT JOIN f USING (artifact_id) """)
def _(df, spark, d):
    near = fusion.nearest_places(fusion.acts(df), df.filter(P.category("Places")))
    parts = (F.col(f"{side}.{a}").alias(b) for side in ("before", "after") for a, b in (("time", side), ("value", f"{side}_id")))
    return near.select("artifact_id", *parts)


@query("attribution_summary", USAGE + """, v AS (SELECT artifact_id, bool_or(close AND same_app) AS both_, bool_or(close OR same_app) AS either FROM u GROUP BY artifact_id),
 l AS (SELECT DISTINCT exhibit, timestamp // 86400000000 AS day FROM art WHERE category = 'User activity log')
 SELECT a.exhibit, CASE WHEN both_ THEN 'attributed' WHEN either THEN 'probable' WHEN l.day IS NOT NULL THEN 'unattributed' ELSE 'unknown' END AS verdict, count(*) AS n
 FROM art a LEFT JOIN v USING (artifact_id) LEFT JOIN l ON a.exhibit = l.exhibit AND a.timestamp // 86400000000 = l.day
 WHERE a.category IN ('Messages', 'Calls') AND a.direction = 'outgoing' GROUP BY 1, 2 """)
def _(df, spark, d):
    act, log = fusion.acts(df), fusion.telemetry(df)
    return fusion.summary(fusion.verdicts(act, fusion.usage(act, log), log))


OWNER = """, o AS (SELECT exhibit, party, count(*) AS weight, count(*) FILTER (WHERE category = 'Calls') AS calls, count(*) FILTER (WHERE category <> 'Calls') AS messages,
 count(*) FILTER (WHERE direction = 'outgoing') AS sent, count(*) FILTER (WHERE direction = 'incoming') AS received, count(DISTINCT app) AS apps,
 min(timestamp) AS first, max(timestamp) AS last, coalesce(sum(timestamp_end - timestamp), 0)::BIGINT AS talk_us FROM comm GROUP BY exhibit, party) """


@query("graph_owner_edges", OWNER + "SELECT *, least(sent, received) / greatest(sent, received) AS reciprocity FROM o ")
def _(df, spark, d):
    return graph.owner_edges(df)


@query("graph_one_way", OWNER + "SELECT exhibit, party, weight FROM o WHERE least(sent, received) = 0 AND greatest(sent, received) >= 2 ")
def _(df, spark, d):
    return graph.one_way(graph.owner_edges(df), 2).select("exhibit", "party", "weight")


TRADE = """WITH e AS (SELECT 'c' || o_custkey AS a, 's' || l_suppkey AS b, count(*) AS weight, round(sum(l_extendedprice), 2) AS price
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) """


def trade(spark: SparkSession, d: str) -> DataFrame:
    met = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    met = met.select(F.concat(F.lit("c"), "o_custkey").alias("x"), F.concat(F.lit("s"), "l_suppkey").alias("y"), "l_extendedprice")
    return graph.edges(met, "x", "y", [F.round(F.sum("l_extendedprice"), 2).alias("price")])


@query("graph_edges", TRADE + "SELECT * FROM e")
def _(df, spark, d):
    return trade(spark, d)


@query("graph_degree", TRADE + "SELECT node, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT a AS node, weight FROM e UNION ALL SELECT b, weight FROM e) GROUP BY node")
def _(df, spark, d):
    return graph.degrees(trade(spark, d))


def nation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Nations of customers and of suppliers, joined where they deal more than the average pair: all of the trade, on up to 50 nodes."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").count()
    met = lines.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = met.groupBy(F.concat(F.lit("c"), "c_nationkey").alias("a"), F.concat(F.lit("s"), "s_nationkey").alias("b")).agg(F.sum("count").alias("weight"))
    return joins.beside(e, e.agg(F.avg("weight").alias("mean"))).filter("weight > mean").select("a", "b", "weight")


@query("graph_components", TRADE.replace("WITH e", "WITH RECURSIVE e", 1) + """, two AS (SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e),
 cc(node, root) USING KEY (node) AS (SELECT DISTINCT node, node AS root FROM two UNION
 SELECT two.node, min(cc.root) FROM cc JOIN two ON cc.node = two.other JOIN recurring.cc AS known ON known.node = two.node WHERE cc.root < known.root GROUP BY two.node)
 SELECT node, root FROM cc""")
def _(df, spark, d):
    return graph.components(trade(spark, d))


def between_sql(depth: int = 10) -> str:
    """All distances and numbers of shortest paths, a step at a time, then the share of the paths of each pair that pass a node."""
    steps = [
        f"""d{k} AS MATERIALIZED (SELECT * FROM d{k - 1} UNION ALL SELECT f.s, two.other, {k}, sum(f.p) FROM d{k - 1} f JOIN two ON f.t = two.node WHERE f.d = {k - 1}
 AND NOT EXISTS (SELECT 1 FROM d{k - 1} x WHERE x.s = f.s AND x.t = two.other) GROUP BY f.s, two.other)""" for k in range(1, depth + 1)
    ]
    return f"""WITH t AS (SELECT 'c' || c_nationkey AS a, 's' || s_nationkey AS b, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), e AS (SELECT * FROM t WHERE weight > (SELECT avg(weight) FROM t)),
 two AS (SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e), nodes AS (SELECT DISTINCT node FROM two),
 d0 AS MATERIALIZED (SELECT node AS s, node AS t, 0 AS d, 1::DOUBLE AS p FROM nodes), {', '.join(steps)},
 v AS (SELECT a.t AS node, sum(a.p * b.p / c.p) AS share FROM d{depth} a JOIN d{depth} b ON a.t = b.s JOIN d{depth} c ON c.s = a.s AND c.t = b.t
 WHERE a.s <> a.t AND b.s <> b.t AND c.d = a.d + b.d GROUP BY 1)
 SELECT node, round(coalesce(share, 0) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2), 5) AS betweenness FROM nodes LEFT JOIN v USING (node)"""


@query("graph_betweenness", between_sql())
def _(df, spark, d):
    return graph.betweenness(nation_edges(spark, d))


SPOKEN = f"""WITH e AS (SELECT 'c' || conv_id AS a, 'w' || w AS b, count(*) AS weight FROM (SELECT conv_id, unnest({TOKENS}) AS w FROM conversations) GROUP BY 1, 2),
 two AS (SELECT a AS node, b AS other, weight, 0 AS colour FROM e UNION ALL SELECT b, a, weight, 1 FROM e), l0 AS (SELECT DISTINCT node, colour, node AS label FROM two) """


def sweeps_sql(sweeps: int = 12) -> str:
    """Labels after so many sweeps over the two kinds of nodes in turn; more sweeps than are needed change nothing."""
    steps = [
        f"""l{k + 1} AS MATERIALIZED (SELECT l.node, l.colour, coalesce(v.label, l.label) AS label FROM l{k} l LEFT JOIN (
 SELECT node, label FROM (SELECT t.node, o.label, row_number() OVER (PARTITION BY t.node ORDER BY sum(t.weight) DESC, o.label <> any_value(m.label), o.label) AS r
  FROM two t JOIN l{k} o ON t.other = o.node JOIN l{k} m ON t.node = m.node WHERE t.colour = {k % 2} GROUP BY t.node, o.label) WHERE r = 1) v USING (node))""" for k in range(2 * sweeps)
    ]
    return f"{SPOKEN}, {', '.join(steps)}, s AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS community FROM l{2 * sweeps} GROUP BY label), n AS (SELECT node, label, community FROM l{2 * sweeps} JOIN s USING (label)) "


def spoken(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Conversations and their words as a graph, weighted by occurrences, and the two kinds of nodes as its colours: conversations first."""
    words = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("x"), F.explode(text.tokens(F.col("text"))).alias("w"))
    e = graph.checkpointed(graph.edges(words.select("x", F.concat(F.lit("w"), "w").alias("y")), "x", "y"))  # read time and again
    ends = e.select("a").distinct().select(F.col("a").alias("node"), F.lit(0).alias("colour")).unionByName(e.select("b").distinct().select(F.col("b").alias("node"), F.lit(1).alias("colour")))
    return e, ends


@query("graph_communities", sweeps_sql() + "SELECT * FROM n")
def _(df, spark, d):
    return graph.communities(*spoken(spark, d))


@query("community_report", sweeps_sql() + """, w AS (SELECT x.community AS ca, y.community AS cb, weight FROM e JOIN n x ON e.a = x.node JOIN n y ON e.b = y.node),
 ends AS (SELECT ca AS community, weight, ca = cb AS within FROM w UNION ALL SELECT cb, weight, false FROM w WHERE ca <> cb)
 SELECT community, size, weight, inside, round(inside / weight, 6) AS cohesion FROM (SELECT community, count(*) AS size FROM n GROUP BY 1)
 JOIN (SELECT community, sum(weight)::BIGINT AS weight, coalesce(sum(weight) FILTER (WHERE within), 0)::BIGINT AS inside FROM ends GROUP BY 1) USING (community)""")
def _(df, spark, d):
    e, colours = spoken(spark, d)
    labels = graph.communities(e, colours).select("node", F.col("community").alias("label"))
    return graph.community_report(e, labels).withColumnRenamed("label", "community")


@query("communities_meaningful", sweeps_sql() + """, d AS (SELECT community, sum(weight) AS s FROM (SELECT a AS node, weight FROM e UNION ALL SELECT b, weight FROM e) JOIN n USING (node) GROUP BY 1),
 q AS (SELECT (SELECT sum(weight) FROM e JOIN n x ON e.a = x.node JOIN n y ON e.b = y.node WHERE x.community = y.community) / (SELECT sum(weight) FROM e)
  - (SELECT sum(s::DOUBLE * s) FROM d) / pow(2 * (SELECT sum(weight) FROM e), 2) AS q, (SELECT count(*) FROM d) AS communities) SELECT round(q, 6) AS q, communities, q >= 0.3 AND communities >= 2 AS meaningful FROM q""")
def _(df, spark, d):
    e, colours = spoken(spark, d)
    return graph.meaningful(e, graph.communities(e, colours).select("node", "label")).withColumn("q", F.round("q", 6))


@query("shared_parties", """, e AS (SELECT party, exhibit, count(*) AS k FROM comm GROUP BY 1, 2)
 SELECT party, count(*) AS shared_by, sum(k)::BIGINT AS n FROM e GROUP BY party HAVING count(*) >= 2 """)
def _(df, spark, d):
    return correlate.shared(findings.traffic(df), "party")


@query("shared_media", """SELECT digest, count(DISTINCT source) AS shared_by, count(*) AS n FROM (SELECT sha256(text) AS digest, source FROM documents)
 GROUP BY digest HAVING count(DISTINCT source) >= 2""")
def _(df, spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "source")
    return correlate.shared(docs, "digest", "source")


@query("shared_cells", f"""SELECT {CELL.format('latitude')} || ',' || {CELL.format('longitude')} AS cell, count(DISTINCT exhibit) AS shared_by, count(*) AS n
 FROM art GROUP BY 1 HAVING count(DISTINCT exhibit) >= 2""")
def _(df, spark, d):
    return correlate.shared_cells(df)


@query("asymmetric_deletion", """, e AS (SELECT party, exhibit, count(*) FILTER (WHERE recovery <> 'allocated') AS gone FROM comm GROUP BY 1, 2)
 SELECT party, count(*) AS exhibits, count(*) FILTER (WHERE gone > 0) AS deleted_on, sum(gone)::BIGINT AS deleted FROM e GROUP BY party
 HAVING count(*) FILTER (WHERE gone > 0) BETWEEN 1 AND count(*) - 1 """)
def _(df, spark, d):
    return correlate.asymmetric_deletion(findings.traffic(df))


EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]{2,}"
URL = r"(?i:https?://[^\s<>\"'')]+|www\.[^\s<>\"'')]+)"
SCHEMAS = r"(?i)(schemas\.|w3\.org|apple\.com/DTDs|android\.com|googleapis\.com/auth|\.xsd|purl\.org|ns\.adobe\.com)"


def mentioned(kind: str, pattern: str, extra: str = "true") -> str:
    """SQL of the mentions of a kind that claims no span."""
    return f"""SELECT value, count(*) AS n, count(DISTINCT doc_id) AS rows FROM (
 SELECT doc_id, lower(unnest(regexp_extract_all(text, '{pattern}'))) AS value FROM documents) WHERE {extra} GROUP BY value"""


for kind, pattern, extra in (("email", EMAIL, "true"), ("url", URL, f"NOT regexp_matches(value, '{SCHEMAS}')")):

    @query(f"entity_{kind}", mentioned(kind, pattern, extra))
    def _(df, spark, d, kind=kind):
        found = entities.mentions(table(spark, d, "documents"), "doc_id", "text", tuple(k for k in entities.KINDS if k.name == kind))
        return entities.aggregate(found, "doc_id").select("value", "n", "rows")


@query("entities")
def _(df, spark, d):
    return entities.aggregate(entities.mentions(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query("hashset_screen", """WITH bad AS (SELECT DISTINCT sha256(text) AS digest FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
 good AS (SELECT DISTINCT sha256(text) AS digest FROM documents JOIN labels USING (doc_id) WHERE toxic = 0)
 SELECT doc_id, CASE WHEN bad.digest IS NOT NULL THEN 'known-bad' WHEN good.digest IS NOT NULL THEN 'known-good' ELSE 'unknown' END AS verdict
 FROM (SELECT doc_id, sha256(text) AS digest FROM documents) d LEFT JOIN bad ON d.digest = bad.digest LEFT JOIN good ON d.digest = good.digest """)
def _(df, spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    kind = F.when(F.col("toxic") == 1, "known-bad").otherwise("known-good").alias("kind")
    sets = docs.join(table(spark, d, "labels").filter("toxic is not null"), "doc_id").select("digest", kind, F.lit("labels").alias("set_name"), F.lit("").alias("label"))
    return digests.screen(docs, sets, "doc_id").select("doc_id", "verdict")


@query("hamming_pairs", """WITH h AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE embedding IS NOT NULL)
 SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_sum(list_transform(range(1, len(a.b) + 1), lambda i: CASE WHEN a.b[i] <> b.b[i] THEN 1 ELSE 0 END))::INTEGER AS distance
 FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE list_sum(list_transform(range(1, len(a.b) + 1), lambda i: CASE WHEN a.b[i] <> b.b[i] THEN 1 ELSE 0 END)) <= 6""")
def _(df, spark, d):
    """All pairs of near ids, copies among them: a class of m equal hashes is m (m - 1) / 2 pairs."""
    return digests.near_hashes(digests.sign_hash(table(spark, d, "embeddings"), "vec_id", "embedding"), "vec_id")


@query("merkle_root", """WITH RECURSIVE l0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS i, h FROM (SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL)),
 lv(n, i, h) AS (SELECT (SELECT count(*) FROM l0), i, h FROM l0 UNION ALL SELECT (n + 1) // 2, i // 2, sha256(h || other) FROM
 (SELECT n, i, h, coalesce(lead(h) OVER (ORDER BY i), h) AS other FROM lv WHERE n > 1) WHERE i % 2 = 0) SELECT h AS root FROM lv WHERE n = 1""")
def _(df, spark, d):
    return digests.merkle_root(table(spark, d, "documents").select(F.sha2("text", 256).alias("h")), "h")


@query("rule_burner", """SELECT party AS subject, count(timestamp) AS n FROM comm GROUP BY party, exhibit
 HAVING count(timestamp) >= 4 AND (max(timestamp) - min(timestamp)) / 86400000000 <= 14 AND count(timestamp) / greatest((max(timestamp) - min(timestamp)) / 86400000000, 0.5) >= 2""")
def _(df, spark, d):
    return findings.burner(df).select("subject", "n")


@query("rule_entire_thread", "SELECT party AS subject, count(*) FILTER (WHERE recovery <> 'allocated') AS n FROM comm GROUP BY party, exhibit, app HAVING count(*) FILTER (WHERE recovery <> 'allocated') >= 3 AND count(*) FILTER (WHERE recovery = 'allocated') = 0")
def _(df, spark, d):
    return findings.entire_thread(df).select("subject", "n")


@query("rule_nocturnal", """SELECT exhibit AS subject, count(*) FILTER (WHERE hour(make_timestamp(timestamp)) BETWEEN 1 AND 5) AS n FROM comm GROUP BY exhibit
 HAVING count(*) >= 30 AND n >= 12 AND n / count(*) >= 0.22""")
def _(df, spark, d):
    return findings.nocturnal(df).select("subject", "n")


CLUSTERS = f"""SELECT exhibit || '/' || cell AS subject, n FROM (SELECT exhibit, cell, n, days, row_number() OVER (PARTITION BY exhibit ORDER BY n DESC, cell) AS rank, sum(n) OVER (PARTITION BY exhibit) AS points
 FROM (SELECT exhibit, {CELL.format('latitude')} || ',' || {CELL.format('longitude')} AS cell, count(*) AS n, count(DISTINCT {DAY}) AS days FROM art GROUP BY 1, 2))
 WHERE points >= 10 AND rank BETWEEN 2 AND 6 AND n >= 4 AND days >= 2"""


@query("rule_location_cluster", CLUSTERS)
def _(df, spark, d):
    return findings.location_cluster(df).select("subject", "n")


@query("findings_ranked")
def _(df, spark, d):
    # written once, as each rule reads a few columns of all rows
    return findings.findings(graph.checkpointed(df)).select("rule_id", "subject", "n", "severity")


@query("confusion_by_lang", """WITH p AS (SELECT lang, quality = 0 AS truth, len(regexp_extract_all(text, '[#*$%&|<>]')) * 10 > length(text) AS predicted FROM documents JOIN labels USING (doc_id)),
 c AS (SELECT lang, count(*) FILTER (WHERE truth AND predicted) AS tp, count(*) FILTER (WHERE NOT truth AND predicted) AS fp, count(*) FILTER (WHERE truth AND NOT predicted) AS fn FROM p GROUP BY lang)
 SELECT lang, tp, fp, fn, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS precision, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c """)
def _(df, spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    predicted = F.regexp_count("text", F.lit(r"[#*$%&|<>]")) * 10 > F.length("text")
    return findings.confusion(docs, F.col("quality") == 0, predicted, "lang")


@query("party_keys", "SELECT DISTINCT user_id, (9800000000 + user_id)::VARCHAR AS k1, (9800000000 + user_id)::VARCHAR AS k2, 'u' || user_id || '@example.com' AS k3 FROM events")
def _(df, spark, d):
    e = table(spark, d, "events").select("user_id").distinct()
    phone = F.concat(F.lit("+91 "), (F.lit(9800000000) + F.col("user_id")).cast("string"))
    return e.select(
        "user_id", keys.party_key(phone).alias("k1"), keys.correlation_key(F.concat(phone, F.lit("@s.whatsapp.net"))).alias("k2"),
        keys.graph_key(F.concat(F.lit("U"), "user_id", F.lit("@Example.com/x")), F.lit(False)).alias("k3"),
    )

"""Registered queries of the whole dashboard, of what to look at and do next, and of findings from more than artifacts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboard, digests, findings, graph, participants, timeline
from ..sources import artifacts as A
from ..sources.artifacts import table
from .catalog import query, spoken, sweeps_sql
from .networks import ORDERS, group_messages

EVERY = """WITH ev AS (SELECT 'ev-' || event_id AS artifact_id, 'EXH-' || (event_id % 3) AS exhibit,
  CASE event_type WHEN 'purchase' THEN 'Messages' WHEN 'signup' THEN 'Calls' WHEN 'view' THEN 'Places' WHEN 'click' THEN 'Web' ELSE 'User activity log' END AS category,
  CASE WHEN event_type = 'error' THEN 'App usage event' ELSE event_type END AS subtype, epoch_us(ts) AS timestamp, CASE WHEN event_type = 'signup' THEN floor(value)::BIGINT END AS seconds,
  CASE WHEN event_id % 2 = 0 THEN 'incoming' ELSE 'outgoing' END AS direction, 'app' || (user_id % 5) AS app, event_type AS body, CASE WHEN event_id % 10 = 0 THEN 'wal' ELSE 'allocated' END AS recovery,
  19 + json_extract_string(props, '$.k')::DOUBLE / 1000 AS latitude, 72 + json_extract_string(props, '$.k')::DOUBLE / 1000 AS longitude, '' AS domain, '' AS payload FROM events),
 e AS (SELECT artifact_id, category, subtype, timestamp, seconds, direction, app, body, latitude, longitude, domain, payload FROM ev
  UNION ALL SELECT 'doc-' || doc_id, 'Files & Media', 'Document', NULL, NULL, 'unknown', coalesce(source, ''), coalesce(text, ''), NULL, NULL, '', sha256(text) FROM documents
  UNION ALL SELECT 'page-' || page_id, 'Web', 'Page', NULL, NULL, 'unknown', '', coalesce(url, ''), NULL, NULL, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '' FROM pages
  UNION ALL SELECT 'net-' || n_nationkey, 'Networks', '', NULL, NULL, 'unknown', '', n_name, NULL, NULL, '', '' FROM nation
  UNION ALL SELECT 'acc-' || c_custkey, 'Accounts', '', NULL, NULL, 'unknown', c_mktsegment, '', NULL, NULL, '', '' FROM customer) """


def everything(spark: SparkSession, d: str) -> DataFrame:
    """Events, documents, pages as visits, nations as networks and customers as accounts: a stated projection that fills every tile."""
    pages = table(spark, d, "pages")
    domain = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]+)", 1))
    visits = A.in_schema(pages, artifact_id=F.concat(F.lit("page-"), "page_id"), category=F.lit("Web"), subtype=F.lit("Page"), body=F.coalesce("url", F.lit("")), attributes=F.to_json(F.struct(domain.alias("domain"))), source_row=F.col("page_id").cast("long"))
    networks = A.in_schema(table(spark, d, "nation"), artifact_id=F.concat(F.lit("net-"), "n_nationkey"), category=F.lit("Networks"), body=F.col("n_name"), source_row=F.col("n_nationkey").cast("long"))
    accounts = A.in_schema(table(spark, d, "customer"), artifact_id=F.concat(F.lit("acc-"), "c_custkey"), category=F.lit("Accounts"), app=F.col("c_mktsegment"), source_row=F.col("c_custkey").cast("long"))
    return A.union(A.artifacts(spark, d), A.from_documents(table(spark, d, "documents")), visits, networks, accounts)


TILES = """SELECT tile, label, artifact_id FROM (SELECT artifact_id, unnest(['subtypes', 'media', 'media_located', 'domains', 'ssids', 'accounts', 'message_apps', 'call_directions', 'call_durations', 'web_subtypes', 'weekday_hour', 'day_category', 'places', 'with_payload']) AS tile,
  unnest([category || ' · ' || coalesce(nullif(subtype, ''), '(none)'), CASE WHEN category = 'Files & Media' THEN coalesce(nullif(subtype, ''), 'File') END,
   CASE WHEN category = 'Files & Media' THEN CASE WHEN latitude IS NOT NULL THEN 'located' ELSE 'not located' END END, CASE WHEN category = 'Web' THEN nullif(domain, '') END,
   CASE WHEN category = 'Networks' THEN nullif(body, '') END, CASE WHEN category = 'Accounts' THEN coalesce(nullif(app, ''), 'account') END,
   CASE WHEN category IN ('Messages', 'Chats') THEN coalesce(nullif(app, ''), '(unknown app)') END, CASE WHEN category = 'Calls' THEN direction END,
   CASE WHEN category = 'Calls' THEN CASE WHEN coalesce(seconds, 0) <= 0 THEN 'unknown' WHEN seconds < 10 THEN '<10s' WHEN seconds < 60 THEN '10-60s' WHEN seconds < 300 THEN '1-5m' WHEN seconds < 900 THEN '5-15m' ELSE '>15m' END END,
   CASE WHEN category = 'Web' THEN coalesce(nullif(subtype, ''), 'Visit') END,
   dayofweek(make_timestamp(timestamp)) || ' ' || hour(make_timestamp(timestamp)), strftime(make_timestamp(timestamp), '%Y-%m-%d') || ' ' || category,
   CASE WHEN latitude IS NOT NULL THEN printf('%.3f', floor(latitude * 1000 + 0.5) / 1000) || ',' || printf('%.3f', floor(longitude * 1000 + 0.5) / 1000) END, CASE WHEN payload <> '' THEN 'payload' END]) AS label FROM e) WHERE trim(label) <> ''"""


@query("dashboard_tiles", EVERY + f""", t AS ({TILES}), c AS (SELECT tile, label, count(*) AS n, CASE WHEN tile = 'places' THEN min(artifact_id) END AS sample FROM t GROUP BY tile, label),
 r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY n DESC, label) AS rank,
  CASE tile WHEN 'subtypes' THEN 24 WHEN 'domains' THEN 14 WHEN 'web_subtypes' THEN 8 WHEN 'places' THEN 80 WHEN 'media' THEN 12 WHEN 'ssids' THEN 12 WHEN 'accounts' THEN 12 WHEN 'message_apps' THEN 12 ELSE 1000000000 END AS most FROM c)
 SELECT tile, label, n, sample FROM r WHERE rank <= most""")
def _(df, spark, d):
    return dashboard.tiles(everything(spark, d))


@query("stats_monday_first", "SELECT (isodow(make_timestamp(timestamp)) - 1)::BIGINT AS weekday, count(*) AS n FROM art GROUP BY 1")
def _(df, spark, d):
    return timeline.by_weekday(df, monday_first=True)


@query("call_seconds", """SELECT app, direction, count(*) AS calls, count(s) AS answered, coalesce(sum(s), 0)::BIGINT AS seconds, round(avg(s), 1) AS mean, max(s) AS longest
 FROM (SELECT app, direction, CASE WHEN timestamp_end > timestamp THEN nullif((timestamp_end - timestamp) // 1000000, 0) END AS s FROM art WHERE category = 'Calls') GROUP BY 1, 2""")
def _(df, spark, d):
    return timeline.call_seconds(df)


def stores(df: DataFrame) -> DataFrame:
    """The kinds of rows of each exhibit as its stores, those of errors told as encrypted: a stated projection."""
    return df.select("exhibit", F.concat("app", F.lit("/"), "subtype", F.when(F.col("subtype") == "App usage event", ".crypt14").otherwise(".db")).alias("path"), F.lit("").alias("notes")).distinct()


@query("triage", """, s AS (SELECT exhibit, count(*) AS n, count(*) FILTER (WHERE recovery <> 'allocated') AS deleted, count(*) FILTER (WHERE category = 'Messages') AS m, count(*) FILTER (WHERE category = 'Calls') AS k FROM art GROUP BY 1),
 c AS (SELECT exhibit, count(DISTINCT app) AS closed FROM art WHERE subtype = 'App usage event' GROUP BY 1)
 SELECT exhibit, 'high' AS level, 'recovered deleted records' AS alert, deleted AS n FROM s WHERE deleted > 0 UNION ALL SELECT exhibit, 'warn', 'encrypted stores', closed FROM c
 UNION ALL SELECT exhibit, 'warn', 'communications gap', 1 FROM s WHERE m > 0 """)
def _(df, spark, d):
    return dashboard.triage(dashboard.case_summary(df), stores(df))


@query("next_steps", """, s AS (SELECT exhibit, count(*) FILTER (WHERE category = 'Messages') AS m, count(*) FILTER (WHERE recovery <> 'allocated') AS deleted, count(DISTINCT CASE WHEN subtype = 'App usage event' THEN app END) AS closed,
   count(DISTINCT CASE WHEN category IN ('Calls', 'Messages') AND direction = 'outgoing' THEN party END) AS owners FROM art GROUP BY 1),
 t AS (SELECT exhibit, [CASE WHEN m > 0 THEN ['close the gap in communications', 'high'] END, CASE WHEN closed > 0 THEN ['review signs of hiding', 'high'] END,
   CASE WHEN deleted < 340 AND owners > 0 THEN ['run the rules with the owner''s identity', 'medium'] WHEN deleted < 340 THEN ['run the rules', 'low'] END,
   CASE WHEN deleted >= 340 THEN ['review grave findings', 'high'] END, CASE WHEN closed > 0 THEN ['content of encrypted stores is missing', 'critical'] END] AS steps FROM s),
 u AS (SELECT exhibit, unnest(list_filter(steps, lambda x: x IS NOT NULL)) AS step, unnest(range(1, len(list_filter(steps, lambda x: x IS NOT NULL)) + 1))::INTEGER AS rank FROM t)
 SELECT exhibit, rank, step[1] AS step, step[2] AS severity FROM u """)
def _(df, spark, d):
    sums = dashboard.case_summary(df)
    closed = stores(df).filter("endswith(path, '.crypt14')").groupBy("exhibit").agg(F.count(F.lit(1)).alias("encrypted"))
    owners = df.filter(F.col("category").isin("Calls", "Messages") & (F.col("direction") == "outgoing")).groupBy("exhibit").agg(F.count_distinct("party").alias("owners"))
    # an exhibit with many deleted rows stands for one on which the rules found something grave
    grave = F.when(F.col("deleted") >= 340, 1).otherwise(0)
    facts = sums.join(closed, "exhibit", "left").join(owners, "exhibit", "left").withColumns({"findings": grave, "high": grave})
    return dashboard.next_steps(facts, "exhibit")


@query("finding_hashset", """WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents), bad AS (SELECT DISTINCT digest FROM d JOIN labels USING (doc_id) WHERE toxic = 1), good AS (SELECT DISTINCT digest FROM d JOIN labels USING (doc_id) WHERE toxic = 0),
 v AS (SELECT doc_id, CASE WHEN digest IN (SELECT digest FROM bad) THEN 'bad' WHEN digest IN (SELECT digest FROM good) THEN 'good' END AS v FROM d)
 SELECT 'hashset.known_' || v AS rule_id, 'labels' AS subject, count(*) AS n, CASE v WHEN 'bad' THEN 'critical' ELSE 'info' END AS severity FROM v WHERE v IS NOT NULL GROUP BY v""")
def _(df, spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    kind = F.when(F.col("toxic") == 1, "known-bad").otherwise("known-good").alias("kind")
    sets = docs.join(table(spark, d, "labels").filter("toxic is not null"), "doc_id").select("digest", kind, F.lit("labels").alias("set_name"), F.lit("").alias("label"))
    return findings.hashset_findings(digests.screen(docs, sets, "doc_id")).select("rule_id", "subject", "n", "severity")


@query("finding_communities", sweeps_sql() + """, z AS (SELECT label, count(*) AS n FROM n GROUP BY 1), d AS (SELECT label, sum(weight) AS s FROM (SELECT a AS node, weight FROM e UNION ALL SELECT b, weight FROM e) JOIN n USING (node) GROUP BY 1),
 q AS (SELECT (SELECT sum(weight) FROM e JOIN n x ON e.a = x.node JOIN n y ON e.b = y.node WHERE x.label = y.label) / (SELECT sum(weight) FROM e) - (SELECT sum(s::DOUBLE * s) FROM d) / pow(2 * (SELECT sum(weight) FROM e), 2) AS q, (SELECT count(*) FROM d) AS c)
 SELECT 'graph.communities' AS rule_id, label AS subject, n, 'medium' AS severity FROM z, q WHERE q >= 0.3 AND c >= 2 AND n >= 3 AND label NOT IN (SELECT label FROM n WHERE node = 'c0')""")
def _(df, spark, d):
    e, colours = spoken(spark, d)
    # the first conversation stands for the owner
    return findings.community_findings(e, graph.communities(e, colours).select("node", "label"), "c0").select("rule_id", "subject", "n", "severity")


@query("participant_top", ORDERS + """, e AS (SELECT x.key AS a, y.key AS b, count(*) AS weight FROM named x JOIN named y USING (o_orderkey) WHERE x.key < y.key GROUP BY 1, 2)
 SELECT a, b, weight FROM e ORDER BY weight DESC, a, b LIMIT 50""")
def _(df, spark, d):
    return participants.edges(group_messages(spark, d)).orderBy(F.col("weight").desc(), "a", "b").limit(50).select("a", "b", "weight")

"""Registered queries of artifacts with several participants and of app tables joined by declaration, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timex
from ..operators import graph, participants
from ..sources import layouts
from ..sources.artifacts import in_schema, table
from .catalog import query

ORDERS = """WITH art AS (SELECT o_orderkey, 'o' || o_orderkey AS artifact_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'Calls' ELSE 'Messages' END AS category, o_orderpriority AS app,
  CASE WHEN o_orderkey % 2 = 0 THEN 'outgoing' ELSE 'incoming' END AS direction, epoch_us(o_orderdate::TIMESTAMP) AS timestamp, epoch_us(o_orderdate::TIMESTAMP) + (o_orderkey % 600) * 1000000 AS timestamp_end, o_custkey FROM orders),
 sides AS (SELECT DISTINCT o_orderkey, CASE WHEN l_suppkey = 1 THEN '__owner__' ELSE (7000000000 + l_suppkey)::VARCHAR END AS key, 's' || l_suppkey AS name, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
 parties AS (SELECT o_orderkey, 'c' || o_custkey || '@shop.example' AS key, 'c' || o_custkey AS name FROM art UNION ALL SELECT o_orderkey, key, name FROM sides),
 named AS (SELECT o_orderkey, key FROM parties UNION SELECT o_orderkey, '__owner__' FROM art) """
MEASURES = """count(*) AS weight, count(*) FILTER (WHERE category = 'Calls') AS calls, count(*) FILTER (WHERE category <> 'Calls') AS messages,
 coalesce(sum((timestamp_end - timestamp) // 1000000) FILTER (WHERE category = 'Calls'), 0)::BIGINT AS seconds, count(*) FILTER (WHERE direction = 'outgoing') AS outgoing,
 count(*) FILTER (WHERE direction = 'incoming') AS incoming, count(DISTINCT app) AS apps, min(timestamp) AS first, max(timestamp) AS last """


def group_messages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as messages and calls of a customer to the suppliers of their lines, one of whom is the owner: a stated projection."""
    to = lambda k: participants.party("to", F.concat(F.lit("+44 "), (F.lit(7_000_000_000) + k).cast("string")), F.concat(F.lit("s"), k), k == 1)
    sides = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("_to"))
    met = table(spark, d, "orders").join(sides.hint("merge"), "o_orderkey", "left")
    begun = timex.micros(F.col("o_orderdate").cast("timestamp"))
    who = participants.party("from", F.concat(F.lit("c"), "o_custkey", F.lit("@shop.example")), F.concat(F.lit("c"), "o_custkey"))
    every = F.concat(F.array(who), F.transform(F.coalesce("_to", F.array().cast("array<long>")), to)).cast(participants.TYPE)
    return in_schema(
        met, artifact_id=F.concat(F.lit("o"), "o_orderkey"), category=F.when(F.startswith("o_orderpriority", F.lit("1")), "Calls").otherwise("Messages"), app=F.col("o_orderpriority"),
        direction=F.when(F.col("o_orderkey") % 2 == 0, "outgoing").otherwise("incoming"), timestamp=begun, timestamp_end=begun + (F.col("o_orderkey") % 600) * 1_000_000,
        source_row=F.col("o_orderkey").cast("long"), participants=every,
    )


@query("participant_edges", ORDERS + f", pairs AS (SELECT x.key AS a, y.key AS b, art.* FROM named x JOIN named y USING (o_orderkey) JOIN art USING (o_orderkey) WHERE x.key < y.key) SELECT a, b, {MEASURES} FROM pairs GROUP BY 1, 2")
def _(df, spark, d):
    return participants.edges(group_messages(spark, d))


@query("participant_nodes", ORDERS + f""", rows AS (SELECT key AS node, category, direction, app, timestamp, timestamp_end FROM parties JOIN art USING (o_orderkey)
 UNION ALL SELECT '__owner__', NULL, NULL, NULL, NULL, NULL FROM art WHERE o_orderkey NOT IN (SELECT o_orderkey FROM parties WHERE key = '__owner__')) SELECT node, {MEASURES} FROM rows GROUP BY 1""")
def _(df, spark, d):
    return participants.nodes(group_messages(spark, d))


@query("participant_degrees", ORDERS + """, e AS (SELECT x.key AS a, y.key AS b, count(*) AS weight FROM named x JOIN named y USING (o_orderkey) WHERE x.key < y.key GROUP BY 1, 2),
 l AS (SELECT key, min(name) AS label FROM parties WHERE key <> '__owner__' GROUP BY 1)
 SELECT node, coalesce(label, node) AS label, count(*) AS degree, sum(weight)::BIGINT AS strength FROM (SELECT a AS node, weight FROM e UNION ALL SELECT b, weight FROM e) LEFT JOIN l ON node = key GROUP BY 1, 2""")
def _(df, spark, d):
    found = group_messages(spark, d)
    labels = graph.labelled(participants.names(found)).withColumnRenamed("key", "node")
    return graph.degrees(participants.edges(found)).join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "degree", "strength")


@query("filter_participant", ORDERS + "SELECT artifact_id FROM art WHERE o_orderkey IN (SELECT o_orderkey FROM parties WHERE key = '7000000003') OR o_orderkey IN (SELECT o_orderkey FROM parties WHERE contains(name, 'c77'))")
def _(df, spark, d):
    return group_messages(spark, d).filter(participants.met("+44 70 0000 0003") | participants.met("C77")).select("artifact_id")


def app_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Lines as messages in the chats of their orders, whose accounts are the customers and whose senders are the suppliers: a stated projection."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    gone = F.col("l_returnflag") == "R"
    message = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_id"), F.col("l_orderkey").alias("CHAT_ROW_ID"), F.col("l_suppkey").alias("sender_jid_row_id"), (F.col("l_linenumber") % 2).alias("from_me"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp"), F.col("l_linestatus").alias("text_data"), F.when(gone, "wal").otherwise("allocated").alias("recovery"), F.when(gone, 0.7).otherwise(1.0).alias("confidence"),
    )
    chat = orders.select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("jid_row_id"), F.col("o_orderpriority").alias("subject"), F.when(F.col("o_orderstatus") == "P", 0.5).otherwise(1.0).alias("confidence"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("_id"), F.concat(F.lit("44"), (F.lit(7_000_000_000) + F.col("s_suppkey")).cast("string"), F.lit("@c.us")).alias("raw_string"))
    customer = table(spark, d, "customer").select((F.col("c_custkey") + 1_000_000_000).alias("_id"), F.concat(F.lit("g"), "c_custkey", F.lit("@g.us")).alias("raw_string"))
    return {"message": message, "chat": chat.withColumn("jid_row_id", F.col("jid_row_id") + 1_000_000_000), "jid": supplier.unionByName(customer)}


@query("app_messages_joined", """WITH m AS (SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS source_row, l_linenumber % 2 = 1 AS mine, 'g' || o_custkey || '@g.us' AS chat, (7000000000 + l_suppkey)::VARCHAR AS sender, l_linestatus AS body,
  epoch_us(l_shipdate::TIMESTAMP) AS timestamp, CASE WHEN l_returnflag = 'R' THEN 'wal' ELSE 'allocated' END AS recovery,
  least(CASE WHEN l_returnflag = 'R' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END, CASE WHEN o_orderstatus = 'P' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT source_row, timestamp, CASE WHEN mine THEN 'outgoing' ELSE 'incoming' END AS direction, body, recovery, confidence, CASE WHEN mine THEN chat ELSE sender END AS party, 2 AS n_parties FROM m""")
def _(df, spark, d):
    found = layouts.messages(app_tables(spark, d))
    return found.select("source_row", "timestamp", "direction", "body", "recovery", "confidence", "party", F.size("participants").alias("n_parties"))

"""Registered queries of folder trees and of chained logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timex
from ..operators import digests, graph, trees
from ..sources.artifacts import table
from .catalog import between_sql, nation_edges, query

FILES = """WITH files AS (SELECT 'data/data/com.app' || (user_id % 5) || '.x/' || CASE WHEN event_type = 'error' THEN '.vault' ELSE event_type END || '/' || strftime(ts, '%m-%d') || '/' || event_id
  || CASE WHEN event_id % 10 = 0 THEN '.enc' ELSE '.log' END AS path, floor(value)::BIGINT AS size, epoch_us(ts) AS modified FROM events),
 cut AS (SELECT *, string_split(path, '/') AS p, unnest([1, 2, 3, 4, 5]) AS depth FROM files),
 entered AS (SELECT *, array_to_string(p[1:depth], '/') AS folder, len(p) - 1 = depth AS direct FROM cut) """


def event_files(spark: SparkSession, d: str) -> DataFrame:
    """Events as files of apps, by kind and day: a stated projection."""
    kind = F.when(F.col("event_type") == "error", ".vault").otherwise(F.col("event_type"))
    ending = F.when(F.col("event_id") % 10 == 0, ".enc").otherwise(".log")
    path = F.concat(F.lit("data/data/com.app"), F.col("user_id") % 5, F.lit(".x/"), kind, F.lit("/"), F.date_format("ts", "MM-dd"), F.lit("/"), "event_id", ending)
    return table(spark, d, "events").select(path.alias("path"), F.floor("value").cast("long").alias("size"), timex.micros(F.col("ts")).alias("modified"))


@query("tree_sums", FILES + """SELECT folder, depth, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (WHERE direct) AS direct, count(DISTINCT CASE WHEN NOT direct THEN p[depth + 1] END) AS folders,
 min(modified) AS oldest, max(modified) AS newest FROM entered GROUP BY 1, 2""")
def _(df, spark, d):
    return trees.sums(event_files(spark, d))


@query("tree_hidden", FILES + """SELECT folder AS path, 'folder' AS why, count(*) AS files FROM entered WHERE contains(folder, '.vault') GROUP BY 1
 UNION ALL SELECT path, 'ending', 1 FROM files WHERE path LIKE '%.enc'""")
def _(df, spark, d):
    return trees.hidden(event_files(spark, d))


@query("tree_left_behind", FILES + """SELECT split_part(path, '/', 3) AS package, count(*) AS files, sum(size)::BIGINT AS bytes, max(modified) AS newest FROM files
 WHERE split_part(path, '/', 3) NOT IN (SELECT DISTINCT 'com.app' || (user_id % 5) || '.x' FROM events WHERE user_id % 5 < 3) GROUP BY 1""")
def _(df, spark, d):
    installed = table(spark, d, "events").filter("user_id % 5 < 3").select(F.concat(F.lit("com.app"), F.col("user_id") % 5, F.lit(".x")).alias("package")).distinct()
    return trees.left_behind(event_files(spark, d), installed)


@query("tree_reset", FILES + """, e AS (SELECT count(*) AS files, min(modified) AS floor, max(modified) AS last FROM files)
 SELECT floor, files, at_floor, round(at_floor / files, 3) AS ratio, round((last - floor) / 86400000000, 1) AS days, CASE WHEN at_floor / files > 0.5 THEN 'medium' ELSE 'low' END AS confidence
 FROM e, (SELECT count(*) AS at_floor FROM files, e WHERE modified <= floor + 86400000000) WHERE at_floor / files >= 0.02""")
def _(df, spark, d):
    # events spread evenly over their days, so a lower share at the floor is asked for than a reset would show
    return trees.reset_estimate(event_files(spark, d), share=0.02)


def order_logs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as logs (log, seq, previous, own, content), each line sealed over the one before; then some are changed and some lost."""
    line = F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_returnflag"))
    own = F.struct(F.col("l_linenumber").alias("line"), line.alias("content"), (F.col("l_returnflag") == "R").alias("changed"), (F.col("l_quantity") > 25).alias("big"))
    held = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("log")).agg(F.sort_array(F.collect_list(own)).alias("lines"))
    empty = F.array().cast("array<struct<seq:int,content:string,changed:boolean,big:boolean,previous:string,own:string>>")

    def sealed(done, x):
        last = F.when(F.size(done) > 0, F.element_at(done, F.size(done))["own"]).otherwise("")
        seal = F.sha2(F.concat(last, F.lit("|"), x["content"]), 256)
        return F.concat(done, F.array(F.struct((F.size(done) + 1).alias("seq"), x["content"].alias("content"), x["changed"].alias("changed"), x["big"].alias("big"), last.alias("previous"), seal.alias("own"))))

    entries = held.select("log", F.inline(F.aggregate("lines", empty, sealed)))
    forged = F.when((F.col("seq") == 3) & F.col("changed"), F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return entries.filter("not (seq = 2 and big)").select("log", "seq", "previous", "own", forged.alias("content"))


@query("hash_chains", """WITH n AS (SELECT l_orderkey AS log, l_returnflag = 'R' AS changed, l_quantity > 25 AS big,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey || '/' || l_suppkey || '/' || l_returnflag, l_returnflag = 'R', l_quantity > 25) AS seq FROM lineitem),
 l AS (SELECT log, seq, changed, lag(seq) OVER (PARTITION BY log ORDER BY seq) AS before FROM n WHERE NOT (seq = 2 AND big))
 SELECT log, seq, CASE WHEN seq = 3 AND changed THEN 'own digest' ELSE 'gap' END AS broken FROM l WHERE (seq = 3 AND changed) OR (before IS NOT NULL AND seq <> before + 1)""")
def _(df, spark, d):
    return digests.verify_chains(order_logs(spark, d), "log", "seq", "previous", "own", F.col("content"))


@query("graph_brokers", f"SELECT node, betweenness FROM ({between_sql()}) WHERE betweenness > 0 ORDER BY betweenness DESC, node LIMIT 10")
def _(df, spark, d):
    return graph.brokers(graph.betweenness(nation_edges(spark, d)))

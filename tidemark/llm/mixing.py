"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, then seeded block selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import WORD, names_apart, others, rows_under, stored, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
DOCS_PER_SHARD = 2_000
#: Sources that are broadcast, about 100 bytes each; more are joined.
MOST_SOURCES = 100_000
SEED = "mix-1"


def targets_of(sources: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """sources (source, source_size) with weight and target.

    Sources take the weights in turn, by code point, null last. Each is due its weight's share of all
    words; those due more than max_repeats times their size get just that, and the excess goes to the
    others by weight. In order of size over weight the capped sources come first, so each source is
    capped if it is due more than its cap once all before it are capped.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    listed = F.array(*(F.lit(float(w)) for w in weights))
    made = sources.withColumn("weight", F.get(listed, (F.row_number().over(order) - 1) % n))
    cap = F.col("source_size") * float(max_repeats)
    before = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    made = made.withColumns(
        {
            "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
            "_weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    capped = F.col("weight") * F.col("_left") >= cap * F.col("_weights")
    made = made.withColumn("_capped", capped)
    free = lambda x: F.coalesce(F.sum(F.when(~F.col("_capped"), x)).over(everything), F.lit(0.0))
    spent = F.coalesce(F.sum(F.when(F.col("_capped"), cap)).over(everything), F.lit(0.0))
    share = F.col("weight") * (F.sum("source_size").over(everything) - spent) / free(F.col("weight"))
    return made.withColumn("target", F.when(F.col("_capped"), cap).otherwise(share)).drop("_left", "_weights", "_capped")


def sainte_lague(votes: DataFrame, group: Sequence[str], key: Sequence[str], vote: str, seats: Column, out: str) -> DataFrame:
    """votes with out: its seats of those of its group, dealt one by one to the highest vote / (2 * seats + 1).

    seats is a column that is the same all over a group. A row gets at the divisor of a group of n rows at
    least ceil(x * (1 - n / 2M) - 1/2) seats, x being its exact share of M seats. Those are dealt at once;
    only the few next ones of each row compete by quotient.
    """
    of = W.partitionBy(*group) if group else W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    made = votes.withColumns(
        {"_seats": seats.cast("long"), "_n": F.count(F.lit(1)).over(of), "_all": F.sum(vote).over(of)}
    )
    share = F.when(F.col("_all") > 0, F.col("_seats") * F.col(vote) / F.col("_all")).otherwise(0.0)
    sure = F.greatest(F.lit(0.0), F.ceil(share * (1 - F.col("_n") / (2 * F.col("_seats"))) - 0.5) - 1)
    made = made.withColumn("_share", share).withColumn(
        "_sure", F.when(F.col("_seats") > 0, sure).otherwise(0.0).cast("long")
    )
    made = made.withColumn("_open", F.col("_seats") - F.sum("_sure").over(of))
    reach = F.ceil(F.col("_share") * (1 + F.col("_n") / F.greatest(F.col("_seats"), F.lit(1))) + 2).cast("long")
    reach = F.least(F.col("_sure") + F.greatest(F.col("_open"), F.lit(0)), F.greatest(reach, F.col("_sure")))
    some = F.col("_open") > 0
    offers = made.filter(some & (F.col(vote) > 0) & (reach > F.col("_sure"))).select(
        *group, *key, vote, "_open", F.explode(F.sequence(F.col("_sure"), reach - 1)).alias("_q")
    )
    rank = F.row_number().over(
        (W.partitionBy(*group) if group else W.partitionBy()).orderBy(
            (F.col(vote) / (2 * F.col("_q") + 1)).desc(), *(F.col(k).asc_nulls_last() for k in key), "_q"
        )
    )
    won = offers.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_open"))
    same = [*group, *key]
    won = won.groupBy(*(F.col(k).alias(f"_won_{k}") for k in same)).agg(F.count(F.lit(1)).alias("_won"))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_won_{k}")) for k in same))
    return made.join(won, on, "left").select(*votes.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias(out))


@names_apart
def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    docs_per_shard: int = DOCS_PER_SHARD,
    seed: str = SEED,
    with_text: bool = False,
    shards_per_group: int = 1_000,
) -> DataFrame:
    """Every row of docs (doc_id, text, source, ...) with size, source_size, target, taken; text if with_text.

    The words of a source are cut into shards by a seeded hash of doc_id and text, and each shard, its documents
    in seeded order, into blocks of equally many words. Sources get whole blocks by Sainte-Laguë, and so
    do, at every size, groups of shards_per_group shards of a source and the shards of a group. A shard of m blocks with a quota q takes all its blocks q div m times and
    a run of q mod m of them once more, which starts at a seeded block and goes on from the first after
    the last. taken is the number of words of the document in those blocks, repeats counted.

    A block has so few words that the smallest target holds 200 of them, and at most 4096. Null and empty
    texts have size 0 and are never taken; a null source is a source; a null doc_id counts as an empty
    string in the order; repeated rows are documents of their own, in an order by their other columns, and meet in one
    shard, so a text repeated in full under one doc_id is one task's work; an empty table gives an empty one.
    Columns named like those made are replaced. Texts are shuffled, once, only if with_text asks for them.
    A hot source is dealt out over its shards; the table of sources is broadcast if it has at most MOST_SOURCES rows.
    """
    made = ("size", "source_size", "target", "taken")
    keep = [c for c in others(docs, made) if with_text or c != "text"]
    identity = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    token = F.md5(F.concat(F.lit(f"{seed}:"), *identity))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    tied = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, (MapType, VariantType))]
    every = docs.select(*keep, size.alias("size"), token.alias("_token"), F.xxhash64(*tied).alias("_tie"))
    # sources and shards both need all sizes: the texts are read for them once
    sized = stored(every.select("source", "size", "_token") if with_text else every, "sizes")
    if not with_text:
        every = sized
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    sources = stored(targets_of(sources, weights, max_repeats), "targets")
    least = F.min(F.when(F.col("target") > 0, F.col("target")))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    block = F.greatest(F.lit(1), F.least(F.lit(4096), F.floor(least.over(everything) / 200))).cast("long")
    sources = sources.withColumn("_block", F.coalesce(block, F.lit(1).cast("long")))
    seats = F.round(F.sum("target").over(everything) / F.col("_block"))
    sources = sainte_lague(sources, [], ["source"], "target", seats, "_quota")
    sources = sources.withColumn("_shards", F.ceil(F.col("_docs") / docs_per_shard).cast("long"))

    sources = stored(sources, "sources")
    named = sources.select(F.col("source").alias("_source"), "source_size", "target", "_block", "_quota", "_shards")
    # else the join would deal all rows by source, the hot one's to one task
    named = F.broadcast(named) if rows_under(named, MOST_SOURCES) else named

    def placed(rows: DataFrame) -> DataFrame:
        number = F.conv(F.substring("_token", 1, 12), 16, 10).cast("long")
        tied = rows.join(named, F.col("source").eqNullSafe(F.col("_source")), "left")
        return tied.withColumn("_shard", number % F.greatest(F.col("_shards"), F.lit(1)))

    # a row a shard; stored, as each deal reads its votes twice, and what reads a table twice doubles its plan and all plans on it
    shards = placed(sized).groupBy("source", "_shard").agg(
        F.sum("size").alias("_words"), F.first("_quota").alias("_of"), F.first("_block").alias("_b")
    )
    shards = stored(shards, "shards")
    # groups of shards first, so that no window holds more than a group's shards or a source's groups
    shards = shards.withColumns({"_group": F.floor(F.col("_shard") / shards_per_group), "_votes": F.col("_words").cast("double")})
    groups = shards.groupBy("source", "_group").agg(F.sum("_votes").alias("_votes"), F.first("_of").alias("_of"))
    groups = sainte_lague(groups, ["source"], ["_group"], "_votes", F.col("_of"), "_q")
    groups = groups.select(F.col("source").alias("_s"), F.col("_group").alias("_g"), F.col("_q").alias("_seats_of_group"))
    shards = shards.join(groups, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_group") == F.col("_g")), "left")
    shards = stored(shards.drop("_s", "_g"), "shards")
    shards = sainte_lague(shards, ["source", "_group"], ["_shard"], "_votes", F.col("_seats_of_group"), "_q")
    blocks = F.greatest(F.ceil(F.col("_words") / F.col("_b")), F.lit(1)).cast("long")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("_shard"))), 1, 12), 16, 10)
    shards = shards.withColumn("_m", blocks).withColumn("_q", F.least(F.col("_q"), F.col("_m") * max_repeats))
    shards = shards.withColumns(
        {
            "_passes": F.floor(F.col("_q") / F.col("_m")).cast("long"),
            "_run": (F.col("_q") % F.col("_m")) * F.col("_b"),
            "_from": (start.cast("long") % F.col("_m")) * F.col("_b"),
            "_line": F.col("_m") * F.col("_b"),
        }
    ).select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), "_passes", "_run", "_from", "_line")
    shards = stored(shards, "quotas")
    line = W.partitionBy("source", "_shard").orderBy("_token", "size", "_tie")
    tied = placed(every).withColumn("_end", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)))
    full = tied.join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")), "left")
    begin = F.col("_end") - F.col("size")
    inside = lambda a, b: F.greatest(F.lit(0), F.least(F.col("_end"), b) - F.greatest(begin, a))
    stop = F.col("_from") + F.col("_run")
    over = inside(F.col("_from"), F.least(stop, F.col("_line"))) + inside(F.lit(0), stop - F.col("_line"))
    return full.select(*keep, "size", "source_size", "target", (F.col("_passes") * F.col("size") + over).cast("long").alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number; the others go.

    Null and empty texts go, as they have no words; a null source is a source, a null doc_id an empty string in the
    order; repeated rows are taken one by one, and reruns agree; an empty table gives an empty one; extra
    columns stay as they are, also those named like the mix's own.
    """
    return repeated(docs)


@names_apart
def repeated(docs: DataFrame) -> DataFrame:
    own = {c: f"_kept_{c}" for c in docs.columns if c.lower() in ("size", "source_size", "target", "taken")}
    mixed = mix(docs.withColumnsRenamed(own), with_text=True)
    times = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    made = mixed.filter(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    return made.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS token FROM documents),
listed AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs,
    [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
limits AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER () AS total FROM listed),
ordered AS (
  SELECT *, total - coalesce(sum(cap) OVER w, 0) AS left_words, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS weights
  FROM limits WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, weight * left_words >= cap * weights AS full_up FROM ordered),
aimed AS (
  SELECT *, CASE WHEN full_up THEN cap ELSE weight * (total - coalesce(sum(CASE WHEN full_up THEN cap END) OVER (), 0))
    / sum(CASE WHEN NOT full_up THEN weight END) OVER () END AS target FROM capped),
cut AS (
  SELECT *, greatest(1, least(4096, floor(min(CASE WHEN target > 0 THEN target END) OVER () / 200)))::BIGINT AS block,
    ceil(docs / 2000)::BIGINT AS shards, sum(target) OVER () AS aim FROM aimed),
seats AS (SELECT *, round(aim / block)::BIGINT AS m FROM cut),
quotients AS (
  SELECT source, target / (2 * q + 1) AS quotient, q, m FROM seats,
    LATERAL (SELECT unnest(range(0, (ceil(m * target / aim) + ceil(m / 2) % 64 + 64)::BIGINT)) AS q) WHERE target > 0),
dealt AS (
  SELECT source, count(*) AS quota FROM (
    SELECT *, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST, q) AS place FROM quotients) WHERE place <= m GROUP BY source),
tied AS (
  SELECT d.*, s.source_size, s.target, s.block, coalesce(t.quota, 0) AS quota,
    ('0x' || substr(token, 1, 12))::BIGINT % greatest(s.shards, 1) AS shard
  FROM sized d JOIN seats s ON d.source IS NOT DISTINCT FROM s.source
  LEFT JOIN dealt t ON d.source IS NOT DISTINCT FROM t.source),
shard_sizes AS (SELECT source, shard, sum(size)::BIGINT AS words, any_value(quota) AS of, any_value(block) AS b FROM tied GROUP BY ALL),
group_sizes AS (SELECT source, shard // 1000 AS part, sum(words)::BIGINT AS words, any_value(of) AS of FROM shard_sizes GROUP BY ALL),
group_quotients AS (
  SELECT source, part, words / (2 * q + 1) AS quotient, q, of FROM (SELECT *, sum(words) OVER (PARTITION BY source) AS all_words FROM group_sizes),
    LATERAL (SELECT unnest(range(0, (ceil(of * words / all_words) + 64)::BIGINT)) AS q) WHERE words > 0),
group_dealt AS (
  SELECT source, part, count(*) AS seats FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, part, q) AS place FROM group_quotients)
  WHERE place <= of GROUP BY source, part),
shard_all AS (
  SELECT s.source, s.shard, s.words, g.part, g.seats, sum(s.words) OVER (PARTITION BY s.source, g.part) AS all_words
  FROM shard_sizes s JOIN group_dealt g ON s.source IS NOT DISTINCT FROM g.source AND s.shard // 1000 = g.part),
shard_quotients AS (
  SELECT source, shard, part, words / (2 * q + 1) AS quotient, q, seats FROM shard_all,
    LATERAL (SELECT unnest(range(0, (ceil(seats * words / all_words) + 64)::BIGINT)) AS q) WHERE words > 0),
shard_dealt AS (
  SELECT source, shard, count(*) AS won FROM (
    SELECT *, row_number() OVER (PARTITION BY source, part ORDER BY quotient DESC, shard, q) AS place FROM shard_quotients)
  WHERE place <= seats GROUP BY source, shard),
runs AS (
  SELECT s.source, s.shard, b, greatest(ceil(words / b), 1)::BIGINT AS m, least(coalesce(won, 0), 3 * greatest(ceil(words / b), 1))::BIGINT AS q,
    ('0x' || substr(md5('mix-1/' || coalesce(s.source, '') || '/' || s.shard), 1, 12))::BIGINT AS start
  FROM shard_sizes s LEFT JOIN shard_dealt d ON s.source IS NOT DISTINCT FROM d.source AND s.shard = d.shard),
spans AS (SELECT source, shard, q // m AS passes, (q % m) * b AS run, (start % m) * b AS begin_at, m * b AS line FROM runs),
lined AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY token, size ROWS UNBOUNDED PRECEDING) AS stop FROM tied)
SELECT doc_id, size, source_size, target, (passes * size
    + greatest(0, least(stop, least(begin_at + run, line)) - greatest(stop - size, begin_at))
    + greatest(0, least(stop, begin_at + run - line) - greatest(stop - size, 0)))::BIGINT AS taken
FROM lined l JOIN spans s ON l.source IS NOT DISTINCT FROM s.source AND l.shard = s.shard
"""

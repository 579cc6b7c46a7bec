"""Sharding by extendible hashing: only buckets over the byte limit split, on one more bit each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import names_apart, rows_under, stored, table

LIMIT = 1 << 20
MAX_BITS = 60
#: Directory entries that may be broadcast, 40 bytes each.
MOST_BROADCAST = 200_000


def prefix(depth) -> F.Column:
    """The first depth bits of the 60-bit hash."""
    return F.shiftright("_hash", (MAX_BITS - depth)) if isinstance(depth, int) else F.expr(f"shiftright(_hash, {MAX_BITS} - {depth})")


def directory(sized: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """Leaves (depth, bits) of the directory for rows (_hash, n_bytes).

    Bytes are summed by prefix, step bits further each round and only under buckets still too large, and
    summed up again to every shorter prefix: the leaf of a prefix is its shortest part that fits, or that
    holds a single hash, as no further bit parts that. Rounds end when all buckets are leaves.
    """
    open_buckets, leaves, depth = None, None, 0
    while True:
        depth_to = min(MAX_BITS, depth + step)
        rows = sized.withColumn("_at", prefix(depth_to))
        if open_buckets is not None:
            above = rows.withColumn("_above", prefix(depth))
            small = F.broadcast(open_buckets) if rows_under(open_buckets, MOST_BROADCAST) else open_buckets
            rows = above.join(small, F.col("_above") == F.col("_open"), "left_semi")
        ends = lambda lo, hi: (F.min(lo).alias("lo"), F.max(hi).alias("hi"))
        fine = rows.groupBy("_at").agg(F.sum("n_bytes").alias("_bytes"), *ends("_hash", "_hash"))
        spread = fine.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(depth_to))))
        spread = spread.withColumn("bits", F.expr(f"shiftright(_at, {depth_to} - depth)"))
        sums = stored(spread.groupBy("depth", "bits").agg(F.sum("_bytes").alias("bytes"), *ends("lo", "hi")), "directory")
        fits = (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))
        # a leaf fits and its parent doesn't; the tops of later rounds are known not to fit
        up = sums.filter(~fits).select((F.col("depth") + 1).alias("depth"), F.col("bits").alias("_up"))
        found = sums.filter(fits).withColumn("_up", F.shiftright("bits", 1))
        made = found.join(up, ["depth", "_up"], "left_semi").select("depth", "bits", "bytes")
        if depth == 0:
            made = made.unionByName(found.filter("depth = 0").select("depth", "bits", "bytes"))
        leaves = made if leaves is None else leaves.unionByName(made)
        last = sums.filter((F.col("depth") == depth_to) & ~fits)
        if depth_to == MAX_BITS or last.isEmpty():
            return leaves
        open_buckets, depth = last.select(F.col("bits").alias("_open")), depth_to


@names_apart
def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8 bytes of text), depth, bucket (bits of the hash as 0 and 1), part and shard.

    A row's hash is 60 bits of the MD5 of doc_id and text. The directory starts as one bucket; those over
    limit bytes split on the next bit, again and again, and the others stay as they are. Rows that are
    equal in doc_id and text have one hash and can't part by bits: such a bucket over the limit is cut into
    parts of as many rows as fit. A single row over the limit gets a part to itself, as no shard can hold
    it. part is 0 in all other buckets; shard is bucket-part.

    Null texts have 0 bytes, a null doc_id is hashed as such, columns named like the new ones are replaced and
    an empty table gives an empty one. A source or key of many rows is spread by the hash. Only sums by
    prefix are shuffled, and rows of buckets that no bit parts; the directory is broadcast if it has at most
    MOST_BROADCAST pointers, else joined. Equal rows are numbered within the tasks that read them and
    after the numbers of the tasks before, so that no task takes all copies of one text.
    """
    docs = docs.drop("n_bytes", "depth", "bucket", "part", "shard")
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"),
            "_hash": F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"),
            "_salt": F.spark_partition_id(),
        }
    )
    sized = stored(rows.select("_hash", "n_bytes"), "sized")
    leaves = stored(directory(sized, limit), "leaves")
    n, deepest, largest = leaves.agg(
        F.count(F.lit(1)), F.coalesce(F.max("depth"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))
    ).first()
    wide = min(deepest, max(1, n).bit_length() + 2)
    table_of = pointers(leaves, wide)
    table_of = F.broadcast(table_of) if rows_under(table_of, MOST_BROADCAST) else table_of
    placed = rows.withColumn("_at", prefix(wide)).join(table_of, "_at")
    leaf = F.expr(f"filter(_leaves, x -> shiftright(_hash, {MAX_BITS} - x.depth) = x.bits)[0]")
    placed = placed.withColumn("_leaf", leaf).select("*", "_leaf.depth", F.col("_leaf.bits").alias("_bits"), F.col("_leaf.bytes").alias("_total"))
    made = placed.filter(F.col("_total") <= limit).withColumn("part", F.lit(0).cast("long"))
    if largest > limit:
        made = made.unionByName(numbered(placed.filter(F.col("_total") > limit), limit))
    bucket = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("_bits"), F.col("depth").cast("int"), F.lit("0")))
    made = made.withColumn("bucket", bucket).withColumn("shard", F.concat("bucket", F.lit("-"), F.col("part")))
    return made.select(*docs.columns, "n_bytes", "depth", "bucket", "part", "shard")


def numbered(over: DataFrame, limit: int) -> DataFrame:
    """Rows of buckets that hold one hash each, with their part: as many equal rows in each as fit."""
    own = F.row_number().over(W.partitionBy("_hash", "_salt").orderBy("n_bytes"))
    salted = stored(over.withColumn("_own", own), "equal")  # salt and number of a row are given once
    counts = salted.groupBy("_hash", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy("_hash").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("_hash", "_salt", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")
    part = F.floor((F.col("_before") + F.col("_own") - 1) / each).cast("long")
    return salted.join(before, ["_hash", "_salt"]).withColumn("part", part).select(*over.columns, "part")


def pointers(leaves: DataFrame, wide: int) -> DataFrame:
    """The directory at a width of so many bits: _at, and in _leaves the leaf that it points to.

    A leaf of fewer bits is pointed to from all its extensions; leaves of more bits share the place of
    their first ones, and a row's hash tells which of them is its own.
    """
    more = F.greatest(F.lit(0), F.lit(wide) - F.col("depth"))
    less = F.greatest(F.lit(0), F.col("depth") - wide)
    spread = leaves.withColumn("_more", more.cast("int")).withColumn("_less", less.cast("int"))
    spread = spread.withColumn("_k", F.explode(F.expr("sequence(0L, shiftleft(1L, _more) - 1)")))
    at = F.expr("shiftleft(shiftright(bits, _less), _more) + _k")
    return spread.groupBy(at.alias("_at")).agg(F.collect_list(F.struct("depth", "bits", "bytes")).alias("_leaves"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "n_bytes", "depth", "bucket", "part", "shard")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT r, doc_id, n_bytes, h, depth, h >> (60 - depth) AS bits FROM d, (SELECT unnest(range(0, 61)) AS depth)),
s AS (SELECT depth, bits, sum(n_bytes) AS total FROM p GROUP BY ALL HAVING sum(n_bytes) <= 1048576 OR min(h) = max(h)),
f AS (SELECT p.r, min(p.depth) AS depth FROM p JOIN s USING (depth, bits) GROUP BY p.r),
l AS (SELECT p.*, total FROM p JOIN f USING (r, depth) JOIN s USING (depth, bits)),
t AS (SELECT *, CASE WHEN total <= 1048576 THEN 0 ELSE
  (row_number() OVER (PARTITION BY h ORDER BY n_bytes) - 1) // greatest(1, 1048576 // greatest(n_bytes, 1)) END AS part FROM l)
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bits), depth::INTEGER, '0') END AS bucket, part,
  CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bits), depth::INTEGER, '0') END || '-' || part AS shard
FROM t
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard. Nulls, empty tables, repeated rows and clashing names are as in shard()."""
    return shard(docs)

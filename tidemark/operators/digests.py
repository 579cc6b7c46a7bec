"""Digests: screening against sets, Merkle roots, hash chains, near hashes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import checks
from .graph import components, edges
from .joins import beside
from .tables import checkpointed, spread


#: Headings of the column of a hash list that says what a digest is of.
LABELS = ("filename", "file_name", "name", "product", "description")


def read_hash_set(spark: SparkSession, path: str, kind: str, name: str) -> DataFrame:
    """A hash set as (digest, algorithm, label, set_name, kind): digests a line, CSV with or without headings, or JSON with entries.

    In lines and CSV every cell of a digest's shape counts, and the label is what stands in the column of a file or product
    name if the headings have one, else what follows a digest on its line. JSON may say its own kind.
    """
    head = spark.read.text(path).filter("trim(value) <> ''").limit(1).first()
    first = head["value"].strip() if head else ""
    if first.startswith("{"):
        rows = spark.read.schema("kind string, entries array<struct<digest:string,hash:string,md5:string,sha1:string,sha256:string,label:string,name:string>>").option("multiLine", "true").json(path)
        e = rows.select(F.coalesce("kind", F.lit(kind)).alias("kind"), F.inline("entries"))
        cells = F.array("sha256", "sha1", "md5", "digest", "hash")
        each = e.select("kind", F.coalesce("label", "name", F.lit("")).alias("label"), F.explode(cells).alias("digest"))
    elif "," in first:
        cut = lambda x: F.transform(F.split(x, ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
        headings = [c.strip().strip('"').lower() for c in first.split(",")]
        at = next((k for k, c in enumerate(headings) if c in LABELS), None)
        rows = spark.read.text(path).select(cut(F.col("value")).alias("cells"))
        label = F.get("cells", F.lit(1 if at is None else at))
        each = rows.select(F.lit(kind).alias("kind"), F.coalesce(label, F.lit("")).alias("label"), F.explode("cells").alias("digest"))
    else:
        parts = F.split(F.trim("value"), r"\s+", 2)
        rows = spark.read.text(path).filter("not startswith(trim(value), '#')")
        each = rows.select(F.lit(kind).alias("kind"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("label"), parts[0].alias("digest"))
    each = each.withColumn("digest", F.lower(F.trim("digest"))).withColumn("algorithm", checks.digest_kind(F.col("digest"))).filter("algorithm is not null")
    return each.select("digest", "algorithm", F.when(F.lower("label") == F.col("digest"), "").otherwise(F.col("label")).alias("label"), F.lit(name).alias("set_name"), "kind")


def screen(files: DataFrame, hashes: DataFrame, id_column: str) -> DataFrame:
    """files (id, digest ...) with the verdict of the sets, known bad before known good.

    The sets are first brought to one row per digest, so a file meets at most one.
    """
    rank = F.when(F.col("kind") == "known-bad", 0).otherwise(1)
    best = hashes.groupBy("digest").agg(F.min(F.struct(rank.alias("r"), "kind", "set_name", "label")).alias("b"))
    out = files.join(best, "digest", "left")
    return out.select(id_column, "digest", F.coalesce("b.kind", F.lit("unknown")).alias("verdict"), F.col("b.set_name").alias("set_name"))


def merkle_root(leaves: DataFrame, digest: str) -> DataFrame:
    """One row with the root over the distinct digests in order, an odd last one paired with itself.

    Leaves are numbered within their first three hex digits and after those before them; each round
    joins the pairs by number, so no task holds more than its share until few are left.
    """
    ordered = leaves.select(F.col(digest).alias("h")).filter("h is not null").distinct().withColumn("_p", F.substring("h", 1, 3))
    sizes = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(W.partitionBy("_p").orderBy("h")) - 1
    level = ordered.withColumn("_i", place).join(base, "_p").select((F.col("_base") + F.col("_i")).alias("i"), "h")
    n = level.count()
    while n > 1:
        pair = F.sort_array(F.collect_list(F.struct("i", "h")))
        met = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(pair.alias("p"))
        joined = F.concat(F.col("p")[0]["h"], F.element_at("p", -1)["h"])
        level = met.select("i", F.sha2(joined, 256).alias("h"))
        n = (n + 1) // 2
    return level.select(F.col("h").alias("root"))


def verify_chain(entries: DataFrame, seq: str, previous: str, own: str, content) -> DataFrame:
    """Entries that break the chain: a wrong digest of their own, of the one before, or a gap in seq.

    Chains of one log are one order; entries are dealt out in ranges of seq and only meet their neighbour.
    """
    link = entries.select((F.col(seq) + 1).alias("_next"), F.col(own).alias("_before"))
    met = entries.join(link, F.col(seq) == F.col("_next"), "left")
    first = entries.agg(F.min(seq)).first()[0]
    why = (
        F.when(F.col(own) != F.sha2(F.concat(F.col(previous), F.lit("|"), content), 256), "own digest")
        .when(F.col("_next").isNull() & (F.col(seq) != first), "gap")
        .when(F.col("_before") != F.col(previous), "previous digest")
    )
    return met.withColumn("broken", why).filter("broken is not null").select(seq, "broken")


#: Numbers of entries that lie in one slice of a log.
SLICE = 4_096


def verify_chains(entries: DataFrame, log: str, seq: str, previous: str, own: str, content) -> DataFrame:
    """(log, seq, broken) of entries that break the chain of their log: as verify_chain(), for many logs or one that holds nearly all entries.

    A log is cut into slices of SLICE numbers, and the last number of a slice is entered in the next one too, so an entry and the one numbered before it
    meet in one slice. Only entries that are broken or have none before them in their slice are stored; of the latter each but the first of its log
    follows a gap. Entries that come dealt out by log are not moved. An entry without a number is checked by its own digest only.
    """
    into = F.pmod(F.col(seq).cast("long"), F.lit(SLICE))
    start = F.col(seq).cast("long") - into
    slices = F.when(into == SLICE - 1, F.array(start, start + SLICE)).otherwise(F.array(start))
    forged = F.col(own) != F.sha2(F.concat(F.col(previous), F.lit("|"), content), 256)
    t = entries.select(log, seq, previous, own, F.coalesce(forged, F.lit(False)).alias("_forged"), start.alias("_start"), F.explode(slices).alias("_slice"))
    w = W.partitionBy(log, "_slice").orderBy(F.col(seq))
    last, alone = F.lag(seq).over(w), F.row_number().over(w) == 1
    t = t.withColumns({"_seq": last, "_own": F.lag(own).over(w), "_alone": alone & F.col(seq).isNotNull()}).filter(F.col("_slice").eqNullSafe(F.col("_start")))
    why = (
        F.when(F.col("_forged"), "own digest")
        .when(F.col(seq) != F.col("_seq") + 1, "gap")
        .when(F.col("_own") != F.col(previous), "previous digest")
    )
    found = checkpointed(t.withColumn("broken", F.when(F.col(seq).isNull() & ~F.col("_forged"), None).otherwise(why)).filter("broken is not null or _alone").select(log, seq, "_alone", "broken"))
    first = F.col(seq) == F.min(seq).over(W.partitionBy(log))
    alone = found.filter("_alone").withColumn("broken", F.coalesce("broken", F.when(~first, "gap")))
    return found.filter("not _alone").unionByName(alone).filter("broken is not null").select(log, seq, "broken")


def sign_hash(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """64 sign bits of a vector, as a long: bit k is that of the sum of the entries k, k + 64, k + 128 and so on; null without a vector."""
    at = lambda k: F.sequence(k, F.greatest(F.size(vector) - 1, k), F.lit(64))
    total = lambda k: F.aggregate(at(k), F.lit(0.0), lambda a, i: a + F.get(vector, i))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(total(k) > 0, "1").otherwise("0"))
    return df.select(id_column, F.when(F.col(vector).isNotNull(), F.conv(F.array_join(bits, ""), 2, -10).cast("long")).alias("hash"))


#: Values of a key that lie in one block, so that two blocks are a million pairs at most.
BLOCK = 1_000


def blocks(df: DataFrame, keys: list[str], value: str, single: bool = True) -> DataFrame:
    """(keys, block, values): the values of each key in order, BLOCK to an array; nulls are in none, nor, unless single, keys of one value."""
    w = W.partitionBy(*keys).orderBy(value)
    placed = df.filter(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(w).alias("_place"), F.lead(value).over(w).alias("_next"))
    kept = placed if single else placed.filter("_place > 1 or _next is not null")
    return kept.groupBy(*keys, F.floor((F.col("_place") - 1) / BLOCK).alias("block")).agg(F.collect_list(value).alias("values"))


def met(held: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xs, ys): every two blocks of a key and each with itself, held being blocks() as stored. Where x < y, a pair of values is made once."""
    alone = held.filter("size(values) > 1").select(*keys, F.col("values").alias("xs"), F.col("values").alias("ys"))
    before = held.select(*keys, F.col("block").alias("_before"), F.col("values").alias("xs"))
    after = held.filter("block > 0").select(*keys, "block", F.col("values").alias("ys"))
    return alone.unionByName(before.hint("merge").join(after, keys).filter("_before < block").select(*keys, "xs", "ys"))


def near_codes(codes: DataFrame, most: int = 6) -> DataFrame:
    """(x, y, distance), x < y: pairs of distinct hashes that differ in at most so many bits, as near_hashes() finds them.

    Hashes that agree in three bands are compared block by block, dealt out by the comparisons, as they are before by their entries; a pair is taken from the first three bands it agrees in.
    """
    n = most + 3
    cuts = [round(64 * k / n) for k in range(n + 1)]
    masks = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(n)]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    chosen = list(combinations(range(n), 3))
    keys = F.array(*(F.struct(F.lit(i).alias("bands"), F.col("hash").bitwiseAND(signed(sum(masks[k] for k in three))).alias("bits")) for i, three in enumerate(chosen)))
    entered = spread(codes, F.lit(len(chosen)), most=4_000_000).select("hash", F.inline(keys))
    held = checkpointed(blocks(entered, ["bands", "bits"], "hash", single=False))
    dealt = spread(met(held, ["bands", "bits"]).select("bands", "xs", "ys"), F.size("xs").cast("long") * F.size("ys"), most=20_000_000)
    pairs = dealt.select("bands", F.explode("xs").alias("x"), "ys").select("bands", "x", F.explode("ys").alias("y"))
    apart = F.col("x").bitwiseXOR(F.col("y"))
    earlier = F.array(*(F.array(*(signed(masks[k]) for k in range(three[-1]) if k not in three)).cast("array<long>") for three in chosen))
    first = F.forall(F.get(earlier, F.col("bands")), lambda m: apart.bitwiseAND(m) != 0)
    distance = F.bit_count(apart)
    return pairs.filter("x < y").filter(distance <= most).filter(first).select("x", "y", distance.alias("distance"))


def near_hashes(hashes: DataFrame, id_column: str, most: int = 6) -> DataFrame:
    """Pairs of ids whose hashes differ in at most so many bits.

    The 64 bits fall into most + 3 bands. At most that many bits differ, so three bands at least agree, and each hash
    is entered under every three of its bands, about 21 bits for 6. Only distinct hashes meet; each pair of
    them stands for all pairs of their ids, and equal ones are paired at distance 0. Null hashes are in none. Ids are held
    in blocks and dealt out by the pairs they become, which are made last. No join may send a side to all tasks: an array becomes more than Spark reckons.
    """
    members = checkpointed(blocks(hashes.filter("hash is not null"), ["hash"], id_column))
    side = lambda h, ids: members.select(F.col("hash").alias(h), F.col("values").alias(ids))
    near = near_codes(members.filter("block = 0").select("hash"), most)
    apart = near.hint("merge").join(side("x", "xs"), "x").hint("merge").join(side("y", "ys"), "y").select("xs", "ys", "distance")
    same = met(members, ["hash"]).select("xs", "ys", F.lit(0).alias("distance"))
    dealt = spread(apart.unionByName(same), F.size("xs").cast("long") * F.size("ys"))
    pairs = dealt.select("distance", F.explode("xs").alias("p"), "ys").select("distance", "p", F.explode("ys").alias("q"))
    pairs = pairs.filter("p < q or (distance > 0 and p > q)")
    return pairs.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"), "distance")


def perceptual(pairs: DataFrame) -> DataFrame:
    """pairs with hashes a_1, d_1, p_1 and a_2, d_2, p_2 (long), with the three distances and a verdict.

    identical: all alike; near: two distances of 6 bits at most; similar: two of 12; else different.
    """
    far = [F.bit_count(F.col(f"{h}_1").bitwiseXOR(F.col(f"{h}_2"))) for h in "adp"]
    within = lambda k: sum((f <= k).cast("int") for f in far)
    same = (far[0] == 0) & (far[1] == 0) & (far[2] == 0)
    verdict = F.when(same, "identical").when(within(6) >= 2, "near").when(within(12) >= 2, "similar").otherwise("different")
    return pairs.select("*", *(f.alias(f"far_{h}") for f, h in zip(far, "adp", strict=True)), verdict.alias("verdict"))


def screening_rates(screened: DataFrame) -> DataFrame:
    """One row: files, those of each verdict, and the share that known good sets take off the examiner's list."""
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    out = screened.agg(F.count(F.lit(1)).alias("files"), count("known-bad").alias("bad"), count("known-good").alias("good"))
    return out.withColumn("suppression", F.round(F.when(F.col("files") > 0, F.col("good") / F.col("files")).otherwise(0.0), 4))


def clusters(matches: DataFrame) -> DataFrame:
    """(node, root): images joined by matches (id_a, id_b, verdict) that are identical or near, by the smallest id."""
    close = matches.filter(F.col("verdict").isin("identical", "near"))
    return components(edges(close, "id_a", "id_b"))


def manifest(files: DataFrame, id_column: str, digest: str) -> DataFrame:
    """(id, digest, root): the seal of a dataset, its digests and their Merkle root."""
    return beside(files.select(id_column, F.col(digest).alias("digest")), merkle_root(files, digest))


def broken_seal(files: DataFrame, sealed: DataFrame, id_column: str, digest: str) -> DataFrame:
    """(id, broken): what a manifest lists and files lack, have anew, or have otherwise."""
    now = files.select(id_column, F.col(digest).alias("_now"))
    met = sealed.select(id_column, F.col("digest").alias("_then")).join(now, id_column, "full")
    why = F.when(F.col("_now").isNull(), "missing").when(F.col("_then").isNull(), "added").when(F.col("_now") != F.col("_then"), "changed")
    return met.select(id_column, why.alias("broken")).filter("broken is not null")

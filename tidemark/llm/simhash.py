"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, UPPER, dropped, modest_batches, names_apart, others, rows_under, stored, swept, table
from .components import components

SEED = 42
#: Bytes of text whose shingles are in memory at once.
PIECE = 1 << 20
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Most rows of ids and digests that are broadcast, about 150 bytes each.
MOST_BROADCAST = 400_000


def pieces(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Words of the lower-cased text, in lists of about piece bytes."""
    at = 0
    while at < len(text):
        end = min(len(text), at + piece)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].translate(LOWERED).split()
        at = end


def shingle_hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 of each k-word shingle, repeats included; of the whole sequence if it has fewer words."""
    carry: list[bytes] = []
    any_yet = False
    for words in pieces(text):
        words = carry + words
        if len(words) >= k:
            any_yet = True
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            h = xxhash.xxh64_intdigest
            spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
            yield np.array([h(line[a:b], SEED) for a, b in spans], dtype=np.uint64)
        carry = words[max(0, len(words) - k + 1) :] if k > 1 else []
    if not any_yet and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def majority(counts: np.ndarray, n: int) -> int:
    """The bits set in over half of n hashes, as a signed 64-bit number."""
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def simhash(text: bytes | None, k: int) -> int:
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text or b"", k):
        counts += bit_counts(hashes)
        n += len(hashes)
    return majority(counts, n) if n else 0


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """docs without its text, with fingerprint (long). Null and wordless texts get 0. Nothing is shuffled."""
    keep = others(docs, ("text", "fingerprint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("_text"))
            made = pa.array((simhash(t.as_py(), shingle_words) for t in texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), made], [*keep, "fingerprint"])

    given = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    return given.mapInArrow(run, StructType([*given.schema.fields[:-1], StructField("fingerprint", LongType())]))


def segment_counts(fp: Column) -> Column:
    """Bit counts of the 21 segments of 3 bits, each in the 3 bits of its segment, and the last bit as it is."""
    low = F.lit(sum(1 << 3 * s for s in range(21)))
    counts = fp.bitwiseAND(low) + F.shiftrightunsigned(fp, 1).bitwiseAND(low) + F.shiftrightunsigned(fp, 2).bitwiseAND(low)
    return counts.bitwiseOR(fp.bitwiseAND(F.lit(-1 << 63)))


def nearby_cells(cell: Column) -> Column:
    """The cell and those whose counts differ by one in one segment."""
    found = [cell, cell.bitwiseXOR(F.lit(-1 << 63))]
    for s in range(21):
        n, one = F.shiftrightunsigned(cell, 3 * s).bitwiseAND(F.lit(7)), F.lit(1 << 3 * s)
        found += [F.when(n < 3, cell + one), F.when(n > 0, cell - one)]
    return F.array_compact(F.array(*found))


def links(distinct_fingerprints: DataFrame) -> DataFrame:
    """(u, v), v < u, for fingerprints that differ in at most 2 bits, enough of them to connect all such pairs.

    A fingerprint becomes the vector of its 22 segments' bit counts. Two that differ in d bits are at a
    Manhattan distance of d at most, so a pair within 2 has a grid cell within 1 of both vectors: each fingerprint is
    entered in the cell of its own vector and the up to 43 cells beside it, and those that meet in a cell are
    candidates. Cells of two, nearly all that have company, give their pair, which is then verified bit by bit.

    Crowded cells are refined to the points in them: a pair within 2 bits has a bit string within 1 bit of both,
    and the cell of that string is one in which the pair meets. So each fingerprint enters a crowded cell under those
    of itself and its one-bit changes that lie in the cell, and is verified against the smallest under the same
    string. At most 65 meet there, so no pairs of a cell are listed and what is made grows with the rows alone,
    however many fingerprints crowd one spot.
    """
    fps = distinct_fingerprints.select(F.col("fingerprint").alias("f"))
    entries = fps.select("f", F.explode(nearby_cells(segment_counts(F.col("f")))).alias("cell"))
    cells = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("v"), F.max("f").alias("u"))
    cells = stored(cells.filter("n > 1"), "cells")
    pairs = cells.filter("n = 2").select("u", "v")
    crowded = cells.filter("n > 2").select("cell")
    crowded = F.broadcast(crowded) if rows_under(crowded, MOST_BROADCAST) else crowded
    flips = [F.lit(0).cast("long"), *(F.lit(j) for j in ((1 << j) - (1 << 64) * (j == 63) for j in range(64)))]
    points = fps.select("f", F.explode(F.transform(F.array(*flips), lambda x: F.col("f").bitwiseXOR(x))).alias("point"))
    points = points.withColumn("cell", segment_counts(F.col("point"))).join(crowded, "cell", "left_semi")
    met = points.groupBy("point").agg(F.sort_array(F.collect_list("f")).alias("all")).filter(F.size("all") > 1)
    rest = met.select(F.explode(F.slice("all", F.lit(2), F.size("all"))).alias("u"), F.col("all")[0].alias("v"))
    verified = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    return pairs.unionByName(rest).filter(verified).distinct()


def grouped(marked: DataFrame) -> DataFrame:
    """marked (doc_id, fingerprint, ...) with component_id, the smallest doc_id reachable over links.

    Repeated fingerprints are one node; a null doc_id takes part but is never a component_id unless its
    component has no other.
    """
    groups = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("_first"))
    groups = stored(groups, "groups")
    roots = components(links(groups)).select(F.col("node").alias("fingerprint"), F.col("root").alias("_root"))
    named = groups.join(roots, "fingerprint", "left").withColumn("_root", F.coalesce("_root", "fingerprint"))
    least = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = named.join(least, "_root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint")


@names_apart
def near_duplicates(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """docs without text, with fingerprint (long) and component_id.

    docs: doc_id, text and any other columns, of which those named like the new ones are replaced.
    Null, empty and wordless texts have fingerprint 0 and are linked like any other; repeated rows get one
    component; an empty table gives an empty one. Texts are read once and never shuffled.
    """
    docs = docs.drop("fingerprint", "component_id")
    return grouped(stored(fingerprints(docs, shingle_words), "fingerprints"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, 3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


#: One text of so many is read for common shingles; most of those that are kept, and times in the sample to be one.
SAMPLED, MOST_COMMON, COMMON = 16, 200_000, 4


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n distinct sorted hashes, in one order for all texts.

    The order is by times in the table of common hashes (sorted, 0 for others), then by hash. Two sets as similar as asked
    have a hash in both prefixes whatever the order is, so the table only keeps common shingles from being keys.
    A set without hashes gets one key of its own.
    """
    n = len(hashes)
    if not n:
        return np.zeros(1, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.argsort(np.where(common[at] == hashes, times[at], 0), kind="stable")]
    return hashes[: n - math.ceil(similarity * n - 1e-9) + 1].view(np.int64)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    parts = list(shingle_hashes(text or b"", k))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.uint64)


def set_and_simhash(text: bytes | None, k: int) -> tuple[np.ndarray, int]:
    """What shingle_set() and simhash() give, the shingles being hashed once."""
    parts, counts, n = [], np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text or b"", k):
        counts += bit_counts(hashes)
        n += len(hashes)
        parts.append(hashes)
    return (np.unique(np.concatenate(parts)), majority(counts, n)) if n else (np.empty(0, dtype=np.uint64), 0)


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """(u, v) of nodes (node, fingerprint): enough links to connect all whose fingerprints differ in at most 2 bits.

    Nodes of one fingerprint are linked with the smallest of them, and those by links().
    """
    least = stored(nodes.groupBy("fingerprint").agg(F.min("node").alias("v")), "fingerprints")
    same = nodes.join(least, "fingerprint").filter("node <> v").select(F.col("node").alias("u"), "v")
    named = lambda x: least.select(F.col("fingerprint").alias(x), F.col("v").alias(f"node_{x}"))
    apart = links(least).join(named("u"), "u").join(named("v"), "v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
    return same.unionByName(apart)


def parities(hashes: np.ndarray) -> np.ndarray:
    """512 bits, one for each value of a hash's first 9 bits: whether an odd number of the set's hashes have it."""
    n = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=512)
    return np.packbits((n & 1).astype(np.uint8), bitorder="little").view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def similar(pairs: Iterator[pa.RecordBatch], shingle_words: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(u, v) of the pairs (u, v, a, b) whose texts a and b are similar enough; b comes in runs."""
    last, known = None, None
    for p in pairs:
        keep = []
        v = p.column(1).to_pylist()
        for k in range(p.num_rows):
            if v[k] != last:
                last, known = v[k], shingle_set(p.column(3)[k].as_py(), shingle_words)
            keep.append(jaccard(shingle_set(p.column(2)[k].as_py(), shingle_words), known) >= similarity)
        yield p.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def common_shingles(given: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that are common in a sample of the texts, and how often they are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), shingle_words).view(np.int64))], ["h"])

    sample = given.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "h long")
    found = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON)
    rows = found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect()
    hashes = np.array([r.h for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r.n for r in rows], dtype=np.int64)[order]


def may_be_similar(similarity: float) -> Column:
    """Whether sets of n_a and n_b hashes that share the one at pos_a and pos_b can be similar enough."""
    n, m = F.col("n_a"), F.col("n_b")
    most = F.least("pos_a", "pos_b") + 1 + F.least(n - F.col("pos_a"), m - F.col("pos_b")) - 1
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (most >= similarity / (1 + similarity) * (n + m) - 1e-9)


def few_differ(similarity: float) -> Column:
    """Whether sets of n_a and n_b hashes with the parities bits_a and bits_b can be similar enough.

    A hash that only one of two sets has changes one parity, so no fewer hashes differ than parities do.
    """
    apart = sum(F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(8))
    return apart <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-9


def near_copies(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, node, first_id, stays) for every row of docs: node is the MD5 of its text, first_id the smallest
    doc_id of its group, stays whether the row is the one of that id.

    Texts whose SimHashes differ in at most 2 bits are linked by the grid range-join of near_duplicates() (see links()), bits
    verified exactly; so are texts with a Jaccard similarity of their shingle sets of at least similarity. Groups are what is
    connected by either. At that similarity SimHashes of whole texts differ in about ten bits, which no
    range-join on bit counts can find at a bearable size; so beyond the 2 bits texts are candidates if they share a shingle of
    their prefixes (see prefix()) and lengths, places and parities of their sets (see few_differ()) allow for the similarity,
    which leaves out no pair.
    Shingle sets of candidates are compared exactly. First the others of a key are compared with its smallest text, then with its
    largest one, and at last the pairs of a key are listed and compared, all of them; but for those whose texts are in one group
    by then, of SimHashes or of sets, as these need no comparing.

    Equal texts are one node before all that. Null and empty texts are equal in having no shingles and are
    one group; a null doc_id is after all others; rows repeated in full all have the same stays; an empty
    table gives an empty one.
    """
    modest_batches(docs.sparkSession)
    node = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    given = docs.select("doc_id", node.alias("node"), F.col("text").cast("binary").alias("text"))
    common, times = common_shingles(given, shingle_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, prints = zip(*(set_and_simhash(t.as_py(), shingle_words) for t in b.column(2)), strict=True) if b.num_rows else ((), ())
            keys = pa.array([prefix(x, similarity, common, times) for x in sets], pa.list_(pa.int64()))
            n = pa.array([len(x) for x in sets], pa.int32())
            bits = pa.array([parities(x) for x in sets], pa.list_(pa.int64()))
            prints = pa.array(prints, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, bits, prints, keys], ["doc_id", "node", "n", "bits", "fingerprint", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(given.mapInArrow(run, f"doc_id {kind}, node binary, n int, bits array<long>, fingerprint long, keys array<long>"), "prefixes")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min_by(F.struct("n", "bits", "fingerprint"), "n").alias("set"))
    nodes = stored(nodes.select("node", "first", "set.n", "set.bits", "set.fingerprint"), "texts").withColumn("t", F.xxhash64("node"))
    sets = nodes.select("t", "n", "bits")
    # t only finds candidates; texts with the same t are all compared
    entries = rows.select(F.xxhash64("node").alias("t"), "n", F.posexplode("keys").alias("pos", "key"))
    ends = entries.groupBy("key").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo < hi")
    entries = stored(entries.join(ends, "key").select("key", "t", "n", "pos").distinct(), "entries")
    whose = stored(rows.select("doc_id", "node"), "ids")
    dropped(rows)
    swept(docs.sparkSession)

    def few_apart(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (ta, tb) whose parities allow for the similarity; these meet the pairs and not the entries of keys."""
        for x in "ab":
            pairs = pairs.join(sets.select(F.col("t").alias(f"t{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), f"t{x}")
        return pairs.filter(few_differ(similarity)).select("ta", "tb").distinct()

    def compared(pairs: DataFrame) -> DataFrame:
        """(u, v) of the pairs (ta, tb) that are similar enough."""
        wanted = pairs.select(F.explode(F.array("ta", "tb")).alias("t")).distinct().join(nodes, "t").select("node", "first")
        wanted = stored(wanted, "wanted")  # the texts are read from both sides
        small = rows_under(wanted, MOST_BROADCAST)
        same = given["node"].eqNullSafe(F.col("_node")) & given["doc_id"].eqNullSafe(F.col("first"))
        wanted = wanted.withColumnRenamed("node", "_node")
        texts = given.join(F.broadcast(wanted) if small else wanted, same, "left_semi").select("node", "text")
        texts = texts.withColumn("t", F.xxhash64("node"))
        left = pairs.join(texts.select(F.col("t").alias("ta"), F.col("node").alias("u"), F.col("text").alias("a")), "ta")
        right = texts.select(F.col("t").alias("tb"), F.col("node").alias("v"), F.col("text").alias("b"))
        both = left.join(right, "tb").select("u", "v", "a", "b")
        return stored(both.mapInArrow(lambda it: similar(it, shingle_words, similarity), "u binary, v binary"), "linked")

    side = lambda df, x: df.select("key", *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "key"))
    pair = (F.col("t_a").alias("ta"), F.col("t_b").alias("tb"))
    by_bits = stored(fingerprint_links(nodes), "linked")
    swept(docs.sparkSession)
    live, linked, known = entries.withColumn("root", F.col("t")), None if by_bits.isEmpty() else by_bits, None
    for centre in ("min", "max", None):
        grouped_already = linked is not None and centre != "min"
        if grouped_already:
            # of keys whose texts are in several groups, the entries with their groups
            roots = components(linked).select(F.xxhash64("node").alias("t"), F.xxhash64("root").alias("root"))
            roots = stored(roots.groupBy("t").agg(F.min("root").alias("root")), "roots")
            live = entries.join(roots, "t", "left").withColumn("root", F.coalesce("root", "t"))
            several = live.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
            live = live.join(several.select("key"), "key", "left_semi")
        own = grouped_already or not centre
        if own:
            live = stored(live if centre else live.join(sets.select("t", "bits"), "t"), "live")
        if centre:
            middle = live.groupBy("key").agg((F.min if centre == "min" else F.max)("t").alias("t"))
            some = side(live.join(middle, ["key", "t"]), "b")
            pairs = side(live, "a").join(some, "key").filter(F.col("root_a") != F.col("root_b"))
        else:
            # all but the largest group of a key meet everyone
            counted = live.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
            main = counted.agg(F.max(F.struct("n", "root"))["root"].alias("main"))
            some = side(live, "a").join(main, "key").filter("root_a <> main")
            pairs = some.join(side(live, "b"), "key").filter("root_a <> root_b and (root_b = main or root_a < root_b)")
        # all pairs of a key are weeded out where they meet, so that no more of them than may be similar are ever rows
        may = may_be_similar(similarity) if centre else may_be_similar(similarity) & few_differ(similarity)
        pairs = pairs.filter(may).select(F.least(*pair).alias("ta"), F.greatest(*pair).alias("tb")).distinct()
        pairs = few_apart(pairs) if centre else pairs
        pairs = stored(pairs if known is None else pairs.join(known, ["ta", "tb"], "left_anti"), "pairs")
        if own:
            dropped(live)
        swept(docs.sparkSession)
        if pairs.isEmpty():
            continue
        found = compared(pairs)
        swept(docs.sparkSession)
        linked = found if linked is None else linked.unionByName(found)
        known = pairs if known is None else known.unionByName(pairs)
    named = nodes.select("node", "first")
    if linked is None:
        named = named.withColumn("root", F.col("node"))
    else:
        named = stored(named.join(components(linked), "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    # the smallest id of a group, nulls last, and the text that has it
    place = F.struct(F.col("first").isNull().alias("none"), "first", "node")
    best = named.groupBy("root").agg(F.min(place).alias("best"))
    named = named.join(best, "root").select("node", F.col("best.first").alias("first_id"), F.col("best.node").alias("_best"))
    stays = (F.col("node") == F.col("_best")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    return whose.join(named, "node").select("doc_id", "node", "first_id", stays.alias("stays"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, once.

    Null and empty texts are one group, of which one stays; a null doc_id stays only if its group has no other; of rows
    with that doc_id and text one stays, where other columns differ the one of the least hash of them (maps apart); an empty table
    gives an empty one; extra columns stay as they are, whatever their names.
    """
    return first_of_group(docs)


@names_apart
def first_of_group(docs: DataFrame) -> DataFrame:
    found = stored(near_copies(docs).filter("stays").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n")), "staying")
    keep = found.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    keep = F.broadcast(keep) if rows_under(keep, MOST_BROADCAST) else keep
    marked = docs.withColumn("_text", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    kept = marked.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_node")), "left_semi")
    if not found.filter("n > 1").isEmpty():
        tied = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, (MapType, VariantType))]
        kept = kept.withColumn("_tie", F.xxhash64(*tied))
        least = kept.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_node")).agg(F.min("_tie").alias("_least"))
        first = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_node")) & (F.col("_tie") == F.col("_least"))
        kept = kept.join(least, first, "left_semi").dropDuplicates(["doc_id", "_text"])
    return kept.select(docs.columns)

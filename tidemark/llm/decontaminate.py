"""Benchmark decontamination: windows joined on their rarest shingle, exact containment of item windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import modest_batches, names_apart, others, rows_under, stored, table

WINDOW = 10
SHINGLE = 3
#: Bytes of text whose words are in memory at once.
PIECE = 1 << 20
#: Most bits of the filter that is sent to the tasks, 4 MB.
MOST_BITS = 1 << 25
#: Rows of hashes, or bytes of found spans and items, that are broadcast at most.
MOST_ROWS, MOST_BYTES = 400_000, 24 << 20
#: Windows of the benchmark that leave a task in one batch.
BATCH = 20_000
#: A-Z to a-z; all other ASCII but letters and digits to spaces; bytes over 0x7F are parts of words.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
#: Odd, so that powers have inverses modulo 2 ** 64.
BASE, FACTOR, LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of BASE and of its inverse modulo 2 ** 64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def at_least(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(16, n.bit_length())
            for name, base in (("up", BASE), ("down", np.uint64(pow(int(BASE), -1, 1 << 64)))):
                line = np.full(size, base, dtype=np.uint64)
                line[0] = 1
                setattr(self, name, np.cumprod(line))


class Words:
    """Words of some folded text: where they start and end, and a 64-bit hash of each, all made for the whole text at once.

    A word's hash is the sum of its bytes times powers of BASE, from a running sum over the text, mixed with its length.
    """

    def __init__(self, text: bytes, powers: Powers):
        self.text = text.translate(FOLD)
        line = np.frombuffer(self.text, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([32], line, [32])) != 32))
        self.starts, self.ends = edges[::2], edges[1::2]
        powers.at_least(len(line) + 1)
        total = np.zeros(len(line) + 1, dtype=np.uint64)
        np.cumsum((line.astype(np.uint64) + np.uint64(1)) * powers.up[: len(line)], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * powers.down[self.starts]
        h ^= (self.ends - self.starts).astype(np.uint64) * LENGTH
        self.hashes = (h ^ (h >> np.uint64(32))) * FACTOR

    def __len__(self) -> int:
        return len(self.starts)

    def listed(self, a: int, b: int) -> list[str]:
        return self.text[self.starts[a] : self.ends[b - 1]].decode().split()

    def codes(self, s: int) -> np.ndarray:
        """A 64-bit code of each run of s words."""
        n = max(0, len(self) - s + 1)
        made = np.full(n, s, dtype=np.uint64) * LENGTH
        for k in range(s):
            made = (made ^ self.hashes[k : k + n]) * FACTOR
            made ^= made >> np.uint64(29)
        return made.view(np.int64)


def stretches(text: bytes, before: int, after: int, powers: Powers, piece: int = PIECE) -> Iterator[tuple[Words, int, int, int]]:
    """(words, at, lo, hi): words of a text from the at-th on, of which those at lo to hi - 1 come for the first time.

    Around those are before words and after words, where the text has as many. Together the stretches cover the text.
    """
    begin = stop = at = done = 0
    while True:
        end = min(len(text), stop + piece)
        while end < len(text) and FOLD[text[end]] != 32:
            end += 1
        ws = Words(text[begin:end], powers)
        last = end >= len(text)
        hi = at + len(ws) if last else max(done, at + len(ws) - after)
        if hi > done:
            yield ws, at, done - at, hi - at
        if last:
            return
        done, stop = hi, end
        gone = max(0, done - before - at)
        begin, at = begin + int(ws.starts[gone]) if gone < len(ws) else end, at + gone


def item_windows(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """(item, words, s, codes) of each window of the items (item, text): its words, spaces between, and its shingles' codes."""
    powers = Powers()
    for b in batches:
        for item, text in zip(b.column(0), b.column(1), strict=True):
            ws = Words(text.as_py() or b"", powers)
            if not len(ws):
                continue
            n = min(len(ws), window)
            s = min(n, shingle)
            codes = ws.codes(s)
            for at in range(0, len(ws) - n + 1, BATCH):
                to = min(at + BATCH, len(ws) - n + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item.as_py()] * (to - at), pa.string()),
                        pa.array([" ".join(ws.listed(i, i + n)) for i in range(at, to)]),
                        pa.array([s] * (to - at), pa.int32()),
                        pa.array([codes[i : i + n - s + 1] for i in range(at, to)], pa.list_(pa.int64())),
                    ],
                    ["item", "words", "s", "codes"],
                )


class Filter:
    """A set of bits, one for each code: where it is clear, a code is not among them.

    It saves the shuffle of shingles that the benchmark doesn't have; those it lets through by chance find no
    partner in the join. Its size is bounded: it is collected and sent to the tasks as bytes.
    """

    def __init__(self, codes: DataFrame, most_bits: int):
        n = codes.count()
        self.size = max(64, min(most_bits, 1 << (16 * n).bit_length()))
        at = F.col("code").bitwiseAND(F.lit(self.size - 1))
        bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
        found = codes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        bits = np.zeros(self.size // 64, dtype=np.int64)
        bits[found["word"].to_numpy()] = found["bits"].to_numpy()
        self.shared = codes.sparkSession.sparkContext.broadcast(bits.tobytes())

    def tester(self):
        """A function for tasks: places of the codes that may be in the set."""
        shared, size = self.shared, self.size

        def test(codes: np.ndarray) -> np.ndarray:
            bits = np.frombuffer(shared.value, dtype=np.uint64)
            at = codes.view(np.uint64) & np.uint64(size - 1)
            return np.flatnonzero((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))

        return test


@F.arrow_udf(LongType())
def count_words(texts: pa.Array) -> pa.Array:
    """Words of each text, counted over the bytes of about PIECE at once; none in a null."""
    n = len(texts)
    made = np.zeros(n, dtype=np.int64)
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], dtype=wide)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    every, fold = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8), np.frombuffer(FOLD, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE)) - 1)
        inside = fold[every[ends[at] : ends[to]]] != 32
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        some = at + np.flatnonzero(ends[at + 1 : to + 1] > ends[at:to])  # rows that aren't empty
        begins = ends[some] - ends[at]
        first[begins] = inside[begins]  # the text before may have ended in a word
        if len(some):
            made[some] = np.add.reduceat(first, begins, dtype=np.int64)
        at = to
    made[np.asarray(texts.is_null())] = 0
    return pa.array(made, pa.int64())


def text_key() -> tuple[Column, Column]:
    return F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")


def counted(docs: DataFrame, sizes: list[int], known: Filter) -> DataFrame:
    """(code, n): of the known codes, those in texts of docs, and how many rows of docs have them."""
    test = known.tester()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            found = []
            for t in b.column(0):
                own = []
                for ws, _, lo, hi in stretches(t.as_py() or b"", 0, max(sizes), powers):
                    for s in sizes:
                        codes = ws.codes(s)[lo:hi]
                        own.append(codes[test(codes)])
                if own:
                    found.append(np.unique(np.concatenate(own)))
            codes, n = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    texts = docs.select(F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, sizes: list[int], window: int, known: Filter) -> DataFrame:
    """(t1, t2, pos, code, lead, around) for each place of a text where one of the known codes may be.

    pos is the shingle's place in words; around holds the words near it, lead of them before it, as many as a
    window with that shingle can reach.
    """
    test = known.tester()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            rows: list[tuple] = []
            for k, t in enumerate(b.column(2)):
                for ws, at, lo, hi in stretches(t.as_py() or b"", window, 2 * window, powers):
                    for s in sizes:
                        codes = ws.codes(s)[lo:hi]
                        for p in test(codes).tolist():
                            i = lo + p
                            a = max(0, i - window)
                            rows.append((k, at + i, int(codes[p]), i - a, ws.listed(a, min(i + window, len(ws)))))
            which = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(which), b.column(1).take(which), *(pa.array([r[c] for r in rows], kind) for c, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.list_(pa.string()))))],
                ["t1", "t2", "pos", "code", "lead", "around"],
            )

    texts = docs.select(*(c.alias(n) for c, n in zip(text_key(), ("t1", "t2"), strict=True)), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "t1 long, t2 long, pos long, code long, lead int, around array<string>")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, pos, n, words): the places where a window of the benchmark stands in a text; (item, words): whose it is."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    found = items.mapInArrow(lambda it: item_windows(it, window, shingle), "item string, words string, s int, codes array<long>")
    windows = stored(found, "windows")
    sizes = sorted(r["s"] for r in windows.select("s").distinct().collect())  # no more than shingle
    if not sizes:
        return spark.createDataFrame([], "t1 long, t2 long, pos long, n int, words string"), windows.select("item", "words")
    each = windows.groupBy("words").agg(F.first("codes").alias("codes")).select("words", F.posexplode("codes").alias("off", "code"))
    often = counted(docs, sizes, Filter(each.select("code").distinct(), most_bits))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "code", "off")
    rarest = each.join(often, "code", "left").groupBy("words").agg(F.min(rarity).alias("least"))
    prefix = rarest.filter("least.n > 0").select("words", "least.code", "least.off", (F.size(F.split("words", " "))).alias("n"))
    prefix = stored(prefix, "prefixes")
    place = candidates(docs, sizes, window, Filter(prefix.select("code").distinct(), most_bits))
    met = place.join(F.broadcast(prefix) if rows_under(prefix, MOST_ROWS // 4) else prefix, "code").filter("off <= lead and lead - off + n <= size(around)")
    same = F.concat_ws(" ", F.slice("around", F.col("lead") - F.col("off") + 1, F.col("n"))) == F.col("words")
    hits = met.filter(same).select("t1", "t2", (F.col("pos") - F.col("off")).alias("pos"), "n", "words").distinct()
    return stored(hits, "hits"), windows.select("item", "words")


def joined_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spans): the spans (start, end) of each key in order and apart, those that meet or overlap as one.

    A span begins a new one if it starts after all ends before it; those are numbered by a running sum and joined by a group, so
    that the work grows with the number of spans, and only what is apart is gathered.
    """
    order = W.partitionBy(*keys).orderBy("start", "end")
    far = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = spans.withColumn("_new", F.when(F.col("start") > far, 1).otherwise(0))
    numbered = new.withColumn("_of", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    apart = numbered.groupBy(*keys, "_of").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return apart.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


@names_apart
def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most_bits: int = MOST_BITS
) -> DataFrame:
    """docs with n_words (long), spans (array of start and end, in words) and items (array of string).

    spans are the parts of the text inside occurrences of item windows, in order and apart; items the ids
    whose windows occur, sorted as strings. A window is so many consecutive words of an item, or all words
    of a shorter one. First the rows of docs that have each shingle of the benchmark are counted, over all
    rows; each window then needs only its rarest shingle, which is joined with the places of the texts that have it. Where
    position and length let the window stand there, its words are compared with the text's, all of them.

    Texts are read twice and known by two hashes, so equal ones are one; what is shuffled are shingles that pass a
    filter of most_bits bits at most, places with the words around them, and hits. Texts move only if they
    have to meet more hits than MOST_BYTES. A long text is read piece by piece; an item's words are in memory at once.

    Null, empty and wordless texts have no words and no hits; items without words have no windows; items of
    one id count once; a null item_id hits but isn't listed; repeated rows are judged one by one; columns of
    docs with the new names are replaced; an empty table on either side gives what it should: no rows, no hits.
    """
    kept = others(docs, ("n_words", "spans", "items"))
    hits, owners = occurrences(docs, benchmark, window, shingle, most_bits)
    keys = ["t1", "t2"]
    spans = joined_spans(hits.select(*keys, F.col("pos").alias("start"), (F.col("pos") + F.col("n")).cast("long").alias("end")), keys)
    items = hits.select(*keys, "words").distinct().join(owners.filter("item is not null").distinct(), "words")
    items = items.groupBy(*keys).agg(F.sort_array(F.collect_set("item")).alias("items"))
    of = stored(spans.join(items, keys, "left").select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "judged")
    held = of.agg(F.sum(64 + 32 * F.size("spans") + F.octet_length(F.array_join("items", "0123456789abcdef")))).first()[0] or 0
    of = F.broadcast(of) if held <= MOST_BYTES else of
    n_words = count_words(F.coalesce("text", F.lit("")))
    t1, t2 = text_key()
    made = docs.select(*kept, n_words.alias("n_words"), t1.alias("_k1"), t2.alias("_k2"))
    met = made.join(of, F.expr("_t1 = _k1 and _t2 = _k2"), "left")
    return met.select(*kept, "n_words", *(F.coalesce(c, F.array().cast(of.schema[c].dataType)).alias(c) for c in ("spans", "items")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS gram
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM d, lens,
  LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT dw.r, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.gram = iw.gram),
cov AS (SELECT r, count(*) AS n_hit FROM (
  SELECT DISTINCT r, p FROM (SELECT DISTINCT r, i, n FROM hit), LATERAL (SELECT unnest(range(i, i + n)) AS p)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go.

    Null, empty and wordless texts stay; a null doc_id is no matter; repeated rows go or stay together; an empty
    table gives an empty one; extra columns stay as they are, whatever their names.
    """
    modest_batches(spark)
    return without_hits(docs, table(spark, sf_dir, "benchmark"))


@names_apart
def without_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits, _ = occurrences(docs, benchmark, WINDOW, SHINGLE, MOST_BITS)
    hit = hits.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct()
    hit = F.broadcast(hit) if rows_under(hit, MOST_ROWS) else hit
    t1, t2 = text_key()
    marked = docs.select("*", t1.alias("_k1"), t2.alias("_k2"))
    return marked.join(hit, F.expr("_t1 = _k1 and _t2 = _k2"), "left_anti").select(docs.columns)

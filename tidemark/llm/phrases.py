"""Phrase collocation mining by dynamic itemset counting: cyclic scans of shards, lengths interleaved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, names_apart, stored, table

MIN_COUNT = 10
MOST_WORDS = 3
TOP = 2000
#: Percent of a phrase's occurrences that lie in one longer candidate, from which on the phrase goes.
ABSORBED = 50
SHARDS = 2
#: Buckets of the table of activations, a byte each, 16 MB.
BUCKETS = 1 << 24
#: Bytes of text that are split at once, and words that are counted at once.
PIECE, COUNTED = 1 << 20, 3 << 20
#: Words that a task tells apart by number at once.
MOST_KNOWN = 400_000
SEPARATOR, NOTHING, NEVER = 0, 1, 255
#: A-Z to a-z, what ends a piece to a line feed, a tab to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
FACTOR, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def code(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit codes of phrases from those of their first words and of their last word."""
    made = (prefix ^ (prefix >> SHIFT)) * FACTOR + word
    return (made ^ (made >> SHIFT)) * FACTOR


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, the number of each among them for every place, and how often each occurs."""
    order = np.argsort(keys)
    line = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
    n = np.diff(np.append(starts, len(line)))
    number = np.empty(len(line), dtype=np.int64)
    number[order] = np.repeat(np.arange(len(starts)), n)
    return line[starts], order[starts], number, n


class Known(dict):
    """Words of a language by number, in order of appearance, and their codes. 0 ends a piece, 1 is no word."""

    def __init__(self, lang: str):
        super().__init__({b"\n": SEPARATOR, b"": NOTHING})
        self.seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        self.words: list[bytes] = [b"", b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def codes(self, a: int) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w, self.seed) for w in self.words[a:]], dtype=np.uint64)

    def numbers(self, text: bytes) -> np.ndarray:
        """Numbers of the words of a folded text, with 0 between pieces."""
        tokens = text.replace(b"\n", b" \n ").split(b" ")
        made = np.fromiter(map(self.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        return made[made != NOTHING]


class Scan:
    """Counts of the active phrases in the texts of one language that a task reads in one step.

    steps: for each bucket of codes the step after which its first phrase reached the threshold, or NEVER. A phrase of one word is
    active from step 0 on, a longer one from the step after both of its subphrases' buckets have reached it and both are active
    themselves, each for shards steps. Phrases that share a bucket start early, so some are counted that need not be; but
    whatever is counted is counted in each shard once.
    """

    def __init__(self, lang: str, steps: np.ndarray, step: int, shards: int, most_words: int):
        self.lang, self.steps, self.step, self.shards, self.most_words = lang, steps, step, shards, most_words
        self.known, self.codes = Known(lang), np.zeros(0, dtype=np.uint64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> Iterator[pa.RecordBatch]:
        """Take a whole text."""
        text, at = text.translate(FOLD), 0
        while at < len(text):
            to = text.find(b" ", at + PIECE)  # a long text is split a piece at a time, between words
            to = len(text) if to < 0 else to
            made = self.known.numbers(text[at:to])
            self.held.append(made)
            self.size += len(made)
            at = to
            if at < len(text) and self.size >= COUNTED:
                yield from self.flush(self.most_words - 1)
        self.held.append(np.zeros(1, dtype=np.int32))
        self.size += 1
        if self.size >= COUNTED or len(self.known.words) > MOST_KNOWN:
            yield from self.flush()

    def flush(self, again: int = 0) -> Iterator[pa.RecordBatch]:
        """Counts of what is held. The last words, again of them, stay as the beginning of what follows and are marked as seen."""
        if not self.size:
            return
        line = np.concatenate(self.held)
        seen = getattr(self, "seen", 0)
        yield from self.counts(line, seen)
        rest = line[len(line) - min(again, len(line)) :] if again else line[:0]
        self.held, self.size, self.seen = [rest] if len(rest) else [], len(rest), len(rest)
        if len(self.known.words) > MOST_KNOWN:
            words = [self.known.words[i] for i in rest.tolist()]
            self.known, self.codes = Known(self.lang), np.zeros(0, dtype=np.uint64)
            if len(rest):
                self.held = [np.array([SEPARATOR if n == SEPARATOR else self.known[w] for n, w in zip(rest.tolist(), words, strict=True)], dtype=np.int32)]

    def counts(self, line: np.ndarray, seen: int) -> Iterator[pa.RecordBatch]:
        self.codes = np.concatenate([self.codes, self.known.codes(len(self.codes))])
        words = pa.array(self.known.words, pa.binary())
        # of each place the phrase that begins there: its number among those found, or -1 if it is no candidate
        number = np.where(line == SEPARATOR, -1, line).astype(np.int64)
        codes, start = self.codes, np.zeros(len(self.codes), dtype=np.int64)
        for k in range(1, self.most_words + 1):
            if k == 1:
                if self.step < self.shards:
                    n = np.bincount(line[seen:], minlength=len(words))
                    n[[SEPARATOR, NOTHING]] = 0
                    yield from self.rows(words, k, np.flatnonzero(n), n, start)
                    n[NOTHING] = n.sum()  # all words, as a phrase of none
                    yield from self.rows(words, 0, np.array([NOTHING]), n, start)
                first = np.arange(len(words))
            else:
                a, b = number[:-1], number[1:]
                at = np.flatnonzero((a >= 0) & (b >= 0))
                keys, first, inverse, n = grouped(a[at] << 32 | b[at])
                if not len(keys):
                    return
                first = at[first]
                start = np.maximum(reach[keys >> 32], reach[keys & 0xFFFFFFFF]) + 1
                due = np.flatnonzero((start <= self.step) & (self.step < start + self.shards))
                if seen >= k:  # those wholly in what was counted before
                    n -= np.bincount(inverse[at <= seen - k], minlength=len(keys))
                    due = due[n[due] > 0]
                yield from self.rows(words, k, due, n, start, [line[first + i] for i in range(k)])
                number = np.full(len(a), -1, dtype=np.int64)
                number[at] = inverse
                codes = code(codes[keys >> 32], self.codes[line[first + k - 1]])
            reach = self.steps[(codes & np.uint64(len(self.steps) - 1)).astype(np.int64)].astype(np.int64)
            if k < self.most_words:
                reached = reach != NEVER
                # a bucket's first phrase may have reached it before this one was counted at all
                reach = np.where(reached, np.maximum(reach, start), reach)
                if k == 1:
                    reached[[SEPARATOR, NOTHING]] = False
                number = np.where((number >= 0) & reached[number], number, -1)

    def rows(self, words: pa.Array, k: int, some: np.ndarray, n: np.ndarray, start: np.ndarray, places: list | None = None) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(some), 50_000):
            own = some[at : at + 50_000]
            parts = [words.take(pa.array(x[own])) for x in places] if places else [words.take(pa.array(own))]
            text = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())).cast(pa.string()) if k > 1 else parts[0].cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.lang] * len(own), pa.string()), text, pa.array(np.full(len(own), k, dtype=np.int32)), pa.array(start[own].astype(np.int32)), pa.array(n[own].astype(np.int64))],
                ["lang", "phrase", "k", "start", "n"],
            )


def scanned(texts: DataFrame, steps, step: int, shards: int, most_words: int) -> DataFrame:
    """(lang, phrase, k, start, n): counts of active phrases in the texts (lang, text) by task and part of a task; of all words, with k = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(steps.value, dtype=np.uint8)
        scans: dict[str, Scan] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if lang not in scans:
                    while len(scans) >= 16:  # a task holds the words of so many languages
                        yield from scans.pop(next(iter(scans))).flush()
                    scans[lang] = Scan(lang, table, step, shards, most_words)
                yield from scans[lang].add(text.as_py())
        for s in scans.values():
            yield from s.flush()

    return texts.mapInArrow(run, "lang string, phrase string, k int, start int, n long")


def bucket_bits(phrases: DataFrame, buckets: int) -> np.ndarray:
    """A flag for each bucket: whether one of the phrases (lang, phrase) is in it. Collected as pages of bits, buckets / 8 bytes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: dict[str, int] = {}
        for b in batches:
            made = np.zeros(b.num_rows, dtype=np.uint64)
            for i, (lang, phrase) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                seed = seeds.get(lang)
                if seed is None:
                    seeds[lang] = seed = xxhash.xxh64_intdigest(lang.encode(), 42)
                own = [np.array([xxhash.xxh64_intdigest(w, seed)], dtype=np.uint64) for w in phrase.encode().split(b" ")]
                c = own[0]
                for w in own[1:]:
                    c = code(c, w)
                made[i] = c[0]
            at = np.unique((made & np.uint64(buckets - 1)).astype(np.int64))
            word, bits = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            begins = np.flatnonzero(np.diff(word, prepend=-1)) if len(at) else np.zeros(0, np.int64)
            folded = np.bitwise_or.reduceat(bits, begins) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[begins]), pa.array(folded.view(np.int64))], ["word", "bits"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    line = np.zeros(buckets // 64, dtype=np.int64)
    line[found["word"].to_numpy()] = found["bits"].to_numpy()
    return np.unpackbits(line.view(np.uint8), bitorder="little").view(bool)


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, shards: int = SHARDS, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of all phrases of 1 to most_words words that occur min_count times or more, and (lang, n) of all words.

    docs: lang, text. The texts are dealt into shards that are scanned in turn, over and over; step t scans shard t modulo shards and
    counts the phrases that are active in it. Words are active from the start. A longer phrase becomes
    active once both subphrases, all words but the last and all but the first, have reached min_count in what is counted so
    far, and stays so for one full cycle. So phrases of several lengths are counted in one scan, and the last ones
    are done after most_words cycles at most. Counts so far are summed by phrase in a stored table of the phrases whose
    cycle isn't over; when it is over, only those that reached min_count are kept. What tasks know of
    the counts is a table of a fixed number of buckets (a power of two), which lets more phrases be counted but never fewer.
    """
    if buckets < 64 or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two of 64 or more")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), (F.monotonically_increasing_id() % shards).alias("shard"))
    parts = stored(texts, "texts", "shard")
    steps = np.full(buckets, NEVER, dtype=np.uint8)
    live, done, totals, step, last = None, None, None, 0, 0
    while step < shards or step <= last:
        shared = spark.sparkContext.broadcast(steps.tobytes())
        new = scanned(parts.filter(F.col("shard") == step % shards).select("lang", "text"), shared, step, shards, most_words)
        new = new.withColumn("reach", F.lit(None).cast("int"))
        both = new if live is None else live.unionByName(new)
        # tasks have counted by themselves already: rows are dealt out first and then summed, not summed twice
        dealt = both.repartition("lang", "phrase")
        summed = dealt.groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.max("start").alias("start"), F.sum("n").alias("n"), F.max("reach").alias("reach"))
        reach = F.when(F.col("n") >= min_count, F.coalesce("reach", F.lit(step)))
        over = F.col("start") == step - shards + 1
        # what has been counted in all shards and is rare is written no more
        summed = stored(summed.withColumn("reach", reach).filter(~over | (F.col("n") >= min_count) | (F.col("k") == 0)), "counts")
        shared.unpersist()
        fresh = summed.filter((F.col("reach") == step) & F.col("k").between(1, most_words - 1))
        flags = bucket_bits(fresh, buckets)
        if flags.any():
            steps = np.where(flags & (steps == NEVER), np.uint8(step), steps)
            last = step + shards
        ended = summed.filter(over)
        if step == shards - 1:
            totals = stored(ended.filter("k = 0 and n > 0").select("lang", "n"), "totals")
        kept = stored(ended.filter((F.col("n") >= min_count) & (F.col("k") > 0)).select("lang", "phrase", "k", "n"), "frequent") if step >= shards - 1 else None
        done = kept if done is None or kept is None else done.unionByName(kept)
        if live is not None:
            dropped(live_table)
        live_table, live = summed, summed.filter(~over)
        step += 1
    dropped(live_table)
    dropped(parts)
    return done, totals


def scored(phrases: DataFrame, most_words: int) -> DataFrame:
    """Of (lang, phrase, k, n): candidates (lang, phrase, k, a, l, r, score), those of two words or more, with their lowest-scoring cut.

    floor(1000000 * a * a / (l * r)) is taken in decimals of 38 digits, which hold counts up to 10 ** 16.
    """
    counts = phrases.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias("_n"))
    cuts = phrases.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = cuts.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", part(F.lit(1), F.col("cut")).alias("p1"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("p2"))
    met = lambda side, p, name: side.join(counts.withColumnRenamed("_n", name), (F.col("lang") == F.col("_lang")) & (F.col(p) == F.col("_phrase"))).drop("_lang", "_phrase", p)
    cuts = met(met(cuts, "p1", "l"), "p2", "r")
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumn("up", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("down", exact("l") * exact("r"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    least = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return least.select("lang", "phrase", "k", "a", "m.l", "m.r", "m.score")


def absorbed(candidates: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of the candidates whose words lie side by side in a longer one with percent of their occurrences or more."""
    longer = candidates.filter("k > 2").select("lang", F.col("a").alias("_a"), "k", F.split("phrase", " ").alias("w"))
    inner = longer.withColumn("m", F.explode(F.expr("sequence(2, k - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, k - m + 1)")))
    inner = inner.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("_a").alias("_a"))
    return candidates.join(inner, ["lang", "phrase"]).filter(F.col("_a") * 100 >= F.col("a") * percent).select("lang", "phrase")


def first_by(df: DataFrame, group: str, order: list[Column], n: int, salts: int = 32) -> DataFrame:
    """The first n rows of each group with their rank: first of each of salts parts of a group, then of those."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = salted.withColumn("_rank", F.row_number().over(W.partitionBy(group, "_salt").orderBy(*order))).filter(F.col("_rank") <= n)
    ranked = some.drop("_salt", "_rank").withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= n)


@names_apart
def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, top: int = TOP, percent: int = ABSORBED, shards: int = SHARDS, buckets: int = BUCKETS
) -> DataFrame:
    """Each language's first top phrases of 2 to most_words words: lang, rank, phrase, a, l, r, n, score (long but for lang and phrase).

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and U+000A to U+000D into pieces and those at spaces and tabs into words. a is the
    number of a phrase's occurrences in pieces, min_count or more; l and r are those of its two parts at the cut
    of the lowest floor(1000000 * a * a / (l * r)), ties at the earliest cut; n counts the language's words. A phrase goes if its words lie
    side by side in a longer candidate that occurs at least percent % as often. Order: score and a descending, phrase by bytes.

    Null texts are empty; a null lang is ``und`` and counts with it; repeated rows count each; other columns
    of docs are not looked at, whatever their names; texts of any length are split a piece at a time; an empty table gives an empty one.
    """
    found, totals = frequent(docs, min_count, most_words, shards, buckets)
    candidates = stored(scored(found, most_words), "candidates")
    left = candidates.join(absorbed(candidates, percent), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = first_by(left, "lang", order, top)
    return ranked.join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counts AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
  GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
chosen AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, k, a, c, array_to_string(w[1:c], ' ') AS p1, array_to_string(w[c + 1:k], ' ') AS p2
  FROM (SELECT *, unnest(range(1, k)) AS c FROM chosen)),
scores AS (
  SELECT cuts.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN counts x ON cuts.lang = x.lang AND p1 = x.phrase JOIN counts y ON cuts.lang = y.lang AND p2 = y.phrase),
least_cut AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS f
  FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM chosen WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT s.* FROM least_cut s LEFT JOIN inside i ON s.lang = i.lang AND s.phrase = i.phrase WHERE s.k = 3 OR i.f IS NULL OR 100 * i.f < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

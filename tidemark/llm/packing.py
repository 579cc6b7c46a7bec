"""Best-fit packing: a plan over counts of lengths, whose slots documents take by their rank within a length."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_columns, names_apart, stored, table
from .tokens import encoder, tokenizer_content

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END = 0
#: Characters that are encoded in one call.
CALL = 1 << 20
MADE = ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")

# Fixed value: the byte-level pre-tokenizer's own pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Blocks of code points that were assigned long ago, so that both libraries have the same classes for them.
SETTLED = (
    (0x01, 0x52F), (0x600, 0x6FF), (0x900, 0x97F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x22FF),
    (0x2500, 0x25FF), (0x3000, 0x303F), (0x3041, 0x3096), (0x30A0, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1F64F),
)
OUTSIDE = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}".replace("\\", "\\\\").replace("]", "\\]") for a, b in SETTLED) + "]")
#: Places where pre-tokens of PATTERN certainly part: between a word character and a mark, and before a space between two words.
APART = re.compile(r"(?<=[^\W_])(?=[.,;:!?。，、！？])|(?<=[^\W_]) (?=[^\W_])")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: those that print stand for themselves, the others follow after U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_ranks(content: bytes) -> dict[bytes, int] | None:
    """Token bytes to ids, if a tokenizers file is a byte-level BPE in which ids follow the merges' order; else None."""
    made = json.loads(content)
    model, pre = made["model"], made["pre_tokenizer"] or {}
    want = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if made["normalizer"] or model["type"] != "BPE" or any(model.get(k) for k in odd) or any(pre.get(k) != v for k, v in want.items()):
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"]["".join(p)] for p in pairs]
    if order != sorted(set(order)):
        return None
    letters = byte_letters()
    own = {x["content"] for x in made["added_tokens"]}
    return {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in own}


class Coder:
    """The ids of texts as the tokenizers library gives them from a file's content, as little-endian 32-bit numbers.

    Where the file is a plain byte-level BPE, texts of SETTLED characters without added tokens are encoded by ranks with the tiktoken
    library, which gives the same ids about five times as fast; all others by the tokenizers library itself.
    """

    def __init__(self, content: bytes):
        self.whole = encoder(content)
        added = [x["content"] for x in json.loads(content)["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.cuts = not any(re.search(r"\s|[^\W_][.,;:!?。，、！？]", x) for x in added)
        ranks = plain_ranks(content)
        self.fast = None
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def parts(self, text: str, call: int) -> Iterator[str]:
        """The text, cut at places where no token can go across; it stays whole where there is none."""
        at = 0
        while self.fast is not None and self.cuts and len(text) - at > call:
            found = APART.search(text, at + call)
            if found is None:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def ids(self, text: str, call: int = CALL) -> np.ndarray:
        made = [self.part(x) for x in self.parts(text, call)]
        return made[0] if len(made) == 1 else np.concatenate(made)

    def part(self, text: str) -> np.ndarray:
        if self.fast is None or OUTSIDE.search(text) or (self.added and self.added.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if they fit, else the odd rest first and then full ones."""
    first = n if n <= capacity else n % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, content: bytes, capacity: int, end: int | None, with_ids: bool) -> DataFrame:
    """A row for each piece of each document, with _part, the task that read it, and _rank, how many of its length that task had before."""
    kept = [c for c in docs.columns if c not in ("text", "_text")]
    given = docs.select(*kept, F.spark_partition_id().alias("_part"), "_text")
    schema = docs.select(*kept).withColumns({"_part": F.lit(0), "piece": F.lit(0)}).withColumns({c: F.lit(0).cast("long") for c in ("start", "length", "ids_crc32")})
    schema = schema.withColumn("ids", F.array(F.lit(0).cast("long"))) if with_ids else schema
    schema = schema.withColumn("_rank", F.lit(0).cast("long")).schema
    shared = docs.sparkSession.sparkContext.broadcast(content)
    tail = np.array([] if end is None else [end], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = Coder(shared.value), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            rows: list[tuple] = []
            for k, t in enumerate(b.column(len(kept) + 1)):
                ids = np.concatenate([coder.ids(t.as_py()), tail])
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((k, number, start, length, zlib.crc32(own), seen[length], own if with_ids else None))
                    seen[length] += 1
            which = pa.array([r[0] for r in rows], pa.int64())
            made = [pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3, 4))]
            if with_ids:
                made.append(pa.array([r[6].astype(np.int64) for r in rows], pa.list_(pa.int64())))
            made.append(pa.array([r[5] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(which) for i in range(len(kept) + 1)), *made], schema.names)

    return given.mapInArrow(run, schema)


def plan(counts: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths: runs (length, rank, number, sequence, each, offset).

    The pieces of a length whose ranks are number ones from rank on go to sequences from sequence on, each of them side by side in
    every sequence, from place offset on. Sequences of equal room are kept as ranges, so a length that all
    documents share costs no more steps than one of a few; the work depends on capacity and not on the number of documents.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # room left to ranges (first sequence, how many)
    runs, made = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, room = counts[length], 0, length
        while left:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                room = capacity
                first, n = made, -(-left // (capacity // length))
                made += n
            else:
                first, n = rooms[room].pop()
            each = room // length
            whole = min(n, left // each)
            for many, per in ((whole, each), (int(whole < n and 0 < left - whole * each), left - whole * each)):
                if many:
                    runs.append((length, rank, many * per, first, per, capacity - room))
                    rooms[room - per * length].append((first, many))
                    first, n, rank, left = first + many, n - many, rank + many * per, left - many * per
            if n:
                rooms[room].append((first, n))
    return runs


@names_apart
def pack(docs: DataFrame, content: bytes, capacity: int = CAPACITY, end: int | None = END, with_ids: bool = False) -> DataFrame:
    """docs without text, a row for each piece: piece (int), start, length, ids_crc32, sequence_id, offset (long); ids if with_ids.

    A document is the ids of its text by the tokenizers file content, without added tokens, and then the id end. One of over
    capacity ids is cut into full pieces, after a first one of what is over. Each task numbers its pieces of one length; counts by
    length and task give the places of a task's numbers among all, and counts by length, capacity of them at
    most, the plan on the driver. Documents take its slots by their rank within their length. So a length that a
    third of all documents have is as many tasks' work as any other, and no text or id is shuffled (ids only if with_ids).

    Null texts are empty and hold the id end alone, or no piece where end is None; a null doc_id is an id like any other; repeated
    rows are documents of their own; columns of docs named like the new ones, in any case of letters, are replaced; an
    empty table gives an empty one. crc32 is of the ids as little-endian unsigned 32-bit numbers, unsigned.
    """
    spark = docs.sparkSession
    docs = fresh_columns(docs, MADE).withColumn("_text", F.coalesce("text", F.lit("")))
    cuts = stored(pieces(docs, content, capacity, end, with_ids), "pieces")
    counts = stored(cuts.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    names = ("_length", "_from", "_number", "_first", "_each", "_at")
    runs = spark.createDataFrame(plan(histogram, capacity), ", ".join(f"{c} long" for c in names))
    upto = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    met = (F.col("length") == F.col("_length")) & (F.col("_from") < F.col("_before") + F.col("_n")) & (F.col("_before") < F.col("_from") + F.col("_number"))
    # at most about capacity ** 2 runs, whatever the documents: mostly some thousands
    slots = before.join(F.broadcast(runs), met).select(
        F.col("length").alias("_l"), F.col("_part").alias("_p"), "_before", "_from", "_number", "_first", "_each", "_at"
    )
    rank = F.col("_before") + F.col("_rank") - F.col("_from")
    own = (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")) & (rank >= 0) & (rank < F.col("_number"))
    placed = cuts.join(slots, own).withColumns(
        {
            "sequence_id": F.col("_first") + F.floor(rank / F.col("_each")).cast("long"),
            "offset": F.col("_at") + (rank % F.col("_each")) * F.col("length"),
        }
    )
    return placed.select(*(c for c in cuts.columns if c not in ("_part", "_rank")), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from what pack() gives with ids: the pieces of each sequence side by side. No row holds over capacity ids."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return held.select("sequence_id", F.flatten(F.transform("held", lambda x: x["ids"])).alias("ids"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, tokenizer_content(TOKENIZER))

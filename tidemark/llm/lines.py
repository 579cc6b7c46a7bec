"""Line dedup: range-partitioned hashes, streamed in order, into compressed per-document keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, names_apart, stored, table

MIN_DOCS = 10
#: Bytes of bitmaps that are broadcast at most, with 64 more for each of them.
MOST_BROADCAST = 24 << 20
ROW = ["h1", "h2", "d1", "d2", "pos", "n"]


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line with a key: its hash (h1, h2), its document (d1, d2), its place and the number of lines.

    A document is known by two hashes of its doc_id and text, so null and repeated ids need no care. Rows
    repeated in full have the same lines at the same places, once for each of them.
    """
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(*document_key(), F.split(text, "\n").alias("lines")).withColumn("n", F.size("lines"))
    rows = cut.select("d1", "d2", "n", F.posexplode("lines").alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(SPACE_CHARS)))
    rows = rows.withColumn("key", key).filter("key <> ''")
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "d1", "d2", "pos", "n")


def document_key() -> list:
    return [F.xxhash64("doc_id", "text").alias("d1"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("d2")]


class Run:
    """The lines of one hash so far, as they come in order of document and place."""

    def __init__(self, first: bool, min_docs: int, keep_first: bool):
        self.first, self.min_docs, self.keep_first = first, min_docs, keep_first
        self.docs, self.last, self.held, self.lead, self.hash = 0, None, [], None, None

    def add(self, part: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Take the next lines; the lines that certainly go."""
        at = first_places(part, self.last)
        self.docs += int((part[:, 4] == at).sum())
        self.last, self.hash = (*part[-1, 2:4].tolist(), int(at[-1])), part[0, :2]
        if self.lead is None and self.keep_first:
            self.lead, part = part[:1], part[1:]
        if self.docs < self.min_docs:
            self.held.append(part)
            return []
        sure, self.held = [*self.held, part], []
        return [(x, GOES) for x in sure if len(x)]

    def close(self, last: bool) -> list[tuple[np.ndarray, int]]:
        """What is left to decide, if the run touches an end of the partition."""
        if not (self.first or last):
            return []
        lead = [] if self.lead is None else [self.lead]
        if self.docs < self.min_docs:
            return [(x, UNDECIDED) for x in (*lead, *self.held) if len(x)]
        summary = np.concatenate([self.hash, np.zeros(4, dtype=np.int64)])[None, :]
        return [(summary, ENOUGH), *((x, LEAD) for x in lead)]


def first_places(rows: np.ndarray, before: tuple | None = None) -> np.ndarray:
    """For each of some lines in order, the first place of its hash in its document.

    As many lines as are at that place, so many rows of docs are this document. before: document and first
    place of the line before, if it has the same hash.
    """
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
    starts = np.flatnonzero(fresh)
    at = rows[starts, 4].copy()
    if before is not None and before[:2] == tuple(rows[0, 2:4].tolist()):
        at[0] = before[2]
    return np.repeat(at, np.diff(np.append(starts, len(rows))))


GOES, UNDECIDED, ENOUGH, LEAD = 1, 2, 3, 4


def streamed(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Rows with a state from rows in order of hash, document and place. Lines that stay give no row.

    GOES: the line goes. The others are about the first and the last hash of a partition, which may have lines
    in the next one too. UNDECIDED: a line of such a hash with too few documents here. ENOUGH: no
    line, but such a hash has enough documents here. LEAD: its first line here, where one is to stay.
    Never more is held than a batch and the lines of min_docs documents.
    """
    run: Run | None = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)], axis=1)
        starts = np.concatenate(([0], np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1))
        ends = np.append(starts[1:], len(rows))
        docs = np.add.reduceat(rows[:, 4] == first_places(rows), starts, dtype=np.int64)
        out: list[tuple[np.ndarray, int]] = []
        if run is not None and not np.array_equal(run.hash, rows[0, :2]):
            out += run.close(False)
            run = Run(False, min_docs, keep_first)
        run = run or Run(True, min_docs, keep_first)
        out += run.add(rows[: ends[0]])
        if len(starts) > 1:
            out += run.close(False)
            inner = np.zeros(len(starts), dtype=bool)
            inner[1:-1] = docs[1:-1] >= min_docs
            goes = np.repeat(inner, ends - starts)
            if keep_first:
                goes[starts] = False
            out.append((rows[goes], GOES))
            run = Run(False, min_docs, keep_first)
            out += run.add(rows[starts[-1] :])
        yield from batch_of(out)
    if run is not None:
        yield from batch_of(run.close(True))


def batch_of(parts: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    parts = [x for x in parts if len(x[0])]
    if parts:
        rows = np.concatenate([p for p, _ in parts])
        state = np.repeat(np.array([s for _, s in parts], dtype=np.int64), [len(p) for p, _ in parts])
        yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, k]) for k in range(6)), pa.array(state)], [*ROW, "state"])


def dropped_lines(docs: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """(d1, d2, pos, n) of the lines that go."""
    schema = ", ".join(f"{c} long" for c in [*ROW, "state"])
    # documents, and the tasks that read them, are part of the range: the lines of a hot hash, or of rows repeated in full,
    # spread over as many partitions as they fill
    rows = line_rows(docs).withColumn("read_by", F.spark_partition_id())
    ordered = rows.repartitionByRange("h1", "h2", "d1", "d2", "read_by").drop("read_by").sortWithinPartitions("h1", "h2", "d1", "d2", "pos")
    marked = stored(ordered.mapInArrow(lambda it: streamed(it, min_docs, keep_first), schema), "lines")
    ends = marked.filter(F.col("state") != GOES)
    open_rows = F.when(F.col("state") == UNDECIDED, F.col("pos"))
    # rows of docs that are this document: all have its lines at the same places
    times = F.count(open_rows) / F.greatest(F.count_distinct(open_rows), F.lit(1))
    enough = F.max(F.when(F.col("state") == ENOUGH, F.lit(min_docs)).otherwise(0))
    by_doc = ends.groupBy("h1", "h2", "d1", "d2").agg(times.alias("few"), enough.alias("enough"))
    hot = by_doc.groupBy("h1", "h2").agg((F.sum("few") + F.max("enough")).alias("docs")).filter(F.col("docs") >= min_docs)
    late = ends.filter(F.col("state").isin(UNDECIDED, LEAD)).join(hot.select("h1", "h2"), ["h1", "h2"], "left_semi")
    if keep_first:
        place = F.struct("d1", "d2", "pos")
        first = late.groupBy("h1", "h2").agg(F.min(place).alias("_first"))
        late = late.join(first, ["h1", "h2"]).filter(place != F.col("_first"))
    cols = ["d1", "d2", "pos", "n"]
    return marked.filter(F.col("state") == GOES).select(cols).unionByName(late.select(cols))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps = []
        for at, n in zip(b.column(2), b.column(3), strict=True):
            keep = np.ones(n.as_py(), dtype=np.uint8)
            keep[np.array(at.values)] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], ["d1", "d2", "keep"])


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """(d1, d2, keep): for each document that loses a line, its keep bitmap, bits packed and deflated.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of a code point or more
    that min_docs documents or more have lose all their lines, or all but the first if keep_first. d1 and d2
    are hashes of doc_id and text, see document_key(); of rows repeated in full each counts as a document.
    """
    lost = dropped_lines(docs, min_docs, keep_first)
    by_doc = lost.groupBy("d1", "d2").agg(F.collect_set("pos").alias("at"), F.max("n").alias("n"))
    return by_doc.mapInArrow(packed, "d1 long, d2 long, keep binary")


@names_apart
def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """docs with kept_text, n_lines, n_dropped (long) and keep (the bitmap, null if every line stays).

    Null texts are one empty line; empty lines are never counted and always stay; rows repeated in full
    lose the same lines and each counts as a document; a null doc_id is an id like any other; columns of docs
    with the new names are replaced; an empty table gives an empty one. Only hashes of lines are
    sorted. Bitmaps of MOST_BROADCAST bytes at most go to the texts; beyond that texts move once, to meet them.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped", "keep")
    maps = stored(keep_bitmaps(docs, min_docs, keep_first), "bitmaps")
    held = maps.agg(F.sum(F.octet_length("keep") + 64)).first()[0] or 0
    maps = maps.select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "keep")
    maps = F.broadcast(maps) if held <= MOST_BROADCAST else maps
    d1, d2 = document_key()
    met = docs.select("*", d1.alias("_e1"), d2.alias("_e2")).join(maps, F.expr("_d1 = _e1 and _d2 = _e2"), "left").drop("_d1", "_d2", "_e1", "_e2")
    text = F.coalesce("text", F.lit(""))
    met = met.withColumn("n_lines", F.size(F.split(text, "\n")).cast("long")).withColumn("n_dropped", F.lit(0).cast("long"))
    met = met.withColumn("kept_text", text)
    return met.mapInArrow(applied, met.schema)


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kept_text and n_dropped by the bitmaps."""
    for b in batches:
        names = b.schema.names
        maps, texts = b.column(names.index("keep")), b.column(names.index("kept_text"))
        hit = np.flatnonzero(np.array(maps.is_valid())).tolist()
        if not hit:
            yield b
            continue
        kept, n = texts.to_pylist(), [0] * b.num_rows
        for k in hit:
            lines = kept[k].split("\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(maps[k].as_py()), dtype=np.uint8))[: len(lines)]
            n[k] = len(lines) - int(keep.sum())
            kept[k] = "\n".join(x for x, stays in zip(lines, keep.tolist(), strict=True) if stays)
        new = {"kept_text": pa.array(kept, texts.type), "n_dropped": pa.array(n, pa.int64())}
        columns = [new.get(f.name, b.column(i)) for i, f in enumerate(b.schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=b.schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = dedup_lines(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

"""A positional inverted index as stored tables: postings by term, appended to by batch; words, phrases and ranks from postings alone."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .joins import beside
from .tables import few_at_once, there

#: Folders of postings by hash of the term.
BUCKETS = 64
#: Rows that go to Python at once, and words whose postings it holds at once.
ROWS_SENT, MOST_POSTED = 256, 50_000


def _tokens(query: str, spark: SparkSession) -> list[str]:
    return spark.range(1).select(text.tokens(F.lit(query)).alias("w")).first()["w"]


def _starts(positions: str, k: int) -> Column:
    """Where a phrase would begin whose k-th word stands at the positions."""
    return F.transform(positions, lambda p: p - k)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _posted(batches: Iterator[pa.RecordBatch], names: Sequence[str], most: int = MOST_POSTED) -> Iterator[pa.RecordBatch]:
    """Postings of rows (doc, field, words), in batches that end with the row by which most words are held."""

    def made(b: pa.RecordBatch, at: list, terms: list, places: list, sizes: list) -> pa.RecordBatch:
        which = pa.array(at, pa.int64())
        columns = [b.column(0).take(which), b.column(1).take(which), pa.array(terms, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(sizes, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names)

    for b in batches:
        at, terms, places, sizes, held = [], [], [], [], 0
        for k, words in enumerate(b.column(2)):
            own: dict[str, list[int]] = {}
            line = words.as_py()
            for i, w in enumerate(line):
                own.setdefault(w, []).append(i)
            at += [k] * len(own)
            terms += own
            places += own.values()
            sizes += [len(line)] * len(own)
            held += len(line)
            if held >= most:
                yield made(b, at, terms, places, sizes)
                at, terms, places, sizes, held = [], [], [], [], 0
        if at:
            yield made(b, at, terms, places, sizes)


def postings(docs: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """(doc, field, term, positions, n): where each term stands in each column of a row, and how many words the column has.

    Texts are folded and cut by Spark; a task gathers the positions of one row's terms at a time, and nothing is shuffled.
    """
    fields = F.array(*(F.struct(F.lit(c).alias("field"), text.tokens(F.col(c)).alias("words")) for c in columns))
    each = docs.select(F.col(id_column).alias("doc"), F.inline(fields)).filter("size(words) > 0")
    schema = each.select("doc", "field").withColumns({"term": F.lit(""), "positions": F.array(F.lit(0)), "n": F.lit(0)}).schema

    names = [f.name for f in schema]
    return each.mapInArrow(lambda batches: _posted(batches, names), schema)


class TextIndex:
    """An index in a folder: postings in folders by bucket of the term, sorted by term in their files, documents, and batches.

    append() adds the rows whose id the index doesn't have. A batch counts once its line in batches is written, last of all, so postings
    of an append that broke off are never read and the append can be run again. Readers name the bucket and the term, so that
    a search opens the files of its terms' buckets and in them the row groups of the terms.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def batches(self) -> DataFrame | None:
        return self._read("batches") if there(self.spark, f"{self.path}/batches") else None

    def append(self, docs: DataFrame, id_column: str, columns: Sequence[str]) -> int:
        """Add rows (id, columns), of an id the first; the number of those added. Null ids are left out, as nothing could name them."""
        new = docs.filter(F.col(id_column).isNotNull()).select(id_column, *columns)
        if self.batches() is not None:
            new = new.join(self.documents().select(F.col("doc").alias(id_column)), id_column, "left_anti")
        batch = uuid.uuid4().hex
        kept = f"{self.path}/documents"
        sizes = F.array(*(F.struct(F.lit(c).alias("field"), F.size(text.tokens(F.col(c))).alias("n")) for c in columns))
        listed = new.select(F.col(id_column).alias("doc"), sizes.alias("sizes"), F.lit(batch).alias("batch"))
        listed.write.mode("append").parquet(kept)
        made = postings(new, id_column, columns).withColumns({"batch": F.lit(batch), "bucket": _bucket(F.col("term"), self.buckets)})
        # ranges go by document too, so a term of all documents fills as many files as it needs
        order = ("bucket", "term", "doc")
        with few_at_once(self.spark, ROWS_SENT):
            made.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        own = self._read("documents").filter(F.col("batch") == batch)
        per_field = own.select(F.inline("sizes")).groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words"))
        per_field.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        return own.count()

    def _whole(self, df: DataFrame) -> DataFrame:
        """Rows of batches that were finished: a list of appends, a line each."""
        return df.join(F.broadcast(self.batches().select("batch").distinct()), "batch", "left_semi")

    def documents(self) -> DataFrame:
        return self._whole(self._read("documents"))

    def of(self, term: str, fields: Sequence[str] = ()) -> DataFrame:
        """(doc, field, positions, n) of a folded term."""
        own = self._read("postings").filter((F.col("bucket") == _bucket(F.lit(term), self.buckets)) & (F.col("term") == term))
        own = own.filter(F.col("field").isin(*fields)) if fields else own
        return self._whole(own).select("doc", "field", "positions", "n")

    def word(self, query: str, fields: Sequence[str] = ()) -> DataFrame:
        """(doc) of the rows that have the first word of query in one of the fields, or anywhere."""
        words = _tokens(query, self.spark)
        if not words:
            raise ValueError(f"no word in {query!r}")
        return self.of(words[0], fields).select("doc").distinct()

    def phrase(self, query: str, fields: Sequence[str] = ()) -> DataFrame:
        """(doc) of the rows that have the words of query side by side: postings joined by row and field, on positions shifted by place.

        The word of fewest rows comes first, so that each join only meets what is left.
        """
        words = _tokens(query, self.spark)
        if not words:
            raise ValueError(f"no word in {query!r}")
        rows = {w: self.of(w, fields).count() for w in set(words)} if len(words) > 1 else {}
        held = None
        for k in sorted(range(len(words)), key=lambda k: (rows.get(words[k], 0), k)):
            own = self.of(words[k], fields).select("doc", "field", _starts("positions", k).alias("_starts"))
            if held is None:
                held = own.withColumnRenamed("_starts", "starts")
            else:
                held = held.join(own, ["doc", "field"]).select("doc", "field", F.array_intersect("starts", "_starts").alias("starts")).filter("size(starts) > 0")
        return held.select("doc").distinct()

    def ranked(self, query: str, field: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(doc, score) of the rows that have a word of query in the field, by BM25 from postings and the sums of the batches."""
        words = sorted(set(_tokens(query, self.spark)))
        if not words:
            raise ValueError(f"no word in {query!r}")
        total = self.batches().filter(F.col("field") == field).agg(F.sum("docs").alias("_rows"), (F.sum("words") / F.sum("docs")).alias("_mean"))
        score = None
        for w in words:
            own = self.of(w, [field]).select("doc", F.size("positions").alias("_tf"), "n")
            own = beside(beside(own, own.agg(F.count(F.lit(1)).alias("_df"))), total)
            rarity = F.log(1 + (F.col("_rows") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
            part = rarity * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("n") / F.col("_mean")))
            own = own.select("doc", part.alias("part"))
            score = own if score is None else score.unionByName(own)
        return score.groupBy("doc").agg(F.round(F.sum("part"), 4).alias("score"))

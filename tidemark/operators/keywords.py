"""Many terms at once: a trie over token sequences that each text is walked through once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .search import samples

#: Terms, and characters of them, that are sent to the tasks as a trie at most; longer lists are joined.
MOST_TERMS, MOST_CHARS = 500_000, 24 << 20
END = ""


def trie(terms: Iterable[Sequence[str]]) -> dict:
    """Nested dicts by token; END leads to the number of the term that ends there. No token is empty, so END is none."""
    root: dict = {}
    for k, words in enumerate(terms):
        node = root
        for w in words:
            node = node.setdefault(w, {})
        node[END] = k
    return root


def walked(root: dict, words: Sequence[str]) -> set[int]:
    """Numbers of the terms that stand in words. The walks that are under way are kept, so each word is looked at once."""
    found: set[int] = set()
    under_way: list[dict] = []
    for w in words:
        under_way.append(root)
        ahead = []
        for node in under_way:
            after = node.get(w)
            if after is not None:
                ahead.append(after)
                if END in after:
                    found.add(after[END])
        under_way = ahead
    return found


def by_trie(df: DataFrame, id_column: str, body: str, terms: list[tuple[str, list[str]]]) -> DataFrame:
    """(id, term) of the rows that have a term; terms are (term, its tokens) with distinct tokens."""
    shared = df.sparkSession.sparkContext.broadcast(terms)
    given = df.select(F.col(id_column), text.tokens(F.col(body)).alias("_words"))
    schema = given.select(id_column).withColumn("term", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, root = pa.array([t for t, _ in shared.value], pa.string()), trie(w for _, w in shared.value)
        for b in batches:
            at, which = [], []
            for k, words in enumerate(b.column(1)):
                own = walked(root, words.as_py())
                at += [k] * len(own)
                which += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), names.take(pa.array(which, pa.int64()))], [id_column, "term"])

    return given.mapInArrow(run, schema)


def _runs(n: int) -> Column:
    """All runs of n of the words of a row."""
    at = F.sequence(F.lit(1), F.size("_words") - (n - 1))
    return F.when(F.size("_words") >= n, F.transform(at, lambda i: F.array_join(F.slice("_words", i, n), " "))).otherwise(F.array().cast("array<string>"))


def by_join(df: DataFrame, id_column: str, body: str, terms: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(id, term) as by_trie() gives, for lists of any size: runs of as many tokens as some term has, joined with terms (tokens, term)."""
    given = df.select(F.col(id_column), text.tokens(F.col(body)).alias("_words"))
    each = given.select(id_column, F.explode(F.array_distinct(F.concat(*(_runs(n) for n in lengths)))).alias("_run"))
    return each.join(terms.select(F.array_join("tokens", " ").alias("_run"), "term"), "_run").select(id_column, "term")


def matched(df: DataFrame, id_column: str, body: str, terms: DataFrame, most_terms: int = MOST_TERMS, most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, term): for each row the terms and phrases of terms (folded, term) that stand in it, each once.

    A list of up to most_terms terms and most_chars characters goes to the tasks as a trie, and each text is walked once whatever the number
    of terms; a larger one is joined with the runs of tokens of the texts. Terms that fold to the same tokens are all found.
    """
    cut = terms.select("term", text.tokens(F.col("folded")).alias("tokens")).filter("size(tokens) > 0")
    n, chars, lengths = cut.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0)), F.array_sort(F.collect_set(F.size("tokens")))).first()
    if n <= most_terms and chars <= most_chars:
        same = cut.groupBy("tokens").agg(F.array_sort(F.collect_list("term")).alias("terms")).collect()
        held = by_trie(df, id_column, body, [(r["terms"][0], r["tokens"]) for r in same])
        twins = [(r["terms"][0], t) for r in same for t in r["terms"]]
        if len(twins) == len(same):
            return held
        both = df.sparkSession.createDataFrame(twins, "term string, _all string")
        return held.join(F.broadcast(both), "term").select(id_column, F.col("_all").alias("term"))
    return by_join(df, id_column, body, cut, lengths)


def keyword_report(df: DataFrame, id_column: str, body: str, terms: DataFrame, most: int = 3) -> DataFrame:
    """(term, rows, samples, rank): for each term or phrase of terms (folded, term) the rows that have it and the first ids of these.

    Texts are read once for all terms, see matched(); only hits are shuffled. Terms without hits are last; ties by term.
    """
    hits = matched(df, id_column, body, terms)
    counted = hits.groupBy("term").agg(F.count(F.lit(1)).alias("rows")).join(samples(hits, ["term"], id_column, most), "term")
    out = terms.select("term").join(counted, "term", "left").select("term", F.coalesce("rows", F.lit(0)).alias("rows"), "samples")
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.col("rows").desc(), F.lower("term"))))

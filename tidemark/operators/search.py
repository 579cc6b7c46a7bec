"""Lists of artifacts as a user asks for them: pages, views of a category, suggestions, ranked text, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, timex
from .joins import beside
from .order import page as paged

#: Columns that a list may be ordered by.
SORTABLE = ("timestamp", "confidence", "category", "app", "subtype", "direction", "party", "source_row")
#: Rows from the top that a page may end at to be merged in one task.
SHALLOW = 10_000
#: Columns of the table view of a category: heading, and what is shown. Any other category has those of Other.
VIEWS: Mapping[str, tuple[tuple[str, str], ...]] = {
    "Calls": (("time", "time"), ("direction", "direction"), ("party", "party"), ("seconds", "seconds"), ("app", "app")),
    "Messages": (("time", "time"), ("direction", "direction"), ("party", "party"), ("text", "body"), ("app", "app")),
    "Chats": (("time", "time"), ("direction", "direction"), ("party", "party"), ("text", "body"), ("app", "app")),
    "Places": (("time", "time"), ("latitude", "latitude"), ("longitude", "longitude"), ("what", "subtype"), ("app", "app")),
    "Web": (("time", "time"), ("what", "subtype"), ("text", "body"), ("app", "app")),
    "Files & Media": (("time", "time"), ("what", "subtype"), ("digest", "blob_sha256"), ("source", "source_path")),
    "Other": (("time", "time"), ("what", "subtype"), ("text", "body"), ("app", "app")),
}


def page(df: DataFrame, order: str = "timestamp", descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit - 1 in an order, undated ones last, ties by id. Only known columns order.

    The first rows are merged from the tasks' first rows; a page that lies deeper is found by counts, see order.page().
    """
    if order not in SORTABLE:
        raise ValueError(f"no order by {order!r}")
    if offset + limit > SHALLOW:
        return paged(df, order, "artifact_id", descending, limit, offset)
    by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    return df.orderBy(by, "artifact_id").offset(offset).limit(limit)


def deleted_view(df: DataFrame) -> DataFrame:
    """What was recovered with place, its rank: surest first, then latest."""
    gone = df.filter("recovery <> 'allocated'")
    return gone.orderBy(F.col("confidence").desc(), F.col("timestamp").desc_nulls_last(), "artifact_id")


def gallery(df: DataFrame, subtypes: Sequence[str] = ("Picture", "Video"), located: bool = False, app: str | None = None) -> DataFrame:
    """Files of some subtypes, latest first; only those with a place, or of an app, if asked."""
    found = df.filter((F.col("category") == "Files & Media") & F.col("subtype").isin(*subtypes))
    found = found.filter("latitude is not null") if located else found
    found = found if app is None else found.filter(F.col("app") == app)
    return found.orderBy(F.col("timestamp").desc_nulls_last(), "artifact_id")


def rows(df: DataFrame, attributes: Sequence[str] = ()) -> DataFrame:
    """What a list shows of each artifact: the essentials, a line of its body, and the chosen attributes."""
    chosen = [F.get_json_object("attributes", f"$.{a}").alias(a) for a in attributes]
    return df.select("artifact_id", "category", "timestamp", text.summary(F.col("body"), F.col("subtype")).alias("line"), *chosen)


def column_view(df: DataFrame, category: str) -> DataFrame:
    """The table view of a category, its columns by headings."""
    special = {
        "time": timex.iso(F.col("timestamp")),
        "seconds": ((F.col("timestamp_end") - F.col("timestamp")) / 1_000_000).cast("long"),
    }
    shown = VIEWS.get(category, VIEWS["Other"])
    return df.filter(F.col("category") == category).select("artifact_id", *(special.get(c, F.col(c)).alias(name) for name, c in shown))


def suggestions(df: DataFrame, columns: Sequence[str], most: int = 12) -> DataFrame:
    """(field, value, n): for each column its most frequent values, ties by value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    counted = df.select(F.inline(pairs)).filter("value <> ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("field").orderBy(F.col("n").desc(), "value"))
    return counted.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def ranked(df: DataFrame, id_column: str, body: str, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the rows that have one of the terms, by BM25.

    The words of a row are counted where it is read; the only shuffles are the sums over all rows, of lengths and of
    rows that have a term, which are one row each.
    """
    wanted = sorted({t for term in terms for t in term.split()})
    words = text.tokens(F.col(body))
    times = lambda t: F.size(F.filter("_words", lambda w: w == F.lit(t)))
    hits = {t: times(t) for t in wanted}
    counted = df.select(F.col(id_column), words.alias("_words")).select(id_column, F.size("_words").alias("_n"), *(h.alias(f"_tf_{k}") for k, h in enumerate(hits.values())))
    total = counted.agg(
        F.count(F.lit(1)).alias("_rows"), F.avg("_n").alias("_mean"), *(F.count(F.when(F.col(f"_tf_{k}") > 0, 1)).alias(f"_df_{k}") for k in range(len(wanted)))
    )
    score: Column = F.lit(0.0)
    for k in range(len(wanted)):
        tf, n = F.col(f"_tf_{k}"), F.col(f"_df_{k}")
        rarity = F.log(1 + (F.col("_rows") - n + 0.5) / (n + 0.5))
        score = score + rarity * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / F.col("_mean")))
    some = F.greatest(*(F.col(f"_tf_{k}") for k in range(len(wanted))), F.lit(0)) > 0
    return beside(counted.filter(some), total).select(id_column, F.round(score, 4).alias("score"))


def samples(df: DataFrame, keys: Sequence[str], value: str, most: int = 5) -> DataFrame:
    """(keys, samples): of each key's values the first ones in order; no more than most are held for a key."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(value))
    some = df.select(*keys, value).distinct().withColumn("_rank", rank).filter(F.col("_rank") <= most)
    return some.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("samples"))


def terms_of(lines: DataFrame, column: str, order: str) -> DataFrame:
    """(folded, term): the terms of a list, of those alike but for case the first.

    Blank lines and comments are dropped, a line in quotes is one term, any other is cut at commas.
    """
    good = lines.select(F.col(order).alias("_at"), F.trim(column).alias("_line")).filter("_line <> '' and not startswith(_line, '#')")
    quoted = F.rlike("_line", F.lit("^(\".*\"|'.*')$"))
    parts = F.when(quoted, F.array("_line")).otherwise(F.split("_line", ","))
    each = good.select("_at", F.posexplode(parts).alias("_k", "_part"))
    term = F.trim(F.regexp_replace(F.trim("_part"), "^[\"']+|[\"']+$", ""))
    each = each.select("_at", "_k", term.alias("term")).filter("term <> ''")
    return each.groupBy(F.lower("term").alias("folded")).agg(F.min_by("term", F.struct("_at", "_k", "term")).alias("term"))

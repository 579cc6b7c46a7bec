"""Joins that Spark has no operator for: ranges and nearest rows in time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, at: str, other: str, width: int, on: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Pairs with |left.at - right.other| <= width, and equal columns as given in on.

    Instants fall into buckets of the width and the right side is entered in three of them, so the join is
    on the bucket and the given columns, by hash and not by nested loops. Column names must differ.
    """
    a = left.withColumn("_bucket", F.floor(F.col(at) / width))
    b = right.withColumn("_near", F.explode(F.array(*(F.floor(F.col(other) / width) + k for k in (-1, 0, 1)))))
    match = F.col("_bucket") == F.col("_near")
    for x, y in on:
        match = match & (F.col(x) == F.col(y))
    return a.join(b, match & (F.abs(F.col(at) - F.col(other)) <= width)).drop("_bucket", "_near")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: Column, within: int, backward: bool = True) -> DataFrame:
    """left with near (struct of time and value) of the last row of right at or before, or first at or after it.

    Both sides share keys and time; of several rows of right at one instant the smallest value is taken. A row of right is
    entered in its bucket of the width within and in the next one, so that a key of very many rows is dealt out by
    time; one sort by bucket and time serves all rows, and nothing is paired.
    """
    cols = left.columns
    bucket = F.floor(F.col(time) / within)
    a = left.withColumns({"_side": F.lit(1), "_bucket": bucket, "_v": F.lit(None).cast(right.select(value.alias("v")).schema[0].dataType)})
    b = right.select(*keys, time, F.lit(0).alias("_side"), value.alias("_v"))
    b = b.withColumn("_bucket", F.explode(F.array(bucket, bucket + (1 if backward else -1))))
    both = a.unionByName(b, allowMissingColumns=True)
    seen = F.when(F.col("_side") == 0, F.struct(F.col(time).alias("time"), F.col("_v").alias("value")))
    order = [F.col(time) if backward else F.col(time).desc(), F.col("_side"), F.col("_v").desc()]
    w = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("near", F.last(seen, ignorenulls=True).over(w)).filter("_side = 1")
    near = F.when(F.abs(F.col("near.time") - F.col(time)) <= within, F.col("near"))
    return found.select(*cols, near.alias("near"))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: Column, within: int, most: int, among: Mapping[str, tuple[Sequence[str], Column]]) -> DataFrame:
    """left with a column for each name of among: an array of structs (time, value) that holds the most nearest rows of right within the width.

    among has further keys and a condition on rows of right; both sides share all keys and time. Rows are taken by distance, then by the
    smallest value. A row of right is entered in its bucket of the width and the two beside it; in a bucket sorted by time each row of left takes as many
    rows before and after it, so nothing is paired, and what is shuffled and sorted grows with the rows, however many are near one another.
    """
    further = sorted({c for more, _ in among.values() for c in more})
    bucket = F.floor(F.col(time) / within)
    flags = {f"_in_{name}": good for name, (_, good) in among.items()}
    a = left.withColumns({"_side": F.lit(1), "_bucket": bucket})
    known = right.filter(F.col(time).isNotNull())
    for k in keys:
        known = known.filter(F.col(k).isNotNull())  # nulls are equal to nothing
    b = known.select(*keys, *further, time, F.lit(0).alias("_side"), value.alias("_v"), *(F.coalesce(c, F.lit(False)).alias(f) for f, c in flags.items()))
    b = b.withColumn("_bucket", F.explode(F.array(*(bucket + k for k in (-1, 0, 1)))))
    both = a.unionByName(b, allowMissingColumns=True).repartition(*keys, "_bucket")  # all windows below stay in these
    away = lambda x: F.abs(x["time"] - F.col(time))
    own = F.struct(F.col(time).alias("time"), F.col("_v").alias("value"))
    for name, (more, _) in sorted(among.items(), key=lambda x: len(x[1][0])):  # rows dealt out by the fewest keys are so by the others
        group, good = [*keys, "_bucket", *more], (F.col("_side") == 0) & F.col(f"_in_{name}")
        sides = []
        for side, at, last in (("_before", F.col(time), F.col("_side")), ("_after", F.col(time).desc(), F.col("_side").desc())):
            # rows of right among themselves hold those next to them, and each row of left takes what the last one holds
            beside = W.partitionBy(*group, "_side", f"_in_{name}").orderBy(at, F.col("_v").desc())
            held = F.array_compact(F.array(own, *(F.lag(own, k).over(beside) for k in range(1, most))))
            both = both.withColumn("_held", F.when(good, held))
            upto = W.partitionBy(*group).orderBy(at, last, F.col("_v").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
            both = both.withColumn(side, F.last("_held", ignorenulls=True).over(upto)).withColumn(side, F.when(F.col("_side") == 1, F.coalesce(side, F.array()))).drop("_held")
            sides.append(side)
        near = F.filter(F.concat(*sides), lambda x: away(x) <= within)
        ranked = F.sort_array(F.transform(near, lambda x: F.struct(away(x).alias("away"), x["value"].alias("value"), x["time"].alias("time"))))
        kept = F.transform(F.slice(ranked, 1, most), lambda x: F.struct(x["time"].alias("time"), x["value"].alias("value")))
        both = both.withColumn(name, kept).drop(*sides)
    return both.filter("_side = 1").select(*left.columns, *among)


def missing(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of left without a partner in right: what is listed but not there, not done yet or left behind."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def named(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """df with name, the first of names (key, name, order) by order and name; null where there is none."""
    first = names.filter("name <> ''").groupBy(key).agg(F.min_by("name", F.struct("order", "name")).alias("name"))
    return df.join(first, key, "left")


def hydrated(df: DataFrame, children: DataFrame, key: str, column: str, order: Sequence[str]) -> DataFrame:
    """df with column, the array of its children in order; empty where there are none."""
    rest = [c for c in children.columns if c != key]
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *(c for c in rest if c not in order)))).alias(column))
    return df.join(lists, key, "left").withColumn(column, F.coalesce(column, F.array().cast(lists.schema[column].dataType)))


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a table of one row, such as totals, in each row."""
    key = lambda x: x.withColumn("_one", F.lit(1))
    return key(df).join(F.broadcast(key(one)), "_one").drop("_one")

"""Orders of whole tables without one task that sees them: row numbers, deep pages, the row before, running sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import checkpointed

#: Rows whose keys are looked at to cut an order into ranges, and the number of ranges.
SAMPLED, RANGES = 2_048, 32


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df stored in ranges of keys and order, with _part, the number of a row's range. keys and order tell rows apart.

    Ranges are of about equal size whatever the keys, so the rows of a hot key lie in as many ranges as they fill.
    """
    cols = [*keys, *order]
    return checkpointed(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_part", F.spark_partition_id()))


def _carried(t: DataFrame, keys: Sequence[str], carry: DataFrame) -> DataFrame:
    """t with _carry. Only the first key of a range can begin in one before it, so carry has a row a range at most."""
    on = F.col("_part") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    named = carry.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k_{k}") for k in keys), "_carry")
    return t.join(F.broadcast(named), on, "left").drop("_p", *(f"_k_{k}" for k in keys))


def previous(t: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """t, a table of in_order(), with a column for each of values: what it is in the row before of the same key, null in the first.

    Each range finds its rows' neighbours by itself and gives its last row of each key; those summaries, one a key and range, are put in
    order, and the last row before a range is carried to its first row. Windows hold the rows of one key and range.
    """
    ends = t.groupBy("_part", *keys).agg(F.max_by(F.struct(*(v.alias(n) for n, v in values.items())), F.struct(*order)).alias("_last"))
    carry = ends.withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy("_part"))).filter("_carry is not null")
    local = W.partitionBy("_part", *keys).orderBy(*order)
    made = _carried(t, keys, carry).withColumn("_nth", F.row_number().over(local))
    own = {n: F.when(F.col("_nth") == 1, F.col(f"_carry.{n}")).otherwise(F.lag(v).over(local)) for n, v in values.items()}
    return made.withColumns(own).drop("_carry", "_nth")


def running(t: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """t, a table of in_order(), with name: the sum of value over the rows of the same key up to this one, carried from range to range."""
    valued = t.withColumn("_value", value)
    sums = valued.groupBy("_part", *keys).agg(F.sum("_value").alias("_sum"))
    upto = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.withColumn("_carry", F.sum("_sum").over(upto)).filter("_carry is not null")
    local = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    made = _carried(valued, keys, carry)
    return made.withColumn(name, F.sum("_value").over(local) + F.coalesce("_carry", F.lit(0))).drop("_value", "_carry")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with name, the place of a row in the order, from 1. The order must tell rows apart.

    Ranges of the order are sorted and stored with each row's number in its range; the sizes of the ranges before are added.
    """
    at = F.monotonically_increasing_id()  # the task's number in the upper bits, the row's in the lower 33
    t = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part = F.shiftright("_at", 33)
    sizes = t.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return t.join(F.broadcast(base), part == F.col("_p")).withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_p", "_base")


class Bound:
    """A row's place in an order by a column, nulls last, and an id."""

    def __init__(self, column: str, id_column: str, descending: bool, row):
        self.column, self.id, self.down = F.col(column), F.col(id_column), descending
        self.value, self.own = row[0], row[1]

    def before(self) -> Column:
        """Whether a row stands before this place."""
        first = self.id < F.lit(self.own)
        if self.value is None:
            return self.column.isNotNull() | first
        v = F.lit(self.value)
        ahead = self.column > v if self.down else self.column < v
        return F.coalesce(ahead | ((self.column == v) & first), F.lit(False))

    def near(self, after: bool) -> Column | None:
        """A plain comparison that all rows from this place on, or before it, pass; readers of files can use it."""
        if self.value is None:
            return self.column.isNull() if after else None
        if after:
            return None  # nulls come after every value
        return self.column >= self.value if self.down else self.column <= self.value


def page(df: DataFrame, order: str, id_column: str, descending: bool, limit: int, offset: int, most: int = 4_096) -> DataFrame:
    """Rows offset to offset + limit - 1 in an order, nulls last, ties by a distinct id, by counts of ranges.

    The keys of SAMPLED rows, those with the least hashes of their ids, cut the order into RANGES; one pass counts the rows before each cut,
    exactly, and only the ranges that the page lies in are cut again, until limit + most rows are left or nothing can be cut. Those rows alone
    are sorted. So a page costs a few counting passes and a sort of its own neighbourhood, however deep it lies.
    """
    lo: Bound | None = None
    hi: Bound | None = None
    before = 0

    def between(x: DataFrame) -> DataFrame:
        if lo is not None:
            x = x.filter(~lo.before())
            near = lo.near(True)
            x = x if near is None else x.filter(near)
        if hi is not None:
            x = x.filter(hi.before())
            near = hi.near(False)
            x = x if near is None else x.filter(near)
        return x

    keys = df.select(order, id_column)
    while True:
        rest = between(keys)
        some = rest.orderBy(F.xxhash64(id_column), id_column).limit(SAMPLED)
        by = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
        line = some.orderBy(by, id_column).collect()
        cuts = [Bound(order, id_column, descending, line[k * len(line) // RANGES]) for k in range(1, RANGES)] if len(line) > RANGES else []
        counts = rest.agg(F.count(F.lit(1)), *(F.count(F.when(c.before(), 1)) for c in cuts)).first()
        total, *heads = counts
        start = max((k for k, n in enumerate(heads) if before + n <= offset), default=None)
        stop = min((k for k, n in enumerate(heads) if before + n >= offset + limit), default=None)
        size = (total if stop is None else heads[stop]) - (0 if start is None else heads[start])
        if size >= total:
            break
        before += 0 if start is None else heads[start]
        lo, hi = lo if start is None else cuts[start], hi if stop is None else cuts[stop]
        if size <= limit + most:
            break
    return between(df).orderBy(by, id_column).offset(max(0, offset - before)).limit(limit)

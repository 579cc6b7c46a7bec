"""What exhibits have in common: parties, media, places, deletions, names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import geo
from ..functions.text import fold


def shared(df: DataFrame, key: str, by: str = "exhibit", least: int = 2) -> DataFrame:
    """Keys seen in at least two exhibits, with counts and bounds of their ids."""
    found = df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    # first per key and exhibit, so that a key of very many rows meets as one row per exhibit
    each = found.groupBy(key, by).agg(F.count(F.lit(1)).alias("rows"))
    out = each.groupBy(key).agg(F.count(F.lit(1)).alias("shared_by"), F.sum("rows").alias("n"))
    return out.filter(F.col("shared_by") >= least)


def shared_cells(df: DataFrame) -> DataFrame:
    good = df.filter(geo.plausible(F.col("latitude"), F.col("longitude")))
    cell = F.concat(geo.cell(F.col("latitude")), F.lit(","), geo.cell(F.col("longitude")))
    return shared(good.withColumn("cell", cell), "cell")


def asymmetric_deletion(df: DataFrame) -> DataFrame:
    """Parties whose traffic is deleted on some of their exhibits and not on others."""
    gone = F.col("recovery") != "allocated"
    each = df.groupBy("party", "exhibit").agg(F.count(F.when(gone, 1)).alias("deleted"), F.count(F.lit(1)).alias("n"))
    out = each.groupBy("party").agg(
        F.count(F.lit(1)).alias("exhibits"), F.count(F.when(F.col("deleted") > 0, 1)).alias("deleted_on"), F.sum("deleted").alias("deleted")
    )
    return out.filter((F.col("deleted_on") > 0) & (F.col("deleted_on") < F.col("exhibits")))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching parts, longest first, of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def similar_names(people: DataFrame, least: float = 0.86, most_in_block: int | None = None) -> DataFrame:
    """Pairs of different keys with like names.

    people (key, name). With M letters in k matching parts, a name of n letters against one of m has at most n - M + k - 1
    letter pairs outside of them, and k - 1 <= n + m - 2 M. As 2 M >= least * (n + m), that is a bound by n alone, and names
    share a pair among so many and one more of their rarest, rarity counted over all names. Names with no more different
    pairs than that meet each other under a key of their own. The length of the other name is part of the key.
    """
    names = people.select("key", F.trim(fold(F.col("name"))).alias("name")).filter("name <> ''").distinct()
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 1, F.lit(1))), lambda i: F.col("name").substr(i, F.lit(2)))
    listed = names.withColumn("gram", F.explode(F.array_distinct(grams)))
    counted = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rare = listed.join(counted, "gram").groupBy("key", "name").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    n = F.length("name")
    both = max(2 / (2 - least), 2 / least) if least < 2 / 3 else 2 / (2 - least)
    lost = F.floor(n * (1 + both * (1 - 1.5 * least)) + 1e-9).cast("int")
    few = F.when(F.size("g") <= lost, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    keyed = rare.select("key", "name", F.explode(F.concat(F.slice("g", F.lit(1), F.greatest(lost + 1, F.lit(1)))["gram"], few)).alias("gram"))
    a = keyed.select("gram", F.col("key").alias("key_a"), F.col("name").alias("name_a"), n.alias("n"))
    lengths = F.sequence(F.ceil(n * least / (2 - least) - 1e-9).cast("int"), F.floor(n * (2 - least) / least + 1e-9).cast("int"))
    b = keyed.select("gram", F.col("key").alias("key_b"), F.col("name").alias("name_b"), F.explode(lengths).alias("n"))
    pairs = a.join(b, ["gram", "n"]).filter(F.col("key_a") < F.col("key_b")).drop("gram", "n").distinct()
    return pairs.withColumn("ratio", sequence_ratio("name_a", "name_b")).filter(F.col("ratio") >= least)


def summary(df: DataFrame, traffic: DataFrame) -> DataFrame:
    """(what, n): how many parties, payloads and cells exhibits have in common, and parties with traffic deleted on some of them only."""
    count = lambda name, found: found.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
    parts = [count("parties", shared(traffic, "party")), count("media", shared(df, "blob_sha256")), count("cells", shared_cells(df)), count("asymmetric", asymmetric_deletion(traffic))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

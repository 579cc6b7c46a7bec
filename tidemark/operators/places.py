"""Places: presence, meetings of exhibits in space and time, shared cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, timex
from .joins import range_join
from .order import in_order, previous, running
from .tables import checkpointed


def presence(df: DataFrame, radius_m: float = 500.0) -> DataFrame:
    """Points that put an exhibit somewhere, with a weight: fixes 1.0, originals of its camera 0.9, sent locations 0.8.

    Searches and destinations don't count, nor do points whose stated accuracy is worse than the radius.
    """
    attribute = lambda name: F.get_json_object("attributes", f"$.{name}")
    searched = F.rlike(F.lower("subtype"), F.lit("maps|search|destination"))
    camera = (F.col("category") == "Files & Media") & F.contains(F.lower("source_path"), F.lit("dcim")) & (F.coalesce(attribute("make"), F.lit("")) != "")
    weight = F.when((F.col("category") == "Places") & ~searched, 1.0).when(camera, 0.9).when(
        F.col("category").isin("Messages", "Chats") & (F.col("direction") == "outgoing"), 0.8
    )
    near = F.coalesce(attribute("accuracy").try_cast("double"), F.lit(0.0)) <= radius_m
    good = geo.plausible(F.col("latitude"), F.col("longitude")) & F.col("timestamp").isNotNull() & near
    made = df.filter(good).withColumn("weight", F.round(weight * F.greatest(F.lit(0.1), F.col("confidence")), 3))
    return made.filter("weight is not null").select("artifact_id", "exhibit", "timestamp", "latitude", "longitude", "weight")


def _grid(radius_m: float) -> tuple:
    """Functions that give the band of a latitude column, the number of cells in a band, and the cell of a longitude column in a band of n."""
    angle = radius_m / geo.EARTH_M
    side = math.degrees(angle) * 1.000001
    band = lambda lat: F.floor(F.col(lat) / side).cast("long")

    def cells(y: Column) -> Column:
        """Number of cells in a band."""
        farthest = F.least(F.lit(90.0), (F.greatest(F.abs(y), F.abs(y + 1)) + 1) * F.lit(side))
        reach = F.least(F.lit(1.0), F.lit(math.sin(angle / 2) * 1.000001) / F.greatest(F.cos(F.radians(farthest)), F.lit(1e-12)))
        return F.greatest(F.lit(1), F.floor(360 / F.degrees(2 * F.asin(reach)))).cast("long")

    def cell(lon: str, n: Column) -> Column:
        return F.least(n - 1, F.floor((F.pmod(F.col(lon) + 180, F.lit(360.0))) / 360 * n).cast("long"))

    return band, cells, cell


def meetings(points: DataFrame, window_us: int = 15 * 60_000_000, radius_m: float = 500.0) -> DataFrame:
    """Pairs of points of different exhibits within the window and the radius, joined by time bucket and grid cell.

    The grid has bands of latitude a radius high. Each band is cut into equal cells around the globe, as many as are
    at least so wide that two points of the radius, one of them in the band, are in one or in neighbouring cells; near
    the poles that is one. A point is entered in up to nine cells, of its band and the two beside it, each by that
    band's own width and across 180 degrees, so that only near points of a like time meet and none is missed.
    """
    band, cells, cell = _grid(radius_m)
    a = points.select(*(F.col(c).alias(f"{c}_a") for c in points.columns)).withColumn("y", band("latitude_a"))
    a = a.withColumn("x", cell("longitude_a", cells(F.col("y"))))
    b = points.select(*(F.col(c).alias(f"{c}_b") for c in points.columns))
    b = b.withColumn("yy", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: band("latitude_b") + i)))
    b = b.withColumn("n", cells(F.col("yy"))).withColumn("at", cell("longitude_b", F.col("n")))
    b = b.withColumn("xx", F.explode(F.array_distinct(F.array(*(F.pmod(F.col("at") + k, F.col("n")) for k in (-1, 0, 1))))))
    met = range_join(a, b, "timestamp_a", "timestamp_b", window_us, [("y", "yy"), ("x", "xx")])
    metres = geo.haversine(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b"))
    met = met.filter("exhibit_a < exhibit_b").withColumn("metres", metres).filter(F.col("metres") <= radius_m)
    return met.withColumn("at", F.floor((F.col("timestamp_a") + F.col("timestamp_b")) / 2)).drop("y", "x", "yy", "xx", "n")


def encounters(hits: DataFrame, window_us: int = 15 * 60_000_000, radius_m: float = 500.0) -> DataFrame:
    """Meetings of a pair of exhibits, cut where the time or the place jumps, with a confidence. The hits of a pair are dealt out in ranges of time."""
    lat, lon = (F.col("latitude_a") + F.col("latitude_b")) / 2, (F.col("longitude_a") + F.col("longitude_b")) / 2
    keys, order = ("exhibit_a", "exhibit_b"), ("at", "artifact_id_a", "artifact_id_b")
    t = in_order(hits.withColumns({"lat": lat, "lon": lon}), keys, order)
    t = previous(t, keys, order, {"_at": F.col("at"), "_lat": F.col("lat"), "_lon": F.col("lon")})
    moved = geo.haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) > radius_m
    new = F.when((F.col("at") - F.col("_at") > window_us) | moved, 1).otherwise(0)
    made = running(t, keys, order, new, "encounter")
    return made.groupBy("exhibit_a", "exhibit_b", "encounter").agg(*_measures()).withColumn("confidence", _sureness(window_us, radius_m))


def _measures() -> list[Column]:
    apart = F.abs(F.col("timestamp_a") - F.col("timestamp_b"))
    return [
        F.count(F.lit(1)).alias("hits"), F.min("at").alias("start"), F.max("at").alias("stop"),
        F.min("metres").alias("nearest_m"), F.min(apart).alias("closest_us"), F.min(F.least("weight_a", "weight_b")).alias("weight"),
    ]


def _sureness(window_us: int, radius_m: float) -> Column:
    space, time = 1 - F.col("nearest_m") / radius_m, 1 - F.col("closest_us") / window_us
    more = F.least(F.lit(0.15), 0.03 * (F.col("hits") - 1))
    return F.round(F.least(F.lit(0.95), 0.45 + 0.20 * space + 0.15 * time + more) * F.col("weight"), 6)


PAIR = ("exhibit_a", "exhibit_b")


def _sliced(points: DataFrame, window_us: int, radius_m: float, most: int = 4_000_000) -> DataFrame:
    """Encounters within slices of time a window long, by the instants between both points: (_slice, exhibit_a, exhibit_b, _nth) and measures.

    Points are dealt out by slice, each to the one or two that its meetings can lie in; the pairs are made, put in order, cut and summed up in the task
    that holds the slice, so that no pair is ever shuffled or stored. Tasks are so many that each has about most candidates. The first and the last
    encounter of a slice, which may go on in the slices beside it, have _first and _last, the place of the slice's first and last hit.
    """
    band, cells, cell = _grid(radius_m)
    t = F.col("timestamp")
    lowest, highest = F.floor((t - window_us / 2) / window_us), F.floor((t + window_us / 2) / window_us)
    p = points.withColumn("_slice", F.explode(F.sequence(lowest, highest))).withColumn("y", band("latitude"))
    dense = p.groupBy("_slice", "y", cell("longitude", cells(F.col("y"))).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    some = dense.groupBy("_slice").agg(F.sum(F.col("n") * F.col("n")).alias("n")).agg(F.sum("n"), F.count(F.lit(1))).first()
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, min(some[1], int(3 * (some[0] or 0) / most)))
    p = p.repartition(tasks, "_slice")  # the groups and windows below stay in these
    # side a in its own cell, side b in that and those around
    e = p.withColumn("_i", F.explode(F.array(F.lit(None).cast("int"), F.lit(-1), F.lit(0), F.lit(1)))).withColumn("y", F.col("y") + F.coalesce("_i", F.lit(0)))
    e = e.withColumn("n", cells(F.col("y"))).withColumn("x", cell("longitude", F.col("n")))
    around = F.array_distinct(F.array(*(F.pmod(F.col("x") + k, F.col("n")) for k in (-1, 0, 1))))
    e = e.withColumn("x", F.explode(F.when(F.col("_i").isNull(), F.array("x")).otherwise(around)))
    point = F.struct(*points.columns)
    held = e.groupBy("_slice", "y", "x").agg(F.collect_list(F.when(F.col("_i").isNull(), point)).alias("a"), F.collect_list(F.when(F.col("_i").isNotNull(), point)).alias("b"))
    met = held.select("_slice", "b", F.explode("a").alias("a")).select("_slice", "a", F.explode("b").alias("b"))
    met = met.select("_slice", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in ("a", "b") for c in points.columns))
    met = met.filter((F.col("exhibit_a") < F.col("exhibit_b")) & (F.abs(F.col("timestamp_a") - F.col("timestamp_b")) <= window_us))
    met = met.withColumn("at", F.floor((F.col("timestamp_a") + F.col("timestamp_b")) / 2)).filter(F.floor(F.col("at") / window_us) == F.col("_slice"))
    metres = geo.haversine(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b"))
    met = met.withColumn("metres", metres).filter(F.col("metres") <= radius_m)
    lat, lon = (F.col("latitude_a") + F.col("latitude_b")) / 2, (F.col("longitude_a") + F.col("longitude_b")) / 2
    met = met.withColumns({"lat": lat, "lon": lon})
    w = W.partitionBy("_slice", *PAIR).orderBy("at", "artifact_id_a", "artifact_id_b")
    met = met.withColumns({"_at": F.lag("at").over(w), "_lat": F.lag("lat").over(w), "_lon": F.lag("lon").over(w), "_next": F.lead("at").over(w)})
    new = F.when(F.col("_at").isNotNull() & _jumps(window_us, radius_m, "_at", "_lat", "_lon", "at", "lat", "lon"), 1).otherwise(0)  # from 0 in a slice
    met = met.withColumn("_new", new).withColumn("_nth", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = [F.max(F.when(F.col(end).isNull(), F.col(c))).alias(f"{name}_{c}") for name, end in (("_first", "_at"), ("_last", "_next")) for c in ("lat", "lon")]
    return met.groupBy("_slice", *PAIR, "_nth").agg(*_measures(), *ends)


def _jumps(window_us: int, radius_m: float, at0: str, lat0: str, lon0: str, at: str, lat: str, lon: str) -> Column:
    """Whether time or place jumps between two hits; so it does at the first one."""
    return F.col(at0).isNull() | (F.col(at) - F.col(at0) > window_us) | (geo.haversine(F.col(lat0), F.col(lon0), F.col(lat), F.col(lon)) > radius_m)


#: Whether an encounter is the first or the last of its slice.
EDGE = "_first_lat is not null or _last_lat is not null"


def _numbered(edges: DataFrame, window_us: int, radius_m: float) -> DataFrame:
    """edges, the first and last encounters of slices, with encounter, their number in their pair: a first one goes on with the last one before it if nothing jumps."""
    w = W.partitionBy(*PAIR).orderBy("_slice", "_nth")
    t = edges.withColumns({"_at": F.lag("stop").over(w), "_lat": F.lag("_last_lat").over(w), "_lon": F.lag("_last_lon").over(w)})
    apart = F.when(_jumps(window_us, radius_m, "_at", "_lat", "_lon", "start", "_first_lat", "_first_lon"), 1).otherwise(0)
    more = F.when(F.col("_first_lat").isNotNull(), apart).otherwise(F.col("_nth"))
    return t.withColumn("_more", more).withColumn("encounter", F.sum("_more").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_at", "_lat", "_lon", "_more")


def _merged(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy(*PAIR, "encounter").agg(
        F.sum("hits").alias("hits"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("nearest_m").alias("nearest_m"), F.min("closest_us").alias("closest_us"), F.min("weight").alias("weight")
    )


def encounters_of(points: DataFrame, window_us: int = 15 * 60_000_000, radius_m: float = 500.0) -> DataFrame:
    """encounters(meetings(points)) without listing the meetings: made once for the ends of slices, which tell how slices go on, and once for the rest."""
    local = _sliced(points, window_us, radius_m)
    ends = _numbered(checkpointed(local.filter(EDGE)), window_us, radius_m)
    base = ends.filter("_first_lat is not null").select("_slice", *PAIR, F.col("encounter").alias("_base"))
    inner = local.filter(f"not ({EDGE})").join(base, ["_slice", *PAIR]).withColumn("encounter", F.col("_base") + F.col("_nth"))
    out = _merged(ends)
    return out.unionByName(inner.select(*out.columns)).withColumn("confidence", _sureness(window_us, radius_m))


def pair_summary_of(points: DataFrame, window_us: int = 15 * 60_000_000, radius_m: float = 500.0) -> DataFrame:
    """pair_summary(encounters_of(points)) with the meetings made once: slices give their ends and, by pair and day, the number of other encounters."""
    sure, day = _sureness(window_us, radius_m), timex.day_of(F.col("start"))
    local = _sliced(points, window_us, radius_m).withColumns({"confidence": sure, "day": day, "_edge": F.when(F.expr(EDGE), F.col("_nth"))})
    kept = ("_nth", "hits", "start", "stop", "nearest_m", "closest_us", "weight", "_first_lat", "_first_lon", "_last_lat", "_last_lon")
    told = checkpointed(local.groupBy("_slice", *PAIR, "day", "_edge").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), *(F.max(c).alias(c) for c in kept)))
    ends = _merged(_numbered(told.filter(EDGE), window_us, radius_m))
    ends = ends.select(*PAIR, day.alias("day"), F.lit(1).cast("long").alias("n"), sure.alias("confidence"))
    every = told.filter(f"not ({EDGE})").select(*ends.columns).unionByName(ends)
    return _kinds(every.groupBy(*PAIR).agg(F.sum("n").alias("encounters"), F.count_distinct("day").alias("days"), F.max("confidence").alias("confidence")))


def pair_summary(met: DataFrame) -> DataFrame:
    """Pairs with encounters, days and whether they are repeated or travelling together."""
    day = timex.day_of(F.col("start"))
    out = met.groupBy("exhibit_a", "exhibit_b").agg(
        F.count(F.lit(1)).alias("encounters"), F.count_distinct(day).alias("days"), F.max("confidence").alias("confidence")
    )
    return _kinds(out)


def _kinds(out: DataFrame) -> DataFrame:
    travelling = (F.col("encounters") >= 8) & (F.col("days") >= 5)
    repeated = (F.col("encounters") >= 3) & (F.col("days") >= 3)
    return out.withColumn("kind", F.when(travelling, "travelling").when(repeated, "repeated").otherwise("single"))


def grid(df: DataFrame) -> DataFrame:
    """Cells of a hundredth of a degree with counts, days and bounds."""
    good = df.filter(geo.plausible(F.col("latitude"), F.col("longitude")))
    return good.groupBy(geo.cell(F.col("latitude")).alias("y"), geo.cell(F.col("longitude")).alias("x")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("exhibit").alias("exhibits"),
        F.count_distinct(timex.day_of(F.col("timestamp"))).alias("days"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
    )


def tracks(df: DataFrame, least: int = 2) -> DataFrame:
    """Per exhibit and day the number of fixes and the metres between them in order."""
    day = timex.day_of(F.col("timestamp"))
    made = df.filter(geo.plausible(F.col("latitude"), F.col("longitude")) & F.col("timestamp").isNotNull()).withColumn("day", day)
    w = W.partitionBy("exhibit", "day").orderBy("timestamp", "artifact_id")
    step = geo.haversine(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    out = made.withColumn("step", step).groupBy("exhibit", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("metres"))
    return out.filter(F.col("n") >= least)


def bounds(df: DataFrame) -> DataFrame:
    """Per exhibit the box of its points, their middle and number."""
    good = df.filter(geo.plausible(F.col("latitude"), F.col("longitude")))
    return good.groupBy("exhibit").agg(
        F.count(F.lit(1)).alias("n"), F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"),
        F.round(F.avg("latitude"), 6).alias("latitude"), F.round(F.avg("longitude"), 6).alias("longitude"),
    )

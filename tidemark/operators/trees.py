"""Folder trees from the metadata of files: sums rolled up, hidden and left-behind folders, and when the device was set up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import beside

DAY_US = 86_400_000_000
# Parts of the names of folders in which apps hide things, and the endings they give to what they hide.
HIDING_FOLDERS = (".hidedata", ".vault", ".gallery_lock", ".hideitpro", ".calculator_vault", ".privacy", ".applock", ".keepsafe", ".secure_gallery", ".nomedia_vault")
HIDING_ENDINGS = (".hid", ".vault", ".lock", ".enc", ".sec", ".hdt", ".dat0")
# Beginnings of packages that belong to the system, which have data without being installed.
SYSTEM_PACKAGES = (
    "android", "com.android.", "com.google.android.", "com.qualcomm.", "com.samsung.android.", "com.sec.android.", "com.mediatek.", "com.miui.", "com.xiaomi.",
    "com.huawei.", "com.oppo.", "com.vivo.", "com.oneplus.", "com.motorola.", "com.lge.", "com.sonyericsson.", "com.qti.", "vendor.qti.", "com.svox.", "org.chromium.",
)
#: A folder of an app's private data ends the path; its name is the package.
PRIVATE = r"data/(?:data|user/[0-9]+)/([a-z][\w.]+\.[\w.]+)$"


def _clean(path: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.col(path), "/+", "/"), "^/|/$", "")


def entered(files: DataFrame, deepest: int = 12) -> DataFrame:
    """files (path, ...) once for each folder that holds them, near or far, with folder, depth (1 at the top) and direct.

    Folders below deepest are not entered; what they hold is, under those above. A file without a folder is under none.
    """
    parts = F.split(_clean("path"), "/")
    last = F.size("_parts") - 1
    each = files.withColumn("_parts", parts).withColumn("depth", F.explode(F.sequence(F.lit(1), F.least(last, F.lit(deepest))))).filter((F.col("depth") >= 1) & (last >= 1))
    return each.withColumns({"folder": F.array_join(F.slice("_parts", F.lit(1), F.col("depth")), "/"), "direct": F.col("depth") == last}).drop("_parts")


def sums(files: DataFrame, deepest: int = 12) -> DataFrame:
    """(folder, depth) with files, bytes, direct files, folders inside and times, from files (path, size, modified).

    Every file is entered under each of its folders and all sums are taken in one aggregation, partly before they are shuffled; so
    a folder that holds a third of all files is a row from each task and no more.
    """
    inner = F.when(~F.col("direct"), F.get(F.split(F.substring(_clean("path"), F.length("folder") + 2, F.length("path")), "/"), F.lit(0)))
    return entered(files, deepest).groupBy("folder", "depth").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.when(F.col("direct"), 1)).alias("direct"),
        F.count_distinct(inner).alias("folders"), F.min("modified").alias("oldest"), F.max("modified").alias("newest"),
    )


def hidden(files: DataFrame, deepest: int = 12) -> DataFrame:
    """(path, why, files): folders of hiding apps with the files in them, and files with an ending that such apps give."""
    marked = F.rlike(F.lower("folder"), F.lit("|".join(m.replace(".", r"\.") for m in HIDING_FOLDERS)))
    folders = entered(files, deepest).filter(marked).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))
    ending = F.rlike(F.lower("path"), F.lit(r"[^/.][^/]*(" + "|".join(e.replace(".", r"\.") for e in HIDING_ENDINGS) + ")$"))
    named = files.filter(ending).select(_clean("path").alias("path"), F.lit("ending").alias("why"), F.lit(1).cast("long").alias("files"))
    return folders.select(F.col("folder").alias("path"), F.lit("folder").alias("why"), "files").unionByName(named)


def caches(files: DataFrame) -> DataFrame:
    """(path, why, size): stores of thumbnails, which keep pictures that are gone, and encrypted backups, by name."""
    name = F.lower(F.substring_index("path", "/", -1))
    why = F.when(F.rlike(name, F.lit(r"^\.?thumbdata")), "thumbnails").when(F.contains(name, F.lit(".crypt")), "encrypted backup")
    return files.select(_clean("path").alias("path"), why.alias("why"), "size").filter("why is not null")


def packages(files: DataFrame, deepest: int = 12) -> DataFrame:
    """(package, files, bytes, newest) of the folders of apps' private data."""
    found = F.regexp_extract(F.lower("folder"), PRIVATE, 1)
    held = entered(files, deepest).withColumn("package", found).filter("package <> ''")
    return held.groupBy("package").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max("modified").alias("newest"))


def left_behind(files: DataFrame, installed: DataFrame, system: Sequence[str] = SYSTEM_PACKAGES, deepest: int = 12) -> DataFrame:
    """packages() whose app isn't in installed (package): it was removed and its data stayed. None if nothing is known to be installed."""
    own = packages(files, deepest).filter(~F.rlike("package", F.lit("^(" + "|".join(("android$", *(p.replace(".", r"\.") for p in system if p != "android"))) + ")")))
    known = installed.select(F.lower("package").alias("package")).distinct()
    left = own.join(known, "package", "left_anti")
    return beside(left, known.agg(F.count(F.lit(1)).alias("_known"))).filter("_known > 0").drop("_known")


def watched_apps(files: DataFrame, installed: DataFrame, watched: DataFrame) -> DataFrame:
    """watched (package, name, kind) that are installed or have data, with which of both it is."""
    named = installed.select(F.lower("package").alias("package")).distinct().withColumn("installed", F.lit(True))
    there = packages(files).select("package", F.lit(True).alias("data_there"))
    met = watched.join(named, "package", "left").join(there, "package", "left")
    no = F.lit(False)
    return met.filter("installed or data_there").withColumns({"installed": F.coalesce("installed", no), "data_there": F.coalesce("data_there", no)})


def reset_estimate(files: DataFrame, least: int = 20, longest_days: int = 400, share: float = 0.30) -> DataFrame:
    """One row, or none: when the device was set up anew, if many files are no more than a day younger than the oldest.

    From the distribution of times alone: the floor is the earliest time; files at it are those within a day. Fewer than least
    files, a span of none or over longest_days days, or less than share of the files at the floor give no row. confidence is medium over a half.
    """
    dated = files.filter("modified is not null").select("modified")
    ends = dated.agg(F.count(F.lit(1)).alias("files"), F.min("modified").alias("floor"), F.max("modified").alias("_last"))
    at_floor = beside(dated, ends).filter(F.col("modified") <= F.col("floor") + DAY_US).agg(F.count(F.lit(1)).alias("at_floor"))
    made = beside(ends, at_floor).withColumns({"days": (F.col("_last") - F.col("floor")) / DAY_US, "ratio": F.col("at_floor") / F.col("files")})
    made = made.filter((F.col("files") >= least) & (F.col("days") > 0) & (F.col("days") <= longest_days) & (F.col("ratio") >= share))
    return made.select("floor", "files", "at_floor", F.round("ratio", 3).alias("ratio"), F.round("days", 1).alias("days"), F.when(F.col("ratio") > 0.5, "medium").otherwise("low").alias("confidence"))

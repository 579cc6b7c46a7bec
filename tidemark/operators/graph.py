"""Graphs of who deals with whom: edges, nodes, components, communities, betweenness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import numbered
from .tables import checkpointed, discarded, spread


def edges(df: DataFrame, source: str, target: str, measures: Sequence = ()) -> DataFrame:
    """Undirected edges with their weight and further measures; ends in order, no loops."""
    a, b = F.least(source, target), F.greatest(source, target)
    met = df.filter(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)))
    return met.groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("weight"), *measures)


def owner_edges(df: DataFrame) -> DataFrame:
    """Edges of an exhibit's owner to parties, with calls, messages, seconds, counts each way and reciprocity."""
    count = lambda c: F.count(F.when(c, 1))
    made = df.filter(F.col("category").isin("Calls", "Messages", "Chats")).groupBy("exhibit", "party").agg(
        F.count(F.lit(1)).alias("weight"), count(F.col("category") == "Calls").alias("calls"),
        count(F.col("category") != "Calls").alias("messages"),
        count(F.col("direction") == "outgoing").alias("sent"), count(F.col("direction") == "incoming").alias("received"),
        F.count_distinct("app").alias("apps"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.coalesce(F.sum(F.col("timestamp_end") - F.col("timestamp")), F.lit(0)).alias("talk_us"),
    )
    most = F.greatest("sent", "received")
    return made.withColumn("reciprocity", F.when(most > 0, F.least("sent", "received") / most).otherwise(0.0))


def one_way(owner: DataFrame, least: int = 4) -> DataFrame:
    return owner.filter((F.least("sent", "received") == 0) & (F.greatest("sent", "received") >= least))


def mirrored(e: DataFrame) -> DataFrame:
    return e.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(
        e.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight")
    )


def degrees(e: DataFrame) -> DataFrame:
    """Distinct neighbours and summed weight of each node; edges are distinct, so neighbours are counted."""
    return mirrored(e).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def components(e: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root), root the smallest node reachable. Labels take neighbours' minima and then their labels' labels."""
    both = checkpointed(mirrored(e).select("node", "other"))  # else each round would make the edges again
    now = checkpointed(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")))
    for _ in range(max_rounds):
        near = both.join(now.select(F.col("node").alias("other"), F.col("root").alias("r")), "other").groupBy("node").agg(F.min("r").alias("r"))
        after = now.join(near, "node").select("node", F.least("root", "r").alias("root"))
        jump = after.select(F.col("node").alias("root"), F.col("root").alias("r2"))
        after = checkpointed(after.join(jump, "root").select("node", F.col("r2").alias("root")))
        changed = after.join(now.withColumnRenamed("root", "old"), "node").filter("root <> old")
        if changed.isEmpty():
            return after
        now = after
    raise RuntimeError(f"components not found in {max_rounds} rounds")


def coloured(e: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, colour): no two neighbours have one colour, numbers from 0.

    In each round the nodes without a colour that come before all such neighbours, by degree and then by a hash, take the smallest number that
    no neighbour has. Hubs come first, so that bipartite graphs of a few hubs and many others need two colours.
    """
    both = checkpointed(mirrored(e).select("node", "other"))
    rank = F.struct((-F.count(F.lit(1))).alias("d"), F.xxhash64("node").alias("h"), F.col("node").alias("n"))
    open_nodes = checkpointed(both.groupBy("node").agg(rank.alias("rank")))
    done = None
    for _ in range(max_rounds):
        # edges between nodes that are still open tell who comes first; edges to coloured ones what is taken
        at = both.join(open_nodes, "node")
        met = at.join(open_nodes.select(F.col("node").alias("other"), F.col("rank").alias("r")), "other", "left")
        first = met.groupBy("node").agg(F.min("r").alias("r"), F.first("rank").alias("rank"))
        chosen = first.filter("r is null or rank < r").select("node", "rank")
        if done is None:
            fresh = chosen.select("node", F.lit(0).alias("colour"))
        else:
            taken = both.join(chosen, "node").join(done.select(F.col("node").alias("other"), "colour"), "other", "left")
            used = taken.groupBy("node").agg(F.collect_set("colour").alias("used"))  # no more than there are colours
            free = F.array_except(F.sequence(F.lit(0), F.size("used")), "used")
            fresh = used.select("node", F.array_min(free).alias("colour"))
        fresh = checkpointed(fresh)
        left = checkpointed(open_nodes.join(fresh, "node", "left_anti"))
        discarded(open_nodes)
        open_nodes, done = left, fresh if done is None else done.unionByName(fresh)
        if open_nodes.isEmpty():
            return done
    raise RuntimeError(f"not coloured in {max_rounds} rounds")


def communities(e: DataFrame, colours: DataFrame | None = None, max_sweeps: int = 200) -> DataFrame:
    """(node, label, community) by label propagation: the label with most weight among neighbours, ties to the own and then the smallest.

    Nodes of one colour take their labels at a time, colour after colour; colours (node, colour) must differ between neighbours, and are
    found by coloured() if not given. As no neighbours move together and nobody moves without more weight on the new label than on
    the own one, the weight inside labels grows with every move, so that the sweeps end; they are over when one moves
    nobody. community numbers the labels from 0 by their number of nodes, then by label.
    """
    own_colours = colours is None
    colours = coloured(e) if own_colours else colours
    both = checkpointed(mirrored(e).join(colours, "node"), "colour")
    start = checkpointed(both.select("node", "colour").distinct(), "colour")
    order = [r["colour"] for r in start.select("colour").distinct().orderBy("colour").collect()]
    of = lambda c: F.col("colour") == c
    # a table of labels for each colour: neighbours' are read, and only those of the colour in turn are written anew
    now = {c: start.filter(of(c)).select("node", F.col("node").alias("label")) for c in order}
    stored = {}
    joined = lambda cs: reduce(DataFrame.unionByName, (now[c].select("node", "label") for c in cs))
    still = 0  # colours in turn that moved nobody
    for k in range(max_sweeps * max(1, len(order))):
        if still == len(order):
            break
        c = order[k % len(order)]
        others = joined([x for x in order if x != c])
        votes = both.filter(of(c)).join(others.withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        mine = now[c].select("node", F.col("label").alias("own"))
        best = votes.join(mine, "node").groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("label") != F.col("own"), "label")).alias("b"), F.first("own").alias("own"))
        after = checkpointed(best.select("node", "b.label", (F.col("b.label") != F.col("own")).alias("moved")))
        still = still + 1 if after.filter("moved").isEmpty() else 0
        if c in stored:
            discarded(stored[c])
        now[c] = stored[c] = after
    else:
        raise RuntimeError(f"communities not settled in {max_sweeps} sweeps")
    now = joined(order) if order else start.select("node", F.col("node").alias("label"))
    sizes = now.groupBy("label").agg(F.count(F.lit(1)).alias("_size"))
    ranks = numbered(sizes, [F.col("_size").desc(), F.col("label")], "_rank").select("label", (F.col("_rank") - 1).alias("community"))
    return now.join(ranks, "label").select("node", "label", "community")


def modularity(e: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with Q and the number of communities."""
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    inside = e.join(a, "a").join(b, "b").agg(F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0)).alias("inside"), F.sum("weight").alias("m"))
    strength = degrees(e).join(labels, "node").groupBy("label").agg(F.sum("strength").alias("s"))
    total = strength.agg(F.sum(F.pow(F.col("s"), F.lit(2))).alias("squares"), F.count(F.lit(1)).alias("communities"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(inside).join(one(total), "_one").select(
        (F.col("inside") / F.col("m") - F.col("squares") / F.pow(2 * F.col("m"), F.lit(2))).alias("q"), "communities"
    )


def betweenness(e: DataFrame, max_depth: int = 64, sources: int = 1_024) -> DataFrame:
    """(node, betweenness), 0 to 1: share of the shortest paths between two others that pass a node, unweighted.

    Sources are taken so many at a time. From those a frontier of (source, node, paths) grows by one step a round and is counted back
    from the last step to the first; then its tables are deleted and only the sums by node stay, so what is held is as many rows as
    a batch of sources reaches nodes, whatever the number of sources. The work is that of all sources on all edges, in the nature of the measure.
    """
    both = checkpointed(mirrored(e).select(F.col("node").alias("v"), "other").distinct())
    nodes = checkpointed(numbered(both.select("v").distinct(), [F.col("v")], "nth"))
    n = nodes.count()
    sums = []
    for first in range(0, n, sources):
        own = nodes.filter((F.col("nth") > first) & (F.col("nth") <= first + sources))
        sums.append(_dependencies(both, own, max_depth))
    total = None if not sums else sums[0]
    for x in sums[1:]:
        total = total.unionByName(x)
    named = nodes.select(F.col("v").alias("node"))
    if total is None:
        return named.withColumn("betweenness", F.lit(0.0))
    total = total.groupBy("node").agg(F.sum("share").alias("share"))
    pairs = float(max(1, (n - 1) * (n - 2)))
    return named.join(total, "node", "left").select("node", F.round(F.coalesce("share", F.lit(0.0)) / pairs, 5).alias("betweenness"))


def _dependencies(both: DataFrame, sources: DataFrame, max_depth: int) -> DataFrame:
    """(node, share): what paths from some sources pass each node, stored; all else that was stored on the way is deleted."""
    levels = [checkpointed(sources.select(F.col("v").alias("s"), "v", F.lit(1.0).alias("paths")))]
    seen = levels[0].select("s", "v")
    for _ in range(max_depth):
        step = levels[-1].join(both, "v").groupBy("s", F.col("other").alias("v")).agg(F.sum("paths").alias("paths"))
        step = checkpointed(step.join(seen, ["s", "v"], "left_anti"))
        levels.append(step)
        if step.isEmpty():
            break
        seen = seen.unionByName(step.select("s", "v"))
    else:
        raise RuntimeError(f"paths of more than {max_depth} steps")
    made, later = [], levels[-1].withColumn("share", F.lit(0.0))
    for before in reversed(levels[:-1]):
        back = later.select("s", "v", F.col("paths").alias("_p"), F.col("share").alias("_d")).join(both, "v")
        back = back.select("s", F.col("other").alias("v"), ((1 + F.col("_d")) / F.col("_p")).alias("part"))
        gained = before.join(back, ["s", "v"]).groupBy("s", "v").agg((F.first("paths") * F.sum("part")).alias("share"))
        later = checkpointed(before.join(gained, ["s", "v"], "left").withColumn("share", F.coalesce("share", F.lit(0.0))))
        made.append(later)
    found = made[0]
    for x in made[1:]:
        found = found.unionByName(x)
    kept = checkpointed(found.filter("s <> v").groupBy(F.col("v").alias("node")).agg(F.sum("share").alias("share")))
    discarded(*levels, *made)
    return kept


def community_report(e: DataFrame, labels: DataFrame) -> DataFrame:
    """Communities with their size, weight inside and cohesion, the share of their edges' weight that stays inside."""
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    named = e.join(a, "a").join(b, "b")
    ends = named.select(F.explode(F.array_distinct(F.array("la", "lb"))).alias("label"), "weight", (F.col("la") == F.col("lb")).alias("within"))
    met = ends.groupBy("label").agg(F.sum("weight").alias("weight"), F.coalesce(F.sum(F.when(F.col("within"), F.col("weight"))), F.lit(0)).alias("inside"))
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return size.join(met, "label", "left").select("label", "size", "weight", "inside", F.round(F.col("inside") / F.col("weight"), 6).alias("cohesion"))


def labelled(named: DataFrame, contacts: DataFrame | None = None) -> DataFrame:
    """(key, label): of the names seen with a key (key, name) the most frequent, ties by name; a contact (key, name) overrides it.

    A key without a name is its own label.
    """
    votes = named.groupBy("key", "name").agg(F.count(F.when(F.col("name") != "", 1)).alias("n"))
    best = votes.groupBy("key").agg(F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("n"), "name"))).alias("b"))
    out = best.select("key", F.col("b.name").alias("label"))
    if contacts is not None:
        saved = contacts.filter("name <> ''").groupBy("key").agg(F.min("name").alias("_saved"))
        out = out.join(saved, "key", "left").select("key", F.coalesce("_saved", "label").alias("label"))
    return out.select("key", F.coalesce("label", "key").alias("label"))


def pairs_within(df: DataFrame, group: str, member: str) -> DataFrame:
    """Edges of all that are on one artifact together (group, member), each pair once a group, in order.

    Groups are the parties of one artifact, a few each; the pairs are made in the row that holds a group.
    """
    held = df.filter(F.col(member).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("m"))
    later = lambda a, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a.alias("a"), b.alias("b")))
    n = F.size("m").cast("long")
    made = spread(held.select("m"), n * (n - 1) / 2).select(F.inline(F.flatten(F.transform("m", later))))
    return made.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def trimmed(e: DataFrame, least_weight: int = 1, most_nodes: int = 400) -> DataFrame:
    """The edges among the first most_nodes nodes that come up in order of weight, ties by ends: a view to be drawn.

    Only as many edges as may fill the view are ever ranked.
    """
    some = e.filter(F.col("weight") >= least_weight)
    order = (F.col("weight").desc(), F.col("a"), F.col("b"))
    # a node is new with one of the first edges of its own; among the heaviest edges so many nodes need no more than this
    ends = some.select("a", "b", "weight").orderBy(*order).limit(most_nodes * most_nodes)
    ranked = ends.withColumn("_rank", F.row_number().over(W.orderBy(*order)))
    first = ranked.select(F.explode(F.array("a", "b")).alias("node"), "_rank").groupBy("node").agg(F.min("_rank").alias("_rank"))
    kept = first.orderBy("_rank", "node").limit(most_nodes).select("node")
    return some.join(F.broadcast(kept.withColumnRenamed("node", "a")), "a", "left_semi").join(F.broadcast(kept.withColumnRenamed("node", "b")), "b", "left_semi")


def top_contacts(owner: DataFrame, most: int = 20) -> DataFrame:
    """Per exhibit the parties with most traffic, ties by party."""
    rank = F.row_number().over(W.partitionBy("exhibit").orderBy(F.col("weight").desc(), "party"))
    return owner.withColumn("rank", rank).filter(F.col("rank") <= most)


def brokers(between: DataFrame, most: int = 10) -> DataFrame:
    """The nodes that most shortest paths pass, ties by node."""
    return between.filter("betweenness > 0").orderBy(F.col("betweenness").desc(), "node").limit(most)


def graphml(e: DataFrame, path: str) -> None:
    """Edges as GraphML elements, one a line in part files, the head in one and the tail in another: read in order of name it is one document."""
    text = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    nodes = e.select(F.explode(F.array("a", "b")).alias("a")).distinct().select(F.lit(1).alias("k"), F.concat(F.lit('<node id="'), text("a"), F.lit('"/>')).alias("value"))
    links = e.select(
        F.lit(2).alias("k"), F.concat(F.lit('<edge source="'), text("a"), F.lit('" target="'), text("b"), F.lit('"><data key="weight">'), "weight", F.lit("</data></edge>")).alias("value")
    )
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="weight" for="edge" attr.name="weight" attr.type="long"/><graph edgedefault="undirected">'
    spark = e.sparkSession
    ends = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "k int, value string")
    every = ends.unionByName(nodes).unionByName(links)
    every.repartitionByRange("k", "value").sortWithinPartitions("k", "value").select("value").write.mode("overwrite").text(path)


def meaningful(e: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: Q, communities, and whether they say something: Q of 0.3 and two groups at least."""
    return modularity(e, labels).withColumn("meaningful", (F.col("q") >= 0.3) & (F.col("communities") >= 2))

"""Orders carried over ranges, deep pages, communities, the text index and many terms."""

import collections
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import graph, index, keywords, order, places, search, timeline
from tidemark.operators.index import TextIndex
from tidemark.plans import predicates as P

MIN = 60_000_000


@pytest.fixture
def many_partitions(spark):
    """Many ranges of few rows, which aren't put together again."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def traffic(spark, n=4_000, seed=1):
    """Nearly all rows of one party."""
    rnd = random.Random(seed)
    rows, t = [], 0
    for k in range(n):
        t += rnd.choice([1, 5, 44, 45, 46, 600]) * MIN
        rows.append((f"a{k:05}", "hot" if k % 50 else rnd.choice(["x", None, "y"]), t, f"s{k % 7}", "app"))
    return rows, spark.createDataFrame(rows, "artifact_id string, party string, timestamp long, subtype string, app string")


def by_party(rows):
    held = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        held[r[1]].append(r)
    return held


def test_bursts_and_gaps_of_a_hot_key_lie_in_many_ranges(spark, many_partitions):
    rows, df = traffic(spark)
    want_bursts, want_gaps = collections.Counter(), collections.Counter()
    for party, own in by_party(rows).items():
        run = [own[0]]
        for a, b in zip([*own, None], [*own[1:], None, None], strict=False):
            if b is not None and b[2] - a[2] >= 8 * 60 * MIN:
                want_gaps[party, a[2], b[2], a[3], b[3]] += 1
            if b is not None and b[2] - a[2] <= 45 * MIN:
                run.append(b)
            elif a is not None:
                if len(run) >= 3:
                    want_bursts[party, len(run), run[0][2], run[-1][2]] += 1
                run = [b]
    got = collections.Counter((r.party, r.n, r.start, r.stop) for r in timeline.bursts(df).collect())
    assert got == want_bursts and sum(want_bursts.values()) > 100
    assert collections.Counter((r.party, r.start, r.stop, r.before, r.after) for r in timeline.gaps(df).collect()) == want_gaps
    t = order.in_order(df, ["party"], ["timestamp", "artifact_id"])
    sizes = [r["count"] for r in t.filter("party = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * len(rows) / 16


def test_anomalies_of_a_hot_app(spark, many_partitions):
    rows, df = traffic(spark, 2_000)
    shuffled = df.withColumn("timestamp", F.when(F.col("artifact_id").substr(-1, 1) == "7", F.col("timestamp") - 10 * 60 * MIN).otherwise(F.col("timestamp")))
    line = [r.timestamp for r in shuffled.orderBy("artifact_id").collect()]
    got = timeline.anomalies(shuffled, 10**18).first()
    assert (got.n, got.back) == (2_000, sum(a - b > 60 * MIN for a, b in zip(line, line[1:], strict=False))) and got.back > 100


def test_encounters_of_one_pair_over_ranges(spark, many_partitions):
    rnd = random.Random(3)
    hits, t = [], 0
    for k in range(900):
        t += rnd.choice([1, 14, 15, 16]) * MIN
        hits.append(("A", "B", f"p{k}", f"q{k}", t, t, t, 19.0 + rnd.choice([0, 0.001, 0.01]), 72.0, 10.0, 1.0))
    names = "exhibit_a string, exhibit_b string, artifact_id_a string, artifact_id_b string, timestamp_a long, timestamp_b long, at long, lat double, lon double, metres double, w double"
    df = spark.createDataFrame(hits, names).withColumns({c + s: F.col(c0) for c, c0 in (("latitude_", "lat"), ("longitude_", "lon"), ("weight_", "w")) for s in "ab"}).drop("lat", "lon", "w")
    cuts = sum(b[6] - a[6] > 15 * MIN or abs(a[7] - b[7]) > 0.0045 for a, b in zip(hits, hits[1:], strict=False))
    got = places.encounters(df).collect()
    assert len(got) == cuts + 1 and sum(r.hits for r in got) == 900


def test_running_sums_and_numbers(spark, many_partitions):
    rnd = random.Random(4)
    rows = [(rnd.choice(["k", "k", "k", None, "z"]), k, rnd.randint(0, 9)) for k in range(700)]
    df = spark.createDataFrame(rows, "key string, at long, v long").repartition(5)
    got = {r.at: r.s for r in order.running(order.in_order(df, ["key"], ["at"]), ["key"], ["at"], F.col("v"), "s").collect()}
    sums = collections.Counter()
    for key, at, v in rows:
        sums[key] += v
        assert got[at] == sums[key]
    places_of = {r.at: r.place for r in order.numbered(df, [F.col("v").desc(), F.col("at")], "place").collect()}
    assert [at for at, _ in sorted(places_of.items(), key=lambda x: x[1])] == [r[1] for r in sorted(rows, key=lambda r: (-r[2], r[1]))] and sorted(places_of.values()) == list(range(1, 701))
    assert order.numbered(df.limit(0), [F.col("at")], "place").count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages(spark, monkeypatch, descending):
    monkeypatch.setattr(order, "SAMPLED", 200)
    monkeypatch.setattr(search, "SHALLOW", 10)
    rnd = random.Random(5)
    rows = [(f"id{k:05}", rnd.choice([None, 7, 7, 7, rnd.randint(0, 10**6)])) for k in range(5_000)]
    df = spark.createDataFrame(rows, "artifact_id string, timestamp long")
    line = sorted(rows, key=lambda r: (r[1] is None, (-r[1] if descending else r[1]) if r[1] is not None else 0, r[0]))
    for offset, limit in ((0, 20), (1_234, 50), (2_990, 30), (4_990, 50), (6_000, 5)):
        got = order.page(df, "timestamp", "artifact_id", descending, limit, offset, most=100)
        assert [(r.artifact_id, r.timestamp) for r in got.collect()] == line[offset : offset + limit]
        assert [r.artifact_id for r in search.page(df, "timestamp", descending, limit, offset).collect()] == [r[0] for r in line[offset : offset + limit]]
    deep = order.page(df, "timestamp", "artifact_id", descending, 50, 4_000, most=100)._jdf.queryExecution().toString()
    assert "limit=4050" not in deep
    assert order.page(df.limit(0), "timestamp", "artifact_id", descending, 5, 0).count() == 0


# communities


def settled_by_hand(e, colours, labels=None):
    near = collections.defaultdict(dict)
    for a, b, w in e:
        near[a][b] = near[b][a] = w
    labels = labels or {n: n for n in near}
    while True:
        moved = False
        for c in sorted(set(colours.values())):
            new = {}
            for n in near:
                if colours[n] == c:
                    votes = collections.Counter()
                    for o, w in near[n].items():
                        votes[labels[o]] += w
                    new[n] = min(votes, key=lambda x: (-votes[x], x != labels[n], x))
            moved |= any(labels[n] != x for n, x in new.items())
            labels.update(new)
        if not moved:
            return labels


def test_colours_and_communities(spark):
    rnd = random.Random(6)
    groups = [[f"{g}{k:02}" for k in range(12)] for g in "abcd"]
    e = {tuple(sorted(rnd.sample(g, 2))): rnd.randint(3, 9) for g in groups for _ in range(60)}
    e |= {tuple(sorted((rnd.choice(groups[k]), rnd.choice(groups[(k + 1) % 4])))): 1 for k in range(4) for _ in range(2)}
    rows = [(a, b, w) for (a, b), w in e.items()]
    df = spark.createDataFrame(rows, "a string, b string, weight long")
    colours = {r.node: r.colour for r in graph.coloured(df).collect()}
    assert all(colours[a] != colours[b] for a, b in e) and set(colours) == {n for x in e for n in x}
    assert max(colours.values()) <= max(collections.Counter(n for x in e for n in x).values())
    want = settled_by_hand(rows, colours)
    got = graph.communities(df).collect()
    assert {r.node: r.label for r in got} == want and 2 <= len(set(want.values())) <= 12
    sizes = collections.Counter(want.values())
    ranks = {label: k for k, label in enumerate(sorted(sizes, key=lambda x: (-sizes[x], x)))}
    assert all(r.community == ranks[r.label] for r in got)
    q = graph.meaningful(df, graph.communities(df).select("node", "label")).first()
    assert q.meaningful and q.communities == len(sizes)


def test_two_sides_need_two_colours_and_settle(spark):
    rnd = random.Random(7)
    rows = list({(f"c{rnd.randint(0, 400)}", f"s{rnd.randint(0, 9)}"): None for _ in range(2_000)})
    df = spark.createDataFrame([(a, b, rnd.randint(1, 3)) for a, b in rows], "a string, b string, weight long")
    colours = {r.node: r.colour for r in graph.coloured(df).collect()}
    assert set(colours.values()) == {0, 1} and all(colours[a] != colours[b] for a, b in rows)
    assert graph.communities(df).count() == len(colours)


# index and terms


def corpus(spark):
    rnd = random.Random(8)
    words = ["the", "Thé", "cat", "sat", "on", "a", "mat", "x1"]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))), rnd.choice(["blue cat", "", None, "on a mat"])) for k in range(300)]
    return spark.createDataFrame([*rows, (300, None, None), (301, "the " * 400, "the")], "id long, body string, title string")


def test_index_agrees_with_scans_over_appends(spark, tmp_path):
    df = corpus(spark)
    found = TextIndex(spark, f"{tmp_path}/index", buckets=8)
    assert found.append(df.filter("id < 100"), "id", ["body", "title"]) == 100
    assert found.append(df.filter("id < 200"), "id", ["body", "title"]) == 100
    assert found.append(df, "id", ["body", "title"]) == 102 and found.append(df, "id", ["body", "title"]) == 0
    ids = lambda x: sorted(r[0] for r in x.collect())
    for query in ("cat", "CÁT!", "zebra"):
        assert ids(found.word(query, ["body"])) == ids(df.filter(P.word("body", query)).select("id"))
    for query in ("the cat", "the the the", "on a mat", "cat zebra", "x1"):
        assert ids(found.phrase(query, ["body"])) == ids(df.filter(P.phrase("body", query)).select("id"))
        assert ids(found.phrase(query)) == ids(df.filter(P.phrase("body", query) | P.phrase("title", query)).select("id"))
    both = lambda x: {r[0]: r[1] for r in x.collect()}
    filled = df.filter(F.size(text.tokens(F.col("body"))) >= 0)
    assert both(found.ranked("cat mat", "body")) == pytest.approx(both(search.ranked(filled, "id", "body", ["cat", "mat"])), abs=1e-4)
    with pytest.raises(ValueError):
        found.word("...")


def test_index_reads_one_bucket_and_skips_unfinished_batches(spark, tmp_path):
    df = corpus(spark)
    found = TextIndex(spark, f"{tmp_path}/index", buckets=16)
    found.append(df.filter("id < 50"), "id", ["body"])
    before = found.word("cat").count()
    # an append that broke off before its line in batches
    spark.read.parquet(f"{tmp_path}/index/postings").withColumn("batch", F.lit("broken")).write.mode("append").partitionBy("bucket").parquet(f"{tmp_path}/index/postings")
    spark.read.parquet(f"{tmp_path}/index/documents").withColumns({"batch": F.lit("broken"), "doc": F.col("doc") + 1000}).write.mode("append").parquet(f"{tmp_path}/index/documents")
    assert found.word("cat").count() == before and found.documents().count() == 50
    plan = found.of("cat")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,cat)" in plan
    files = found.of("cat").inputFiles()
    assert files  # of all files, those of one folder are opened
    scan = found.of("cat")._jdf.queryExecution().toRdd().getNumPartitions()
    assert scan <= 2


def test_trie_and_join_agree_and_terms_cost_little(spark):
    df = corpus(spark)
    terms = [("the", "The"), ("cat sat", "cat sat"), ("cat sat on", "cat sat on"), ("sat on a mat", "x"), ("zebra", "zebra"), ("thé", "THÉ"), ("a", "A"), ("...", "none")]
    listed = spark.createDataFrame(terms, "folded string, term string")
    want = set()
    for folded, term in terms:
        if term != "none":
            want |= {(r.id, term) for r in df.filter(P.phrase("body", folded)).select("id").collect()}
    pairs = lambda x: collections.Counter(map(tuple, x.collect()))
    assert pairs(keywords.matched(df, "id", "body", listed)) == collections.Counter(want)
    assert pairs(keywords.matched(df, "id", "body", listed, most_terms=2)) == collections.Counter(want)
    rnd = random.Random(9)
    sets = {n: [[rnd.choice("abcdefgh") * rnd.randint(1, 5) for _ in range(rnd.randint(1, 4))] for _ in range(n)] for n in (100, 10_000)}
    lines = [[rnd.choice("abcdefgh") * rnd.randint(1, 5) for _ in range(500)] for _ in range(60)]
    took = {}
    for n, own in sets.items():
        root, began = keywords.trie(own), time.process_time()
        found = [keywords.walked(root, line) for line in lines]
        took[n] = time.process_time() - began
        if n == 100:
            at = lambda w, line: any(line[i : i + len(w)] == w for i in range(len(line) - len(w) + 1))
            named = {tuple(w): k for k, w in enumerate(own)}
            assert found == [{k for w, k in named.items() if at(list(w), line)} for line in lines]
    assert took[10_000] < 20 * took[100] + 0.05


def test_postings_are_made_a_few_words_at_a_time():
    names = ["doc", "field", "term", "positions", "n"]
    lines = [[f"w{k % 7}" for k in range(n)] for n in (30, 0, 50, 10, 20, 300, 5)]
    given = pa.RecordBatch.from_pydict({"doc": list(range(7)), "field": ["f"] * 7, "words": lines})
    made = list(index._posted(iter([given]), names, most=40))
    assert [sum(len(lines[d]) for d in set(b.column(0).to_pylist())) for b in made] == [80, 330, 5]
    got = {(r["doc"], r["term"]): (r["positions"], r["n"]) for b in made for r in b.to_pylist()}
    assert got == {(d, w): ([i for i, x in enumerate(line) if x == w], len(line)) for d, line in enumerate(lines) for w in line}

"""Tiles, triage, next steps, findings from more than artifacts, and betweenness by batches of sources."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dashboard, findings, graph, timeline
from tidemark.sources import artifacts as A

T0 = 1_704_067_200_000_000


def everything(spark):
    rows = spark.createDataFrame([(k, "Web", f"http://h{k % 20}.org/") for k in range(400)] + [(1000, "Networks", ""), (1001, "Accounts", ""), (1002, "Calls", ""), (1003, "Files & Media", "")], "k long, category string, body string")
    domain = F.regexp_extract("body", "//([^/]+)", 1)
    return A.in_schema(rows, artifact_id=F.concat(F.lit("a"), "k"), category=F.col("category"), body=F.col("body"), attributes=F.to_json(F.struct(domain.alias("domain"))), timestamp=F.lit(T0), timestamp_end=F.when(F.col("k") == 1002, F.lit(T0 + 5_000_000)))


def test_tiles_show_their_first_labels(spark):
    got = collections.defaultdict(dict)
    for r in dashboard.tiles(everything(spark), offset_minutes=-60).collect():
        got[r.tile][r.label] = r.n
    assert len(got["domains"]) == 14 and set(got["domains"].values()) == {20} and "h4.org" not in got["domains"] and "h9.org" not in got["domains"]
    assert got["accounts"] == {"account": 1} and "ssids" not in got and got["call_durations"] == {"<10s": 1} and got["media"] == {"File": 1} and got["media_located"] == {"not located": 1}
    assert got["weekday_hour"] == {"0 23": 404} and got["web_subtypes"] == {"Visit": 400} and got["day_category"]["2023-12-31 Web"] == 400
    assert dashboard.tiles(everything(spark).limit(0)).count() == 0


def test_next_steps_in_order(spark):
    facts = spark.createDataFrame([("a", "no calls", True, 5, "mtp", 20.0, 3, 2, 0, 1, 2, 0, 0, 0), ("b", None, None, None, None, None, None, None, None, None, None, None, None, None), ("c", "", False, 0, "MTP", 90.0, 0, 1, 1, 0, 1, 3, 4, 1)], "case string, gap string, vivo boolean, messages int, method string, coverage_pct double, folders_missing int, backups_tried int, backups_opened int, encrypted int, vaults int, owners int, findings int, critical int")
    got = collections.defaultdict(list)
    for r in sorted(dashboard.next_steps(facts, "case").collect(), key=lambda r: (r.case, r.rank)):
        got[r.case].append((r.step, r.severity))
    assert got["a"] == [("close the gap in communications", "high"), ("review fallback sources", "medium"), ("low decode coverage", "medium"), ("copy is incomplete", "high"), ("backup needs its key", "high"), ("review signs of hiding", "high"), ("run the rules", "low"), ("content of encrypted stores is missing", "critical")]
    assert got["b"] == [("run the rules", "low")]
    assert got["c"] == [("acquire again with debugging", "high"), ("decode opened backups", "medium"), ("review signs of hiding", "medium"), ("review grave findings", "critical")]


def test_triage_of_an_exhibit_of_nothing(spark):
    files = spark.createDataFrame([("x", "msgstore.db.crypt15", ""), ("x", "a.db", "key required"), ("x", "b.db", "fine")], "exhibit string, path string, notes string")
    got = {(r.exhibit, r.alert): (r.level, r.n) for r in dashboard.triage(dashboard.case_summary(everything(spark).limit(0)), files).collect()}
    assert got == {("x", "encrypted stores"): ("warn", 2), ("x", "nothing decoded"): ("warn", 0)}


def test_call_seconds_of_no_answer(spark):
    r = timeline.call_seconds(everything(spark)).first()
    assert (r.calls, r.answered, r.seconds, r.longest) == (1, 1, 5, 5)


def of(found):
    return {(r.rule_id, r.subject): (r.n, r.severity) for r in found.collect()}


def test_findings_of_pictures_names_and_sets(spark):
    make = spark.createDataFrame
    images = make([("i1", "E1", "d1", 1), ("i2", "E2", "d2", 1), ("i3", "E1", "d3", 5), ("i4", "E1", "d4", 6), ("i5", "E1", "d5", None)], "id string, exhibit string, digest string, hash long")
    clusters = make([("i1", "i1"), ("i2", "i1"), ("i3", "i3"), ("i4", "i3")], "node string, root string")
    assert of(findings.media_findings(images, clusters)) == {
        ("media.re_encoded_duplicates", "i1"): (2, "high"), ("media.re_encoded_duplicates", "i3"): (2, "medium"), ("media.cross_exhibit_images", "i1"): (2, "high"), ("media.perceptual_unavailable", "images"): (1, "info"),
    }
    people = make([("E1", "1", "Johnathan Smith"), ("E2", "2", "Jonathan Smith"), ("E1", "3", "Jonathan Smyth"), ("E2", "9", "Someone Else")], "exhibit string, key string, name string")
    assert set(of(findings.name_findings(people))) == {("correlate.name_similarity", "1~2"), ("correlate.name_similarity", "2~3")}
    screened = make([(1, "known-bad", "s"), (2, "known-bad", "s"), (3, "unknown", None), (4, "known-good", "t")], "id long, verdict string, set_name string")
    assert of(findings.hashset_findings(screened)) == {("hashset.known_bad", "s"): (2, "critical"), ("hashset.known_good", "t"): (1, "info")}


def test_communities_without_the_owner(spark):
    rows = [(f"{g}{a}", f"{g}{b}", 5) for g in "xyz" for a, b in itertools.combinations(range(4), 2)] + [("x0", "y0", 1), ("y1", "z1", 1)]
    e = spark.createDataFrame(rows, "a string, b string, weight long")
    labels = graph.communities(e).select("node", "label")
    got = of(findings.community_findings(e, labels, "x0"))
    assert len(got) == 2 and set(got.values()) == {(4, "medium")}
    assert of(findings.community_findings(e, labels.withColumn("label", F.lit("one")), "x0")) == {}


def test_fallback_sources_and_rules_that_fail(spark):
    rows = spark.createDataFrame([("E1", "Messages", "dumpsys/sms.txt"), ("E1", "Calls", "x"), ("E2", "Messages", "a"), ("E2", "Calls", "call.vcf"), ("E2", "Contacts", "b")], "exhibit string, category string, path string")
    df = A.in_schema(rows, exhibit=F.col("exhibit"), category=F.col("category"), source_path=F.col("path"), artifact_id=F.col("path"))
    assert of(findings.findings(df, ["vivo.comms_fallback"])) == {("vivo.comms_fallback", "E1"): (1, "medium")}
    told = of(findings.findings(df.drop("latitude"), ["vivo.comms_fallback", "correlate.shared_locations"]))
    assert {k[0] for k in told} == {"vivo.comms_fallback", "engine.error.correlate.shared_locations"}


def brute_betweenness(edges):
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    scores = dict.fromkeys(near, 0.0)
    for s in near:
        far, paths, line = {s: 0}, collections.Counter({s: 1}), [s]
        for v in line:
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    line.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
        share = collections.Counter()
        for w in reversed(line):
            for v in near[w]:
                if far[v] == far[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                scores[w] += share[w]
    n = len(near)
    return {k: v / ((n - 1) * (n - 2)) for k, v in scores.items()}


@pytest.mark.parametrize("sources", [3, 1_024])
def test_betweenness_by_batches(spark, sources):
    rnd = random.Random(10)
    edges = {tuple(sorted(rnd.sample(range(14), 2))) for _ in range(20)}
    df = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", 1) for a, b in edges], "a string, b string, weight long")
    want = brute_betweenness([(f"n{a:02}", f"n{b:02}") for a, b in edges])
    assert {r.node: r.betweenness for r in graph.betweenness(df, sources=sources).collect()} == pytest.approx(want, abs=1e-5)

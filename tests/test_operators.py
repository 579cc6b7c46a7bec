import collections
import difflib
import hashlib
import math
import os
import random
import xml.etree.ElementTree

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import checks, geo, keys, text, timex
from tidemark.operators import correlate, digests, entities, findings, fusion, graph, joins, places, search, threads, timeline
from tidemark.plans import catalog
from tidemark.plans import predicates as P
from tidemark.sources import artifacts as A
from tidemark.sources import exports
from tidemark.streaming import windows

MIN = 60_000_000
T0 = 1_704_067_200_000_000


def arts(spark, rows):
    """rows of (id, exhibit, category, minutes, direction, app, party) and more by name."""
    base = dict(subtype="x", timestamp_end=None, body="b", recovery="allocated", latitude=None, longitude=None, confidence=1.0, attributes="{}", source_path="", source_table="", source_row="0", blob_sha256="")
    made = []
    for r in rows:
        names = ("artifact_id", "exhibit", "category", "timestamp", "direction", "app", "party")
        row = base | dict(zip(names, r[:7], strict=True)) | (r[7] if len(r) > 7 else {})
        row["timestamp"] = None if row["timestamp"] is None else T0 + int(row["timestamp"] * MIN)
        made.append(tuple(row[c] for c in A.COLUMNS))
    schema = ", ".join(f"{c} " + {"timestamp": "long", "timestamp_end": "long", "latitude": "double", "longitude": "double", "confidence": "double"}.get(c, "string") for c in A.COLUMNS)
    return spark.createDataFrame(made, schema)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_keys(spark):
    n = F.lit("+91 98200-12345")
    assert one(spark, keys.party_key(n), keys.party_key(F.lit(" "), F.lit("Bob ")), keys.party_key(F.lit("A@B.c/x"))) == ("9820012345", "bob", "a@b.c")
    assert one(spark, keys.correlation_key(F.lit("919820012345@s.whatsapp.net")), keys.party_key(F.lit("919820012345@s.whatsapp.net"))) == (
        "9820012345", "919820012345@s.whatsapp.net")
    assert one(spark, keys.graph_key(F.lit("919820012345@c.us"), F.lit(False)), keys.graph_key(n, F.lit(True))) == ("9820012345", "__owner__")
    assert one(spark, keys.same_owner(F.lit("+1 982001234567"), F.lit("0982001234567"))) == (True,)


def test_time(spark):
    want = 1_700_000_000_000_000
    got = one(
        spark, timex.guess(F.lit(1_700_000_000)), timex.guess(F.lit(1_700_000_000_000)), timex.guess(F.lit(13_344_473_600_000_000), "last_visit_time"),
        timex.guess(F.lit(721_692_800), "zdate"), timex.guess(F.lit(0)), timex.from_epoch(F.lit(133_444_736_000_000_000), "filetime"),
    )
    assert got == (want, want, want, want, None, want)
    assert timex.span("2024-01-01..2024-01-02", 0) == (T0, T0 + 2 * timex.DAY_US - 1)
    assert timex.span("7d", T0) == (T0 - 7 * timex.DAY_US, T0) and timex.span("all", T0) == (None, None)
    with pytest.raises(ValueError):
        timex.span("soon", 0)


def test_geo(spark):
    a, b = F.lit(19.0), F.lit(72.0)
    zero, near, far = one(spark, geo.haversine(a, b, a, b), geo.haversine(a, b, F.lit(19.001), b), geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert zero == 0 and abs(near - 111.19) < 0.1 and abs(far - 20_015_087) < 1
    assert one(spark, geo.plausible(F.lit(0.0), F.lit(0.0)), geo.plausible(F.lit(91.0), F.lit(0.0)), geo.plausible(a, b)) == (False, False, True)


def test_checks(spark):
    ok = ("4111 1111 1111 1111", "490154203237518", "GB82 WEST 1234 5698 7654 32", "10.0.0.255")
    bad = ("4111 1111 1111 1112", "490154203237519", "GB83 WEST 1234 5698 7654 32", "10.0.0.256")
    tests = (checks.card, checks.imei, checks.iban, checks.ipv4)
    assert one(spark, *(t(F.lit(v)) for t, v in zip(tests, ok, strict=True))) == (True,) * 4
    assert one(spark, *(t(F.lit(v)) for t, v in zip(tests, bad, strict=True))) == (False,) * 4


def test_text_and_predicates(spark):
    assert one(spark, text.summary(F.lit("  a \n b ")), text.summary(F.lit(""), F.lit("f")), F.length(text.summary(F.lit("x" * 300)))) == ("a b", "f", 120)
    df = arts(spark, [("1", "A", "Messages", 0, "incoming", "App", "9820012345", {"body": "Un CAFÉ, please"}), ("2", "A", "Calls", 5, "outgoing", "a_p", "bob", {"recovery": "wal", "confidence": 0.8})])
    ids = lambda c: [r.artifact_id for r in df.filter(c).orderBy("artifact_id").collect()]
    assert ids(P.word("body", "cafe")) == ["1"] and ids(P.phrase("body", "un cafe")) == ["1"] and ids(P.phrase("body", "un please")) == []
    assert ids(P.category("nonsense")) == [] and ids(P.deleted()) == ["2"] and ids(P.like("app", "A_P")) == ["2"]
    assert ids(P.party("+91 9820012345")) == ["1"] and ids(P.confidence("=", 0.8)) == ["1", "2"] and ids(P.confidence(">", 0.8)) == ["1"]
    assert ids(P.after("2024-01-01") & P.before("2024-01-01")) == ["1", "2"]
    with pytest.raises(ValueError):
        P.direction("sideways")
    tags = spark.createDataFrame([("2", "key")], "artifact_id string, name string")
    assert P.tagged(df, tags, "key").count() == 1 and P.tagged(df, tags, "other").count() == 0


def test_range_join_and_asof_agree_with_brute_force(spark):
    rnd = random.Random(1)
    left = [(i, rnd.randrange(3), rnd.randrange(2000)) for i in range(80)]
    right = [(i, rnd.randrange(3), rnd.randrange(2000)) for i in range(80)]
    a, b = spark.createDataFrame(left, "i int, k int, t long"), spark.createDataFrame(right, "j int, q int, u long")
    got = {(r.i, r.j) for r in joins.range_join(a, b, "t", "u", 50, [("k", "q")]).collect()}
    assert got == {(x[0], y[0]) for x in left for y in right if x[1] == y[1] and abs(x[2] - y[2]) <= 50}
    r2 = b.select("j", F.col("q").alias("k"), F.col("u").alias("t"))
    back = {r.i: r.near and r.near.time for r in joins.asof(a, r2, ["k"], "t", F.col("j"), 50).collect()}
    assert back == {x[0]: max((y[2] for y in right if y[1] == x[1] and 0 <= x[2] - y[2] <= 50), default=None) for x in left}
    ahead = {r.i: r.near and r.near.time for r in joins.asof(a, r2, ["k"], "t", F.col("j"), 50, backward=False).collect()}
    assert ahead == {x[0]: min((y[2] for y in right if y[1] == x[1] and 0 <= y[2] - x[2] <= 50), default=None) for x in left}


def test_burst_boundary_and_gaps(spark):
    df = arts(spark, [(str(i), "A", "Messages", m, "incoming", "a", "p") for i, m in enumerate([0, 45, 90, 136, 1000])])
    assert [(r.n, r.start - T0) for r in timeline.bursts(df).collect()] == [(3, 0)]
    assert [r.gap_us // MIN for r in timeline.gaps(df).collect()] == [864]


def test_threads(spark):
    df = arts(spark, [("0", "A", "Messages", 0, "incoming", "a", "p"), ("1", "A", "Messages", 1, "outgoing", "a", "p", {"recovery": "wal"}), ("2", "A", "Messages", 500, "incoming", "a", "p"), ("3", "A", "Messages", 503, "outgoing", "a", "p"), ("4", "A", "Messages", None, "outgoing", "a", "p")])
    r = threads.metrics(df).first()
    assert (r.turns, r.n_in, r.n_out, r.embedded_deletion, r.median_reply_us, r.silence_us, r.begun) == (4, 2, 2, True, 3.0 * MIN, 499 * MIN, "incoming")
    assert [x.pos for x in threads.turns(df).orderBy("artifact_id").collect()] == [0, 1, 2, 3, 4]


def test_colocation(spark):
    here, there = {"latitude": 19.0, "longitude": 72.0, "subtype": "fix"}, {"latitude": 19.05, "longitude": 72.0, "subtype": "fix"}
    near = {"latitude": 19.0008, "longitude": 72.0, "subtype": "fix"}
    rows = [(f"a{i}", "A", "Places", i, "unknown", "m", "p", here) for i in range(4)] + [(f"b{i}", "B", "Places", i, "unknown", "m", "p", near) for i in range(4)]
    rows += [("c", "B", "Places", 1, "unknown", "m", "p", there), ("d", "B", "Messages", 1, "incoming", "m", "p", near), ("e", "B", "Places", 300, "unknown", "m", "p", near), ("f", "A", "Places", 301, "unknown", "m", "p", here)]
    hits = places.meetings(places.presence(arts(spark, rows)))
    assert hits.count() == 17 and hits.filter("artifact_id_b = 'c'").count() == 0
    met = places.encounters(hits).orderBy("start").collect()
    assert [r.hits for r in met] == [16, 1] and met[0].confidence > met[1].confidence
    assert places.pair_summary(places.encounters(hits)).first().kind == "single"


def test_fusion(spark):
    rows = [("m1", "A", "Messages", 10, "outgoing", "x", "p"), ("m2", "A", "Messages", 100, "outgoing", "x", "p"), ("m3", "B", "Messages", 10, "outgoing", "x", "p"), ("m4", "A", "Calls", 300, "outgoing", "x", "p")]
    rows += [("u1", "A", "User activity log", 11, "unknown", "x", "p"), ("u2", "A", "User activity log", 110, "unknown", "x", "p")]
    df = arts(spark, rows)
    act, log = fusion.acts(df), fusion.telemetry(df)
    got = {r.artifact_id: r.verdict for r in fusion.verdicts(act, fusion.usage(act, log), log).collect()}
    assert got == {"m1": "attributed", "m2": "probable", "m3": "unknown", "m4": "unattributed"}
    assert fusion.usage(act, log, pool=True).filter("artifact_id = 'm3'").count() == 1


def test_graph(spark):
    pairs = [(x, y) for g in ("abc", "de") for x in g for y in g if x < y] + [("c", "d")]
    df = spark.createDataFrame([p for p in pairs for _ in range(5 if p != ("c", "d") else 1)] + [("x", "y"), ("y", "x"), ("z", "z")], "s string, t string")
    e = graph.edges(df, "s", "t")
    assert {(r.a, r.b): r.weight for r in e.collect()}[("x", "y")] == 2
    assert {r.node: r.degree for r in graph.degrees(e).collect()}["c"] == 3
    assert {r.node: r.root for r in graph.components(e).collect()} == {**dict.fromkeys("abcde", "a"), "x": "x", "y": "x"}
    label = {r.node: r.label for r in graph.communities(e).collect()}
    assert label["a"] == label["b"] == label["c"] != label["d"] == label["e"]
    assert graph.modularity(e, spark.createDataFrame(list(label.items()), "node string, label string")).first().q > 0.3


def test_betweenness(spark):
    path = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1), ("x", "y", 1)], "a string, b string, weight long")
    got = {r.node: r.betweenness for r in graph.betweenness(path).collect()}
    assert got == {n: round(v / 15, 5) for n, v in {"a": 0, "b": 3, "c": 4, "d": 3, "e": 0, "x": 0, "y": 0}.items()}
    square = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "d", 1)], "a string, b string, weight long")
    assert {r.betweenness for r in graph.betweenness(square).collect()} == {round(0.5 / 3, 5)}


def test_community_report(spark):
    e = spark.createDataFrame([("a", "b", 3), ("b", "c", 1)], "a string, b string, weight long")
    labels = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "node string, label string")
    got = {r.label: (r.size, r.weight, r.inside, r.cohesion) for r in graph.community_report(e, labels).collect()}
    assert got == {"a": (2, 4, 3, 0.75), "c": (1, 1, 0, 0.0)}


def test_correlation(spark):
    df = arts(spark, [("1", "A", "Messages", 0, "incoming", "a", "p"), ("2", "B", "Messages", 0, "incoming", "a", "p", {"recovery": "wal"}), ("3", "B", "Messages", 0, "incoming", "a", "q")])
    assert [tuple(r) for r in correlate.shared(df, "party").collect()] == [("p", 2, 2)]
    assert [r.party for r in correlate.asymmetric_deletion(df).collect()] == ["p"]
    people = spark.createDataFrame([("1", "Ramesh Kumar"), ("2", "Ramesh Kumarr"), ("3", "Sunita Rao"), ("4", "RAMESH KUMAR")], "key string, name string")
    assert {(r.key_a, r.key_b) for r in correlate.similar_names(people).collect()} == {("1", "2"), ("1", "4"), ("2", "4")}


def test_similar_names_miss_none(spark):
    rnd = random.Random(9)
    names = ["johnathan smith", "jqhnathan smxth", "aaaaaa", "aaaaaaa", "ab", "a"]
    for _ in range(25):
        base = "".join(rnd.choice("abcdeort ") for _ in range(rnd.randint(3, 24))).strip() or "x"
        names.append(base)
        for _ in range(4):
            x = list(base)
            for _ in range(rnd.randint(1, 2)):
                x[rnd.randrange(len(x))] = rnd.choice("qxjz")
            names.append("".join(x))
    people = [(f"{i:03}", x) for i, x in enumerate(names)]
    want = {(a, b) for a, x in people for b, y in people if a < b and difflib.SequenceMatcher(None, x, y).ratio() >= 0.86}
    got = {(r.key_a, r.key_b) for r in correlate.similar_names(spark.createDataFrame(people, "key string, name string")).collect()}
    assert got == want and ("000", "001") in got


def test_entities(spark):
    df = spark.createDataFrame([(1, "Mail Bob@Ex.com, card 4111 1111 1111 1111, 10.0.0.1 and 999.1.1.1"), (2, "bob@ex.com 4111-1111-1111-1112"), (3, None)], "i int, t string")
    found = entities.mentions(df, "i", "t")
    got = {(r.kind, r.value): r.rows for r in entities.aggregate(found, "i").collect()}
    assert got[("email", "bob@ex.com")] == 2 and got[("card", "4111111111111111")] == 1 and got[("ipv4", "10.0.0.1")] == 1
    assert not [k for k in got if k[0] == "card" and k[1].endswith("2")] and ("ipv4", "999.1.1.1") not in got


def test_entities_claim_spans_and_weigh_contacts(spark):
    rows = [
        (1, "pay DE89 3704 0044 0532 0130 00 or 4111 1111 1111 1111 now"), (2, "call +91 98765 43210, call 98765 43210 or 020 7946 0958"),
        (3, "1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2 and 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3 bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"),
        (4, "ravi@okbank @handle_x KA 01 AB 1234 12.9716, 77.5946 12.97160, 77.59460 1Z999AA10123456784 http://www.w3.org/x http://a.b/c"),
    ]
    found = entities.mentions(spark.createDataFrame(rows, "i int, t string"), "i", "t")
    kinds = {(r.kind, r.value) for r in found.collect()}
    assert {k for k in kinds if k[0] == "phone"} == {("phone", "9876543210"), ("phone", "2079460958")} - {("phone", "2079460958")} | {k for k in kinds if k[1].endswith("79460958")}
    assert ("iban", "de89 3704 0044 0532 0130 00") in kinds and ("card", "4111111111111111") in kinds
    assert {v for k, v in kinds if k == "btc"} == {"1bvbmseystwetqtfn5au4m4gfg7xjanvn2", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"}
    assert {("upi", "ravi@okbank"), ("handle", "@handle_x"), ("vehicle_in", "KA01AB1234"), ("coords", "12.97160, 77.59460".lower()), ("tracking", "1z999aa10123456784"), ("url", "http://a.b/c")} <= kinds
    assert ("url", "http://www.w3.org/x") not in kinds
    own, known = (spark.createDataFrame([(v,)], "value string") for v in ("2079460958", "9876543210"))
    weighed = {r.value: (r.n, r.significance) for r in entities.aggregate(found, "i", owners=own, contacts=known).filter("kind = 'phone'").collect()}
    assert weighed["9876543210"] == (2, round(0.7 * (1 + math.log(3)), 6)) and "2079460958" not in weighed


def brute_root(leaves):
    level = sorted(set(leaves))
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_merkle_root(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    df = spark.createDataFrame([(x,) for x in leaves * 2], "h string")
    assert digests.merkle_root(df, "h").first().root == brute_root(leaves)


def test_hash_chain(spark):
    rows, prev = [], "0" * 64
    for i in range(20):
        own = hashlib.sha256(f"{prev}|c{i}".encode()).hexdigest()
        rows.append((i, prev, own, f"c{i}"))
        prev = own
    chain = spark.createDataFrame(rows, "seq int, prev string, own string, content string")
    check = lambda df: {r.seq: r.broken for r in digests.verify_chain(df, "seq", "prev", "own", F.col("content")).collect()}
    assert check(chain) == {}
    assert check(chain.withColumn("content", F.when(F.col("seq") == 5, "z").otherwise(F.col("content")))) == {5: "own digest"}
    assert check(chain.filter("seq <> 9")) == {10: "gap"}


def test_near_hashes(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(20)]
    prints = base + [b ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (7 << rnd.randrange(60)) for b in base] + base[:3]
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)], "i long, hash long")
    got = {(r.id_a, r.id_b) for r in digests.near_hashes(df, "i").collect()}
    same = {(a, b) for a in range(len(prints)) for b in range(a + 1, len(prints)) if 0 < (prints[a] ^ prints[b]).bit_count() <= 6}
    assert {p for p in got if prints[p[0]] != prints[p[1]]} == same and (0, 40) in got


def test_findings_have_caveats_and_order(spark):
    df = arts(spark, [(str(i), "AB"[i % 2], "Messages", i * 10, "incoming", "a", "p", {"recovery": "wal"}) for i in range(12)])
    out = findings.findings(df).collect()
    assert out and all(r.caveat and 0 <= r.score <= 4 for r in out)
    assert [r.score for r in out] == sorted((r.score for r in out), reverse=True)
    assert "deleted.entire_thread" in {r.rule_id for r in out}


def test_sources(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "b.xml").write_text('<smses><sms address="+91 9820012345" date="1700000000000" type="2" body="hi" contact_name="Bob"/></smses>')
    r = A.read_folder(spark, str(tmp_path), "*.jpg").first()
    assert r.mime == "image/png" and r.mismatch and r.sha256 == hashlib.sha256(b"\x89PNG\r\n\x1a\n0000").hexdigest()
    m = A.read_message_xml(spark, str(tmp_path / "b.xml")).first()
    assert (m.party, m.direction, m.timestamp, m.body) == ("9820012345", "outgoing", 1_700_000_000_000_000, "hi")
    A.write_artifacts(arts(spark, [("1", "A", "Messages", 0, "incoming", "a", "p")]), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("exhibit = 'A'").count() == 1
    assert one(spark, A.coerce_category(F.lit("messages")), A.coerce_category(F.lit("?"))) == ("Messages", "Other")


def test_streaming(spark, tmp_path):
    df = arts(spark, [(str(i), "A", "Messages", m, "incoming", "a", "p") for i, m in enumerate([0, 10, 20, 600, 2000])])
    df.write.parquet(str(tmp_path / "in"))
    stream = windows.dated(windows.read_stream(spark, str(tmp_path / "in"), df.schema))
    q = windows.session_bursts(windows.deduplicated(stream)).writeStream.outputMode("append").format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.party, r.n) for r in spark.sql("select * from found").collect()] == [("p", 3)]


def test_results_do_not_hang_on_partitions(spark):
    df = arts(spark, [(str(i), "AB"[i % 2], "Messages", (i * 37) % 500, ("incoming", "outgoing")[i % 3 % 2], "a", str(i % 5)) for i in range(80)])
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(collections.Counter(map(str, threads.metrics(df).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


@pytest.mark.parametrize("lat,lon", [(0.0, 10.0), (66.0, 25.0), (80.0, -30.0), (-66.0, 179.9995), (89.9995, 0.0), (10.0, -179.9995)])
def test_meetings_at_all_latitudes(spark, lat, lon):
    rnd = random.Random(int(lat * 7 + lon))
    points = []
    for k in range(60):
        north, east = lat + rnd.uniform(-0.008, 0.008), lon + rnd.uniform(-0.012, 0.012) / max(0.02, math.cos(math.radians(lat)))
        points.append((f"p{k}", f"E{k % 2}", k % 7 * 600_000_000, max(-90.0, min(90.0, north)), (east + 180) % 360 - 180, 1.0))
    df = spark.createDataFrame(points, "artifact_id string, exhibit string, timestamp long, latitude double, longitude double, weight double")

    def metres(a, b):
        la, lb = math.radians(a[3]), math.radians(b[3])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(min(1, math.sqrt(h)))

    want = {(a[0], b[0]) for a in points for b in points if a[1] < b[1] and abs(a[2] - b[2]) <= 900_000_000 and metres(a, b) <= 500}
    found = [(r.artifact_id_a, r.artifact_id_b) for r in places.meetings(df).collect()]
    assert set(found) == want and len(found) == len(want) and want


def test_asof_takes_the_smallest_of_tied_rows(spark):
    left = spark.createDataFrame([("k", 1_000), ("k", 5_000), ("z", 1)], "key string, t long")
    right = spark.createDataFrame([("k", 900, v) for v in "edcba"] + [("k", 1_100, v) for v in "hgf"] + [("k", 3_000, "far")], "key string, t long, v string")
    for parts in (1, 3, 5):
        back = {(r.key, r.t): r.near for r in joins.asof(left, right.repartition(parts), ["key"], "t", F.col("v"), 500).collect()}
        ahead = {(r.key, r.t): r.near for r in joins.asof(left, right.repartition(parts), ["key"], "t", F.col("v"), 500, backward=False).collect()}
        assert back[("k", 1_000)].value == "a" and ahead[("k", 1_000)].value == "f" and back[("k", 5_000)] is None and ahead[("z", 1)] is None


def test_categories_by_member_names_and_time(spark):
    df = arts(spark, [("a", "E1", "Messages", 0, "incoming", "x", "p"), ("b", "E1", "Files & Media", 1440, "incoming", "x", "p", {"blob_sha256": "ab"})])
    ids = lambda c: [r.artifact_id for r in df.filter(c).collect()]
    assert ids(P.category("message")) == ids(P.category("MESSAGES")) == ["a"] and ids(P.category("file")) == ["b"] and ids(P.category("nothing")) == []
    assert ids(P.has("media")) == ["b"] and ids(P.timestamp(">", "2024-01-01")) == ["b"] and ids(P.timestamp("<", "2024-01-02")) == ["a"] and ids(P.timestamp(">=", "2024-01-02")) == ["b"]
    with pytest.raises(ValueError):
        P.confidence("~", 1)
    with pytest.raises(ValueError):
        search.page(df, "body")


def test_folding_beyond_latin_1(spark):
    assert one(spark, text.fold(F.lit("Łódź Příliš ŐRÜLT e\u0301té Ñandú"))) == ("łodz prilis orult ete nandu",)


def test_call_xml_vcards_and_exports(spark, tmp_path):
    (tmp_path / "calls.xml").write_text('<calls><call number="+91 98200 12345" duration="60" date="1700000000000" type="3" contact_name="Bob"/></calls>')
    got = A.read_call_xml(spark, str(tmp_path / "calls.xml")).first()
    assert (got.direction, got.party, got.timestamp, got.timestamp_end) == ("missed", "9820012345", 1_700_000_000_000_000, 1_700_000_060_000_000)
    card = "BEGIN:VCARD\r\nVERSION:3.0\r\nFN:Ann\r\n  Lee\r\nitem1.TEL;TYPE=CELL:+91 98200 54321\r\nEMAIL:Ann@x.org\r\nEND:VCARD\r\nBEGIN:VCARD\nN:Solo\nEND:VCARD\n"
    (tmp_path / "c.vcf").write_text(card)
    rows = {(r.name, r.party) for r in A.read_vcards(spark, str(tmp_path / "c.vcf")).collect()}
    assert rows == {("Ann Lee", "9820054321"), ("Ann Lee", "ann@x.org"), ("Solo", "solo")}
    df = arts(spark, [("a", "E1", "Messages", 0, "incoming", "x", "p"), ("b", "E1", "Calls", 1, "outgoing", "y", 'q "é, 1'), ("c", "E2", "Web", None, "local", "", "")])
    for kind in ("csv", "json", "parquet", "xml"):
        A.export(df, str(tmp_path / kind), kind)
        reader = {"csv": spark.read.option("header", "true").option("escape", "\\"), "xml": spark.read.option("rowTag", "artifact")}.get(kind, spark.read)
        back = reader.format(kind).load(str(tmp_path / kind))
        assert back.count() == 3 and {r.artifact_id for r in back.collect()} == {"a", "b", "c"}
    graph.graphml(graph.edges(spark.createDataFrame([("a<", "b"), ("b", "a<"), ("b", "c")], "x string, y string"), "x", "y"), str(tmp_path / "g"))
    text_of = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    root = xml.etree.ElementTree.fromstring(text_of)
    assert len(root[1].findall("{*}node")) == 3 and sorted(x[0].text for x in root[1].findall("{*}edge")) == ["1", "2"]


def test_tags_seals_and_clusters(spark, tmp_path):
    first = spark.createDataFrame([("a", "seen", 1), ("a", "seen", 5), ("b", "hot", 2)], "artifact_id string, name string, created_at long")
    A.append_tags(first, str(tmp_path / "tags"))
    A.append_tags(first.filter("name = 'hot'").withColumn("created_at", F.lit(9).cast("long")), str(tmp_path / "tags"))
    assert {(r.artifact_id, r.name, r.created_at) for r in A.latest_tags(spark.read.parquet(str(tmp_path / "tags"))).collect()} == {("a", "seen", 5), ("b", "hot", 9)}
    files = spark.createDataFrame([("f1", "aa"), ("f2", "bb"), ("f3", "cc")], "f string, h string")
    sealed = digests.manifest(files, "f", "h")
    assert sealed.select("root").distinct().count() == 1
    now = spark.createDataFrame([("f1", "aa"), ("f2", "xx"), ("f4", "dd")], "f string, h string")
    assert {(r.f, r.broken) for r in digests.broken_seal(now, sealed, "f", "h").collect()} == {("f2", "changed"), ("f3", "missing"), ("f4", "added")}
    met = spark.createDataFrame([("x", "y", "near"), ("y", "z", "identical"), ("z", "q", "similar")], "id_a string, id_b string, verdict string")
    assert {(r.node, r.root) for r in digests.clusters(met).collect()} == {("x", "x"), ("y", "x"), ("z", "x")}


def test_near_hashes_miss_none(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(40)]
    every = base + [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 8))) for b in base for _ in range(3)]
    signed = [(k, h - (1 << 64) if h >> 63 else h) for k, h in enumerate(every)]
    got = {(r.id_a, r.id_b): r.distance for r in digests.near_hashes(spark.createDataFrame(signed, "i long, hash long"), "i").filter("distance > 0").collect()}
    want = {(a, b): (x ^ y).bit_count() for a, x in enumerate(every) for b, y in enumerate(every) if a < b and 0 < (x ^ y).bit_count() <= 6}
    assert got == want


def test_one_way_threads_are_linear(spark):
    """Plans of replies read each thread once: no frame to the end of the thread for each row."""
    n = 30_000
    df = spark.range(n).select(
        F.col("id").cast("string").alias("artifact_id"), F.lit("p").alias("party"), F.lit("a").alias("app"), F.lit("e").alias("exhibit"), F.col("id").alias("timestamp"),
        F.when(F.col("id") == n - 1, "outgoing").otherwise("incoming").alias("direction"),
    )
    got = threads.replies(df).agg(F.count("reply_us").alias("n"), F.max("reply_us").alias("most"), F.min("reply_us").alias("least")).first()
    assert (got.n, got.most, got.least) == (n - 1, n - 1, 1)


def test_hash_sets_and_noise(spark, tmp_path):
    a, b, c = "a" * 32, "b" * 40, "C" * 64
    (tmp_path / "plain.txt").write_text(f"# set\n{a}  one file\n{c}\nnot a digest\n")
    (tmp_path / "nsrl.csv").write_text(f'"SHA-1","MD5","CRC32","FileName"\n"{b}","{a}","00","x.dll"\n')
    (tmp_path / "set.json").write_text('{"kind": "known-bad", "entries": [{"sha256": "%s", "label": "bad"}]}' % c)
    got = lambda f: {(r.digest, r.algorithm, r.label, r.kind) for r in digests.read_hash_set(spark, str(tmp_path / f), "known-good", "s").collect()}
    assert got("plain.txt") == {(a, "md5", "one file", "known-good"), (c.lower(), "sha256", "", "known-good")}
    assert got("nsrl.csv") == {(b, "sha1", "x.dll", "known-good"), (a, "md5", "x.dll", "known-good")}
    assert got("set.json") == {(c.lower(), "sha256", "bad", "known-bad")}
    tree = tmp_path / "tree" / "code_cache"
    tree.mkdir(parents=True)
    for f in (tree / "x.bin", tmp_path / "tree" / "Thumbs.db", tmp_path / "tree" / "a.tmp", tmp_path / "tree" / "kept.txt"):
        f.write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in A.read_folder(spark, str(tmp_path / "tree")).collect()] == ["kept.txt"]


def test_entity_findings_and_telemetry_kinds(spark):
    df = arts(spark, [
        ("a", "E1", "Messages", 0, "incoming", "x", "p", {"body": "card 4111 1111 1111 1111", "attributes": '{"note": "490154203237518"}'}), ("b", "E1", "Calls", 0, "incoming", "x", "p"),
        ("c", "E1", "User activity log", 0, "unknown", "x", "p", {"subtype": "Lock state", "attributes": '{"value": "0"}'}),
        ("d", "E1", "User activity log", 0, "unknown", "x", "p", {"subtype": "App usage event", "attributes": '{"event": "service started"}'}),
        ("e", "E1", "User activity log", 0, "unknown", "x", "p", {"subtype": "Display", "attributes": '{"value": "false"}'}),
    ])
    assert {(r.rule_id, r.n, r.severity) for r in findings.entity_findings(df).collect()} == {("entity.card", 1, "high"), ("entity.imei", 1, "medium")}
    kinds = {r.artifact_id: (r.kind, r.in_use) for r in fusion.classified(df).collect()}
    assert kinds == {"a": ("", None), "b": ("", None), "c": ("lock", True), "d": ("usage", None), "e": ("screen", False)}


def test_tables_of_apps_become_artifacts(spark):
    raw = spark.createDataFrame([(1, "Ann", "com.x"), (2, "", None), (3, None, None)], "_id long, display_name string, account_type string")
    data = spark.createDataFrame([(1, 5, "+91 98200 12345"), (1, 6, "ann@x.org"), (2, 7, "Bob Ray"), (2, 5, "020 7946 0958"), (3, 9, "photo")], "raw_contact_id long, mimetype_id long, data1 string")
    kinds = spark.createDataFrame([(5, "vnd.android.cursor.item/phone_v2"), (6, "vnd.android.cursor.item/email_v2"), (7, "vnd.android.cursor.item/name"), (9, "vnd.android.cursor.item/photo")], "_id long, mimetype string")
    got = exports.android_contacts(raw, data, kinds, "E9")
    assert got.columns == list(A.COLUMNS)
    assert {(r.body, r.party, r.app, r.source_row) for r in got.collect()} == {("Ann", "9820012345", "com.x", 1), ("Bob Ray", "2079460958", "Android Contacts", 2)}
    items = spark.createDataFrame([(1, "https://a.b/c", 3), (2, "", 1), (3, "https://d.e/", 1)], "id long, url string, visit_count int")
    visits = spark.createDataFrame([(1, 721692800.0, "Old"), (1, 721692900.0, "New")], "history_item long, visit_time double, title string")
    web = {r.body: r.timestamp for r in exports.safari_history(items, visits).collect()}
    assert web == {"New": 1_700_000_100_000_000, "https://d.e/": None}
    message = spark.createDataFrame([(1, "hi", 7, 0, 721692800000000000), (2, None, None, 1, 721692801000000000)], "ROWID long, text string, handle_id long, is_from_me int, date long")
    handle = spark.createDataFrame([(7, "+919820012345"), (8, "me@x.org")], "ROWID long, id string")
    sms = exports.ios_messages(message, handle, spark.createDataFrame([(4, 1), (4, 2)], "chat_id long, message_id long"), spark.createDataFrame([(4, 7), (4, 8)], "chat_id long, handle_id long"))
    assert {(r.source_row, r.party, r.direction, r.body, r.timestamp) for r in sms.collect()} == {
        (1, "9820012345", "incoming", "hi", 1_700_000_000_000_000), (2, "9820012345", "outgoing", "", 1_700_000_001_000_000)}


def test_hamming_pairs_of_copies(spark, tmp_path):
    rnd = random.Random(4)
    base = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    near = [[-x if k in (3, 9) else x for k, x in enumerate(v)] for v in base[:4]]
    rows = [(i, v) for i, v in enumerate([*base[::-1], *near, *base[:3], *base[:3], *near[:1]])] + [(99, None), (98, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    os.symlink("/root/testdata/sf0.001/events.parquet", tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["hamming_pairs"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalog.SQL["hamming_pairs"]).fetchall()) and len(got) == 13 + 10  # all pairs of ids


def test_hamming_pairs_lists_all_pairs_of_copies(spark, tmp_path):
    rnd = random.Random(6)
    base, other = ([rnd.gauss(0, 1) for _ in range(64)] for _ in range(2))
    near = [-x if k == 5 else x for k, x in enumerate(base)]
    vectors = [base, near, base, other, base, near, base]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    os.symlink("/root/testdata/sf0.001/events.parquet", tmp_path / "events.parquet")
    want = sorted((a, b, int(vectors[a] != vectors[b])) for a in range(7) for b in range(a + 1, 7) if 3 not in (a, b))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, catalog.QUERIES["hamming_pairs"](spark, str(tmp_path)).collect())) == want
    assert sorted(con.execute(catalog.SQL["hamming_pairs"]).fetchall()) == want

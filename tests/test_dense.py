"""Steps whose work must not grow with the square of how dense the rows lie in time."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import digests, fusion, graph, order, places, tables
from tidemark.plans import catalog
from tidemark.sources import layouts

ACT = "artifact_id string, exhibit string, app string, timestamp long"


def joins_in(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def best_usage(acts, logs, pool, most=6):
    out = set()
    for i, ex, app, t in acts:
        met = []
        for j, ex2, app2, t2 in logs:
            away = abs(t - t2)
            if away <= fusion.WIDE_US and (pool or (ex is not None and ex == ex2)):
                same = None if app is None or app2 is None else app == app2
                met.append((away > fusion.NARROW_US, {True: 0, False: 1, None: 2}[same], away, j, same))
        out |= {(i, j, away, not wide, same, k + 1) for k, (wide, _, away, j, same) in enumerate(sorted(met, key=lambda m: m[:4])[:most])}
    return out


def test_usage_of_dense_acts_pairs_nothing(spark):
    r = random.Random(5)
    minute = 60_000_000
    pick = lambda: (r.choice(["E1", "E2", None]), r.choice(["a", "b", "c", None]), r.choice([r.randrange(60), r.randrange(0, 60, 5)]) * minute)
    acts, logs = [(f"m{k:03}", *pick()) for k in range(80)], [(f"u{k:03}", *pick()) for k in range(150)]
    a, b = spark.createDataFrame(acts, ACT), spark.createDataFrame(logs, ACT)
    for pool in (False, True):
        got = fusion.usage(a, b, pool=pool)
        assert joins_in(got) == 0
        rows = [tuple(x) for x in got.select("artifact_id", "usage_id", "away_us", "close", "same_app", "rank").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == best_usage(acts, logs, pool)


def test_encounters_in_slices_are_those_of_listed_meetings(spark):
    r = random.Random(7)
    minute = 60_000_000
    rows = [(f"p{k:03}", f"E{r.randrange(3)}", r.choice([r.randrange(-70, 200), r.randrange(-60, 200, 15)]) * minute + r.choice([0, 0, 1]), 19 + r.randrange(8) / 1000, r.choice([179.999, -179.999, 179.996]), 1.0 - k % 3 / 10) for k in range(160)]
    points = spark.createDataFrame(rows, "artifact_id string, exhibit string, timestamp long, latitude double, longitude double, weight double")
    want = places.encounters(places.meetings(points))
    told = lambda df: sorted(tuple(x) for x in df.select(sorted(want.columns)).collect())
    assert told(places.encounters_of(points)) == told(want) and want.agg({"hits": "max"}).first()[0] > 1
    pairs = lambda df: sorted(tuple(x) for x in df.collect())
    assert pairs(places.pair_summary_of(points)) == pairs(places.pair_summary(want))


@pytest.mark.parametrize("name", ["encounters", "pair_summary"])
def test_queries_of_encounters_list_no_meetings(spark, monkeypatch, name):
    want = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    monkeypatch.setattr(places, "meetings", None)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() == want


def test_components_make_their_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(f"n{k:02}", f"n{k + 1:02}", 1) for k in range(12)]
    e = spark.createDataFrame(rows, "a string, b string, weight long").mapInArrow(counted, "a string, b string, weight long")
    assert {r.root for r in graph.components(e).collect()} == {"n00"}
    assert made.value <= 2 * len(rows)  # one way and the other


def test_chains_of_logs_are_not_shuffled_or_stored_whole(spark, monkeypatch):
    r, rows, want, nth = random.Random(11), [], set(), 0
    for log, n in [("hot", 3 * 4_096 + 5), *((f"l{k}", r.randrange(1, 9)) for k in range(40))]:
        last, before = "", None
        for seq in range(r.choice([0, 1, 4_095]), n + 4_096):
            content, why, nth = f"{log}{seq}", None, nth + 1
            seal = hashlib.sha256(f"{last}|{content}".encode()).hexdigest()
            dropped = seq % 4_096 in (0, 4_095) and r.random() < 0.5 or r.random() < 0.01
            kept, seen = r.random() > 0.02, last if r.random() > 0.02 else "else"
            if seen != last:
                seal = hashlib.sha256(f"{seen}|{content}".encode()).hexdigest()
            if not dropped:
                rows.append((log, seq, seen, seal, content if kept else content + "!"))
                why = "own digest" if not kept else "gap" if before is not None and seq != before[0] + 1 else "previous digest" if before is not None and before[1] != seen else None
                before = (seq, seal)
            want |= {(log, seq, why)} if why else set()
            last = seal
            if log != "hot" and len(rows) > 12_000 and seq > n + 10:
                break
    stored, real = [], tables.checkpointed

    def watched(df, *by):
        kept = real(df, *by)
        stored.append((kept.count(), df._jdf.queryExecution().executedPlan().toString().count("Exchange ")))
        return kept

    monkeypatch.setattr(order, "checkpointed", watched)
    monkeypatch.setattr(digests, "checkpointed", watched, raising=False)
    df = spark.createDataFrame(rows, "log string, seq int, previous string, own string, content string")
    got = [tuple(x) for x in digests.verify_chains(df, "log", "seq", "previous", "own", F.col("content")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {w for *_, w in want} == {"own digest", "gap", "previous digest"}
    assert sum(n for n, _ in stored) < len(rows) / 4
    stored.clear()
    held = df.groupBy("log").agg(F.collect_list(F.struct("seq", "previous", "own", "content")).alias("all")).select("log", F.inline("all"))
    assert {tuple(x) for x in digests.verify_chains(held, "log", "seq", "previous", "own", F.col("content")).collect()} == want
    assert [n for _, n in stored] == [1]  # that of the groups


def test_rows_of_apps_are_not_shuffled_once_a_hop(spark, monkeypatch):
    r = random.Random(13)
    some = lambda *xs: r.choice([None, *xs])
    message = [(k, some(*range(12)), some(*range(30)), r.choice([1.0, 0.95])) for k in range(200)]
    chat = [(some(*range(10)), some(*map(str, range(20))), some("s", "t"), r.choice([1.0, 0.9, 0.5])) for _ in range(25)]
    jid = [(some(*range(20)), some("x@c.us", "y@c.us", ""), r.choice([1.0, 0.8])) for _ in range(40)]
    tables_of = {
        "message": spark.createDataFrame(message, "_id long, chat_row_id long, sender_jid_row_id long, confidence double"),
        "chat": spark.createDataFrame(chat, "_id long, jid_row_id string, subject string, confidence double"), "jid": spark.createDataFrame(jid, "_id long, raw_string string, confidence double"),
    }

    def partner(rows, key):
        found = [x for x in rows if key is not None and x[0] is not None and str(x[0]) == str(key)]
        low = lambda v: (v is not None, v or "")
        return max(found, key=lambda x: (x[-1], *map(low, x[1:-1])), default=(None,) * (len(rows[0]) - 1) + (1.0,))

    jids, want = [(k, v or None, c) for k, v, c in jid], set()
    for k, c, s, sure in message:
        at, by = partner(chat, c), partner(jids, s)
        of = partner(jids, at[1])
        want.add((k, at[1], at[2], of[1], by[1], min(sure, at[3], of[2], by[2])))
    told = lambda: layouts.joined(layouts.MESSENGER[0], tables_of).select("row", "chat_jid", "subject", "chat_account", "sender_account", "confidence")
    for off in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(off, "-1")
    try:
        got = told()
        rows = [tuple(x) for x in got.collect()]
        assert len(rows) == len(message) and set(rows) == want
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(layouts, "SENT", 0)  # nothing is small enough to be sent
        rows = [tuple(x) for x in told().collect()]
        assert len(rows) == len(message) and set(rows) == want
    finally:
        for off in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(off)


def test_sweeps_store_only_the_labels_of_the_colour_in_turn(spark, monkeypatch):
    e = spark.createDataFrame([(f"a{k % 3}", f"b{k:02}", 1 + k % 2) for k in range(30)] + [("a0", "b01", 1)], "a string, b string, weight long")
    colours = spark.createDataFrame([(f"a{k}", 0) for k in range(3)] + [(f"b{k:02}", 1) for k in range(30)], "node string, colour int")
    stored, real = [], graph.checkpointed

    def watched(df, *by):
        kept = real(df, *by)
        stored.append(kept.count() if "moved" in df.columns else 0)
        return kept

    monkeypatch.setattr(graph, "checkpointed", watched)
    found = {r.node: r.label for r in graph.communities(e, colours).collect()}
    assert len(found) == 33 and all(found[f"a{k % 3}"] == found[f"b{k:02}"] for k in range(30) if k != 1) and len(set(found.values())) == 3
    assert 0 < max(stored) <= 30


def test_near_hashes_in_blocks_send_nothing_to_all_tasks(spark, monkeypatch):
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(4)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), r.randrange(5))) for b in base for _ in range(25)]
    every = [(k, h - (1 << 64) if h >> 63 else h) for k, h in enumerate([*near, *near[:40], *base[:1] * 30])] + [(7, every) for every in (0, 1)] + [(500, None)]
    df = spark.createDataFrame(every, "i long, hash long")
    bits = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    want = sorted((a, b, bits(x, y)) for a, x in every for b, y in every if a < b and None not in (x, y) and bits(x, y) <= 6)
    monkeypatch.setattr(digests, "BLOCK", 8)
    stored = []
    keep = lambda df: stored.append(df) or tables.checkpointed(df)
    monkeypatch.setattr(digests, "checkpointed", keep)
    monkeypatch.setattr(digests, "spread", lambda df, made, **more: stored.append(df) or tables.spread(df, made, **more))
    got = digests.near_hashes(df, "i")
    assert sorted(map(tuple, got.collect())) == want
    assert joins_in(got) == 0 and all("Broadcast" not in x._jdf.queryExecution().executedPlan().toString() for x in stored)
    held = [x for x in stored if "values" in x.columns]
    assert len(held) == 2 and all(x.agg({"size(values)": "max"}).first()[0] == 8 for x in (h.selectExpr("size(values)") for h in held))

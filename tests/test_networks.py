"""Participants as a nested column, and app tables joined by declaration."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, participants, tables
from tidemark.sources import layouts

T0 = 1_704_067_200


def people(*who):
    return [{"role": "to", "identifier": i, "name": n, "is_owner": o} for i, n, o in who]


def test_graph_of_group_messages(spark):
    rows = [
        ("m1", "Messages", "outgoing", "a", 10, None, people(("+1 555 123 4567", "Ann", False), ("bob@x.org", "Bob", False))),
        ("m2", "Messages", "incoming", "b", 20, None, people(("15551234567@s.whatsapp.net", "Annie", False), ("", "", True), ("15551234567", "Ann", False))),
        ("c1", "Calls", "outgoing", "a", 30, 30 + 90_000_000, people(("BOB@x.org/mobile", "", False))),
        ("n1", "Messages", "outgoing", "a", 40, None, people(("", "", False))),
        ("n2", "Messages", "outgoing", "a", 50, None, None),
    ]
    df = spark.createDataFrame(rows, f"artifact_id string, category string, direction string, app string, timestamp long, timestamp_end long, participants {participants.TYPE}")
    got = {(r.a, r.b): r for r in participants.edges(df).collect()}
    ann, bob, owner = "5551234567", "bob@x.org", participants.OWNER
    assert {k: r.weight for k, r in got.items()} == {(ann, owner): 2, (owner, bob): 2, (ann, bob): 1}
    assert (got[owner, bob].calls, got[owner, bob].seconds, got[owner, bob].first, got[owner, bob].last) == (1, 90, 10, 30) and got[ann, owner].apps == 2
    nodes = {r.node: r for r in participants.nodes(df).collect()}
    assert {k: r.weight for k, r in nodes.items()} == {ann: 3, bob: 2, owner: 3}  # twice on m2; the owner once named and twice not
    assert (nodes[owner].messages, nodes[ann].incoming, nodes[bob].calls) == (3, 2, 1) or nodes[owner].outgoing == 0
    labels = {r.key: r.label for r in graph.labelled(participants.names(df)).collect()}
    assert labels == {ann: "Ann", bob: "Bob"}
    ids = lambda v: sorted(r[0] for r in df.filter(participants.met(v)).select("artifact_id").collect())
    assert ids("(555) 123-4567") == ["m1", "m2"] and ids("annie") == ["m2"] and ids("X.ORG") == ["c1", "m1"] and ids("nobody") == []


def test_pairs_agree_with_brute_force(spark):
    rows = [(f"m{k}", "Messages", "outgoing", "a", k, None, people(*((f"u{(k * i) % 7}@x", "", i == 3) for i in range(k % 5)))) for k in range(60)]
    df = spark.createDataFrame(rows, f"artifact_id string, category string, direction string, app string, timestamp long, timestamp_end long, participants {participants.TYPE}").repartition(4)
    want = collections.Counter()
    for *_, own in rows:
        keys = {participants.OWNER if p["is_owner"] else p["identifier"] for p in own}
        if keys:
            want.update(itertools.combinations(sorted(keys | {participants.OWNER}), 2))
    assert {(r.a, r.b): r.weight for r in participants.edges(df).collect()} == dict(want)


def messenger(spark):
    make = spark.createDataFrame
    new = {
        "message": make([(1, 10, None, 1, T0 * 1000, "hi", "allocated", 1.0), (2, 10, 5, 0, T0 * 1000 + 1, "yo", "wal", 0.7), (3, 99, None, 0, 0, None, "allocated", 1.0)], "_id long, chat_row_id long, sender_jid_row_id long, from_me int, timestamp long, text_data string, recovery string, confidence double"),
        "CHAT": make([(10, 4, "club", 0.9), (10, 4, "old club", 0.4)], "_id long, jid_row_id long, subject string, confidence double"),
        "jid": make([(4, "123-456@g.us", 0.6), (5, "15551234567@s.whatsapp.net", 1.0)], "_id long, raw_string string, confidence double"),
    }
    old = {"messages": make([(1, "15551234567@s.whatsapp.net", None, 0, T0 * 1000, None, "a photo"), (2, "123-456@g.us", "447000000001@c.us", 0, T0 * 1000, "hey", None)], "_id long, key_remote_jid string, remote_resource string, key_from_me int, timestamp long, data string, media_caption string")}
    return new, old


def test_both_layouts_of_a_messenger(spark):
    new, old = messenger(spark)
    assert layouts.chosen(layouts.MESSENGER, new).name == "messenger, new" and layouts.chosen(layouts.MESSENGER, old).name == "messenger, old"
    assert layouts.chosen(layouts.MESSENGER, {"message": new["message"]}) is None
    got = {r.source_row: r for r in layouts.messages(new).collect()}
    assert len(got) == 3 and [(got[k].direction, got[k].party, got[k].body) for k in (1, 2, 3)] == [("outgoing", "123-456@g.us", "hi"), ("incoming", "5551234567", "yo"), ("incoming", "", "")]
    # the least sureness of all rows that met: message, chat (the surer of two), account two tables away
    assert [got[k].confidence for k in (1, 2, 3)] == [0.6, 0.6, 1.0] and got[2].recovery == "wal" and got[3].timestamp is None
    assert '"subject":"club"' in got[1].attributes and [p.role for p in got[1].participants] == ["owner", "to"] and len(got[3].participants) == 1
    legacy = {r.source_row: r for r in layouts.messages(old).collect()}
    assert [(legacy[k].party, legacy[k].body, legacy[k].timestamp) for k in (1, 2)] == [("5551234567", "a photo", T0 * 10**6), ("7000000001", "hey", T0 * 10**6)]
    edges = {(r.a, r.b): r.weight for r in participants.edges(layouts.messages(new)).collect()}
    assert edges == {("123-456@g.us", "__owner__"): 1, ("5551234567", "__owner__"): 1}


def test_calls_short_messages_and_mail(spark):
    make = spark.createDataFrame
    calls = {"call_log": make([(1, 5, 1, T0 * 1000, 30, 1), (2, 6, 0, T0 * 1000, 0, 0)], "_id long, jid_row_id long, from_me int, timestamp long, duration int, video_call int"), "jid": make([(5, "15551234567@s.whatsapp.net")], "_id long, raw_string string")}
    got = {r.source_row: r for r in layouts.calls(calls).collect()}
    assert (got[1].subtype, got[1].timestamp_end - got[1].timestamp, got[1].party) == ("Video call", 30_000_000, "5551234567") and got[2].timestamp_end is None and "unknown" in got[2].body
    sms = {
        "sms": make([(1, 7, "+1 (555) 123-4567", 1, T0 * 1000, "a"), (2, 7, None, 2, T0 * 1000, "b"), (3, 8, "", 3, T0 * 1000, "c")], "_id long, thread_id long, address string, type int, date long, body string"),
        "threads": make([(7, "3")], "_id long, recipient_ids string"), "canonical_addresses": make([(3, "0044 7000 000001", 0.5)], "_id long, address string, confidence double"),
    }
    got = {r.source_row: r for r in layouts.short_messages(sms).collect()}
    assert [(got[k].direction, got[k].party, got[k].confidence) for k in (1, 2, 3)] == [("incoming", "5551234567", 0.5), ("outgoing", "7000000001", 0.5), ("draft", "", 1.0)]
    alone = {r.source_row: r.party for r in layouts.short_messages({"sms": sms["sms"]}).collect()}
    assert alone == {1: "5551234567", 2: "", 3: ""}
    post = {
        "Message": make([(1, 2, T0 * 1000, "lunch", "Me <me@x.org>"), (2, 2, T0 * 1000, None, "you@y.org")], "_id long, mailboxKey long, timeStamp long, subject string, fromList string"),
        "Mailbox": make([(2, 9, "Inbox")], "_id long, accountKey long, displayName string"), "Account": make([(9, "me@x.org")], "_id long, emailAddress string"),
        "recipients": make([(1, "b@z.org", 0.8), (1, "a@z.org", 1.0), (2, "me@x.org", 1.0)], "message_id long, address string, confidence double"),
    }
    got = {r.source_row: r for r in layouts.mail(post).collect()}
    assert (got[1].direction, got[1].party, got[1].confidence, [p.identifier for p in got[1].participants]) == ("outgoing", "a@z.org", 0.8, ["Me <me@x.org>", "a@z.org", "b@z.org"])
    assert (got[2].direction, got[2].party, got[2].participants[1].is_owner) == ("incoming", "you@y.org", True)


def test_a_layout_of_ones_own(spark):
    make = spark.createDataFrame
    tables = {"t": make([(1, None, "b"), (2, "", "d"), (3, "c", None)], "Id long, first string, second string"), "u": make([(1, 5), (1, 6)], "ref long, v long")}
    own = layouts.Layout("own", ("missing", "T"), {"row": ("id",), "text": ("first", "second"), "none": ("nowhere",)}, (layouts.Hop(("u",), "row", ("ref",), {"vs": ("v",)}, every=True), layouts.Hop(("gone",), "row", ("ref",), {"w": ("v",)})))
    got = {r.row: (r.text, r.none, r.vs, r.w, r.confidence) for r in layouts.joined(own, tables).collect()}
    assert got == {1: ("b", None, [5, 6], None, 1.0), 2: ("d", None, None, None, 1.0), 3: ("c", None, None, None, 1.0)}
    with pytest.raises(ValueError):
        layouts.joined(own, {})
    assert layouts.joined(own, tables).filter(F.col("row") > 0).count() == 3


def test_rows_are_dealt_out_by_what_they_become(spark):
    df = spark.range(40).select(F.col("id"), (F.col("id") * 10).alias("n")).coalesce(1)
    dealt = tables.spread(df, F.col("n"), most=500)
    assert dealt.rdd.getNumPartitions() == 16 and sorted(r.id for r in dealt.collect()) == list(range(40))
    assert tables.spread(df.filter("id < 0"), F.col("n")).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 30, 3])
def test_parties_and_not_pairs_are_sent(spark, most):
    r = random.Random(8)
    some = lambda *v: r.choice([*v, None])
    rows = []
    for k in range(70):
        own = people(*((f"{'u' * (i % 3 + 1)}{i}@x", "", i == 9) for i in [0, *r.sample(range(12), r.randrange(7))])) if k % 9 else some([], people(("", "", True)))
        rows.append((f"m{k}", some("Calls", "Messages", "Web"), some("outgoing", "incoming", "draft"), some("a", "b", ""), some(k), some(k + 1_500_000 * k), own))
    df = spark.createDataFrame(rows, f"artifact_id string, category string, direction string, app string, timestamp long, timestamp_end long, participants {participants.TYPE}").repartition(3)
    want = {}
    for _, category, direction, app, begun, ended, own in rows:
        keys = {participants.OWNER if p["is_owner"] else p["identifier"] for p in own or ()}
        for pair in itertools.combinations(sorted(keys | {participants.OWNER}), 2) if keys else ():
            e = want.setdefault(pair, {"n": collections.Counter(), "apps": set(), "times": []})
            e["n"].update({"weight": 1, "calls": category == "Calls", "messages": category not in (None, "Calls"), "outgoing": direction == "outgoing", "incoming": direction == "incoming"})
            e["n"]["seconds"] += (ended - begun) // 1_000_000 if category == "Calls" and None not in (begun, ended) else 0
            e["apps"] |= {app} - {None, ""}
            e["times"] += [begun] if begun is not None else []
    made = participants.edges(df, most) if most < 1_000_000 else participants.edges(df)
    got = {(x.a, x.b): x for x in made.collect()}
    assert got.keys() == want.keys() and len(got) == made.count()
    for pair, e in want.items():
        x = got[pair]
        assert {c: x[c] for c in e["n"]} == e["n"] and (x.apps, x.first, x.last) == (len(e["apps"]), min(e["times"], default=None), max(e["times"], default=None))
    plan = made.select("*")._jdf.queryExecution().executedPlan().toString()  # not run yet, so one plan
    assert plan.count("Exchange hashpartitioning") == (1 if most == 1_000_000 else 3) and "Exchange hashpartitioning(x#" in plan

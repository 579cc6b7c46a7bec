"""Folder trees, text dumps, resumed ingest, and streams that keep state."""

import collections
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import digests, timeline, trees
from tidemark.sources import dumps
from tidemark.sources import ingest as I
from tidemark.streaming import stateful, windows

MIN = 60_000_000
T0 = 1_704_067_200_000_000


# trees


def test_sums_roll_up(spark):
    rnd = random.Random(1)
    paths = ["/".join(["r", *(rnd.choice("abc") for _ in range(rnd.randint(0, 4))), f"f{k}.txt"]) for k in range(200)] + ["top.txt", "/x//y/z.bin"]
    rows = [(p, k, T0 + k) for k, p in enumerate(paths)]
    got = {r.folder: r for r in trees.sums(spark.createDataFrame(rows, "path string, size long, modified long"), deepest=3).collect()}
    want = collections.defaultdict(lambda: [0, 0, 0, set()])
    for p, size, _ in rows:
        parts = [x for x in p.split("/") if x]
        for d in range(1, min(3, len(parts) - 1) + 1):
            own = want["/".join(parts[:d])]
            own[0] += 1
            own[1] += size
            own[2] += d == len(parts) - 1
            if d < len(parts) - 1:
                own[3].add(parts[d])
    assert {k: (r.files, r.bytes, r.direct, r.folders) for k, r in got.items()} == {k: (a, b, c, len(d)) for k, (a, b, c, d) in want.items()}
    assert got["x"].depth == 1 and got["x/y"].files == 1 and "top.txt" not in got


def tree(spark):
    rows = [("data/data/com.keepsafe.switchboard/files/a.db", 1), ("data/user/0/org.gone.app/x/y.db", 2), ("data/data/com.android.phone/z.db", 3), ("data/data/com.here.app/q.db", 4)]
    rows += [("sdcard/.Vault_1/p1.hid", 5), ("sdcard/.Vault_1/deep/p2.jpg", 6), ("sdcard/DCIM/.thumbdata4--123", 7), ("sdcard/backup/msgstore.db.crypt14", 8), ("sdcard/DCIM/img.enc", 9), ("sdcard/a/.lock", 10)]
    return spark.createDataFrame([(p, n, T0) for p, n in rows], "path string, size long, modified long")


def test_hidden_caches_and_left_behind(spark):
    df = tree(spark)
    hidden = {(r.path, r.why): r.files for r in trees.hidden(df).collect()}
    app = "data/data/com.keepsafe.switchboard"  # a hiding app's own folder has its name too
    assert hidden == {(app, "folder"): 1, (f"{app}/files", "folder"): 1, ("sdcard/.Vault_1", "folder"): 2, ("sdcard/.Vault_1/deep", "folder"): 1, ("sdcard/.Vault_1/p1.hid", "ending"): 1, ("sdcard/DCIM/img.enc", "ending"): 1}
    assert {(r.why, r.size) for r in trees.caches(df).collect()} == {("thumbnails", 7), ("encrypted backup", 8)}
    installed = spark.createDataFrame([("com.here.app",), ("com.other",)], "package string")
    assert {(r.package, r.files, r.bytes) for r in trees.left_behind(df, installed).collect()} == {("com.keepsafe.switchboard", 1, 1), ("org.gone.app", 1, 2)}
    assert trees.left_behind(df, installed.limit(0)).count() == 0
    watched = spark.createDataFrame([("com.keepsafe.switchboard", "K", "vault"), ("com.other", "O", "vpn"), ("com.none", "N", "root")], "package string, name string, kind string")
    assert {(r.package, r.installed, r.data_there) for r in trees.watched_apps(df, installed, watched).collect()} == {("com.keepsafe.switchboard", False, True), ("com.other", True, False)}


@pytest.mark.parametrize("late, days, want", [(10, 30, ("medium", 0.667)), (30, 30, ("low", 0.4)), (70, 30, None), (10, 500, None)])
def test_reset_estimate(spark, late, days, want):
    at = [T0 + k * 1000 for k in range(20)] + [T0 + 2 * trees.DAY_US + k for k in range(late - 1)] + [T0 + days * trees.DAY_US]
    got = trees.reset_estimate(spark.createDataFrame([("p", 1, t) for t in at], "path string, size long, modified long")).collect()
    assert [(r.confidence, r.ratio) for r in got] == ([want] if want else [])
    assert trees.reset_estimate(spark.createDataFrame([("p", 1, T0)] * 19, "path string, size long, modified long")).count() == 0


# dumps


def test_provider_dump_over_splits(spark, tmp_path):
    rnd = random.Random(2)
    bodies = [rnd.choice(["hi", "a, b, c", "line one\nline two, x=1 is no field", "eq=ual", "", "Row of seats", "long " * 50]) + str(k) for k in range(3_000)]
    with open(f"{tmp_path}/sms.txt", "w") as f:
        for k, b in enumerate(bodies):
            f.write(f"Row: {k} _id={k}, address=+1555000{k % 10:04}, date={1_700_000_000_000 + k}, type={1 + k % 2}, body={b}, Read=1, empty=NULL\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = dumps.provider_rows(spark, f"{tmp_path}/sms.txt")
        assert rows.rdd.getNumPartitions() > 20
        got = {r.number: r.fields for r in rows.collect()}
        arts = {r.source_row: r for r in dumps.dumped_messages(spark, f"{tmp_path}/sms.txt").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3_000 and all(got[k]["_id"] == str(k) and got[k]["read"] == "1" and got[k]["empty"] is None for k in range(3_000))
    plain = [k for k, b in enumerate(bodies) if "x=1" not in b]
    assert all(got[k]["body"] == bodies[k] for k in plain)
    assert all(arts[k].body == bodies[k] and arts[k].party == f"555000{k % 10:04}" and arts[k].direction == ("incoming", "outgoing")[k % 2] for k in plain)
    assert arts[5].timestamp == 1_700_000_000_005_000


def test_service_dumps(spark, tmp_path):
    lines = ["junk", "  Call number=+1555-000-1111, type=2, date=1700000000000", "x phone=15550001111 when=1700000000000", "addr=0044700000 time=1700000001000", "Display Name=Ann 555 123 4567 and +44 7000 000001", "latitude=19.07 longitude: 72.87 time=1700000000000", "last location=Location[gps 19.08,72.88 acc=5]", "lat=0.0 lon=0.0", "lat=99.5, lng=1.5"]
    with open(f"{tmp_path}/telephony.txt", "w") as f:
        f.write("\n".join(lines * 400))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        calls = sorted((r.party, r.timestamp) for r in dumps.service_calls(spark, str(tmp_path)).collect())
        contacts = {(r.party, r.body) for r in dumps.service_contacts(spark, str(tmp_path)).collect()}
        places = sorted((r.latitude, r.longitude, r.timestamp) for r in dumps.service_places(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ("5550001111", 1_700_000_000_000_000) in calls and ("0044700000", 1_700_000_001_000_000) in calls
    assert ("5551234567", "Ann 555 123 4567 and +44 7000 000001") in contacts
    assert places == [(19.07, 72.87, 1_700_000_000_000_000), (19.08, 72.88, None)]


# ingest


def test_ingest_resumes_and_adds_nothing_twice(spark, tmp_path):
    folder = f"{tmp_path}/in"
    os.makedirs(f"{folder}/deep")
    for k in range(12):
        with open(f"{folder}/{'deep/' if k % 3 == 0 else ''}m{k}.xml", "w") as f:
            f.write("<smses>" + "".join(f'<sms address="55500000{k:02}" date="{1_700_000_000_000 + j}" type="1" body="m {k} &amp; {j}"/>' for j in range(k)) + "</smses>")
    for name, what in (("bad.xml", "not xml"), ("copy.xml", open(f"{folder}/m5.xml").read()), ("x.tmp", "noise")):
        with open(f"{folder}/{name}", "w") as f:
            f.write(what)
    store = I.Store(spark, f"{tmp_path}/store")

    class Stop(Exception):
        pass

    done = []

    def stop(k):
        done.append(k)
        if len(done) == 2:
            raise Stop

    with pytest.raises(Stop):
        I.ingest(store, folder, I.decode_message_xml, batches=4, after_batch=stop)
    part = store.rows().count()
    # a run that breaks off between its rows and its manifest
    spark.createDataFrame([("s", "a", 1, 1, "b", "lost")], "sha256 string, address string, date long, type int, body string, batch string").write.mode("append").parquet(f"{tmp_path}/store/rows")
    assert store.rows().count() == part < sum(range(12))
    I.ingest(store, folder, I.decode_message_xml, batches=4)
    bodies = collections.Counter(r.body for r in store.rows().collect())
    assert bodies == collections.Counter(f"m {k} & {j}" for k in range(12) for j in range(k))
    assert [r.error for r in store.failed().collect()] == ["no backup of messages"]
    assert store.manifest().count() == 13 and I.ingest(store, folder, I.decode_message_xml, batches=4) == 0
    with open(f"{folder}/new.xml", "w") as f:
        f.write('<smses><sms address="1" date="5" type="2" body="late"/></smses>')
    assert I.ingest(store, folder, I.decode_message_xml) == 1 and store.rows().count() == sum(range(12)) + 1


# streams


def until_done(query):
    query.awaitTermination(120)
    assert not query.isActive and query.exception() is None


@pytest.fixture
def kept_state(spark):
    spark.conf.set(*stateful.STATE_STORE)
    yield
    spark.conf.unset(stateful.STATE_STORE[0])


ROWS = "artifact_id string, exhibit string, party string, timestamp long"


def test_interval_join_agrees_with_the_batch_join(spark, tmp_path):
    rnd = random.Random(3)
    acts = [(f"a{k}", rnd.choice("EF"), "p", T0 + k * 7 * MIN) for k in range(120)]
    log = [(f"u{k}", rnd.choice("EF"), "p", T0 + rnd.randint(0, 840) * MIN) for k in range(120)]
    log.sort(key=lambda r: r[3])
    read = lambda name: windows.dated(windows.read_stream(spark, f"{tmp_path}/{name}", spark.createDataFrame([], ROWS).schema), "1 hour")
    write = lambda name, rows: spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    run = lambda: until_done(stateful.fused(read("acts"), read("log")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start())
    write("acts", acts[:60])
    write("log", log[:60])
    run()
    write("log", log[60:])  # a restart from the state that the first run left
    write("acts", acts[60:])
    run()
    write("log", [("late", "E", "p", T0)])  # far behind the watermark: its partners are forgotten
    run()
    got = {(r.artifact_id, r.usage_id, r.away_us) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(a[0], u[0], abs(a[3] - u[3])) for a in acts for u in log if a[1] == u[1] and abs(a[3] - u[3]) <= 15 * MIN}


def test_stream_bursts_agree_with_the_batch_ones(spark, tmp_path, kept_state):
    rnd, rows, t = random.Random(4), [], T0
    for k in range(240):
        t += rnd.choice([1, 10, 45, 46, 200]) * MIN
        rows.append((f"a{k:04}", "E", rnd.choice("pq"), t))
    schema = spark.createDataFrame([], ROWS).schema
    want = {(r.party, r.n, r.start, r.stop) for r in timeline.bursts(spark.createDataFrame(rows, ROWS)).collect()}
    source = lambda: windows.dated(windows.read_stream(spark, f"{tmp_path}/in", schema), "2 hours")
    run = lambda: until_done(stateful.bursts(source()).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start())
    for at in range(0, 240, 80):
        some = rows[at : at + 80]
        rnd.shuffle(some)
        spark.createDataFrame(some, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()  # each from the state that the one before left
    ends = [("late", "E", "p", T0), ("end", "E", "z", t + 10_000 * MIN)]
    spark.createDataFrame(ends, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    spark.createDataFrame([("end2", "E", "z", t + 20_000 * MIN), ("late2", "E", "p", T0)], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = [(r.party, r.n, r.start, r.stop) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got))
    if any(r[0] == "p" and r[2] == T0 for r in got):  # the late row came before the watermark moved on, and joined the first run
        pytest.fail("a late row was counted")
    assert set(got) == want and len(want) > 10


def test_stream_of_chains_finds_what_the_batch_check_finds(spark, tmp_path, kept_state):
    entries, before = [], ""
    for seq in range(40):
        content = f"entry {seq}"
        own = hashlib.sha256(f"{before}|{content}".encode()).hexdigest()
        entries.append(("log", seq, before, own, content))
        before = own
    entries[7] = (*entries[7][:4], "forged")
    relinked = hashlib.sha256(b"elsewhere|entry 20").hexdigest()
    entries[20] = ("log", 20, "elsewhere", relinked, "entry 20")
    del entries[30]
    names = "log string, seq long, previous string, own string, content string"
    df = spark.createDataFrame(entries, names)
    want = {(r.seq, r.broken) for r in digests.verify_chain(df, "seq", "previous", "own", F.col("content")).collect()}
    for some in (entries[:15], entries[15:]):
        spark.createDataFrame(some, names).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = windows.read_stream(spark, f"{tmp_path}/in", df.schema)
        until_done(stateful.chain_checks(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start())
    got = {(r.seq, r.broken) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want and {"own digest", "gap", "previous digest"} == {b for _, b in got}

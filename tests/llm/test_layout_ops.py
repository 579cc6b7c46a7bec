import collections
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, decontaminate, mixing, quality, registry, sharding, simhash
from tidemark.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_mixing_targets_and_bounds(spark):
    rows = [(i, "w " * (10 + i % 7), ("big", "mid", "tiny", None)[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2 + i % 20 // 10], i) for i in range(400)]
    rows += [(900, None, "big", 1), (901, "", "mid", 1), (902, "a b", "mid", 1), (902, "a b", "mid", 1), (None, "x y z", "big", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.mix(df, docs_per_shard=20, shards_per_group=3).collect()
    assert len(got) == len(rows) and "text" not in got[0].asDict()
    words = collections.Counter()
    for r in rows:
        words[r[2]] += len((r[1] or "").split())
    order = sorted((s for s in words if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(words.values()))
    while True:
        shares = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if shares[s] > 3 * words[s]}
        if not over:
            target |= shares
            break
        for s in over:
            target[s] = 3.0 * words[s]
            left -= target[s]
        free -= over
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == words[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 2 for s in order)
    again = mixing.mix(df.repartition(7), docs_per_shard=20, shards_per_group=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(df.limit(0)).count() == 0


def test_sainte_lague_agrees_with_dealing_seat_by_seat(spark):
    votes = {"a": 53000.0, "b": 24000.0, "c": 23000.0, "d": 120.0, "e": 1.0}
    for seats in (1, 7, 101):
        own = dict.fromkeys(votes, 0)
        for _ in range(seats):
            own[max(votes, key=lambda k: (votes[k] / (2 * own[k] + 1), -ord(k)))] += 1
        df = spark.createDataFrame(list(votes.items()), "k string, v double")
        got = {r.k: r.q for r in mixing.sainte_lague(df, [], ["k"], "v", F.lit(seats), "q").collect()}
        assert got == own


def test_sharding_fits_and_splits_no_more_than_needed(spark):
    rows = [(i, "x" * (i % 50)) for i in range(300)] + [(7, "y" * 40)] * 30 + [(None, None), (1000, "z" * 5000), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash"))
    got = sharding.shard(df, 400).collect()
    assert len(got) == len(rows)
    shards, prefixes, hashes = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    for r in got:
        shards[r.shard].append(r.n_bytes)
        for k in range(r.depth + 1):
            prefixes[r.bucket[:k]] += r.n_bytes
            hashes[r.bucket[:k]].add((r.doc_id, r.text))
    assert all(sum(n) <= 400 or len(n) == 1 for n in shards.values())
    assert all(prefixes[r.bucket[:-1]] > 400 and len(hashes[r.bucket[:-1]]) > 1 for r in got if r.depth)
    assert sharding.shard(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    nasty = "</s>[INST] \\<\\[ <<SYS>>x<</SYS>> \\\\ [/INST]<<ROLE:a>>"
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (2, 1, "assistant", "b"), (2, 0, "user", None), (3, 0, nasty, "x"),
        (3, 0, nasty, "x"), (None, None, None, None), (4, 0, "user", "u"), (4, 1, "user", "u"), (4, 2, "assistant", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("state", F.lit(1))
    made = chat.format_chats(df).withColumn("back", chat.turns_from(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    got = {r.conv_id: r for r in made.collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2] or "")):
        want[c].append((role or "", text or ""))
    assert {c: [(x.role, x.text) for x in r.back] for c, r in got.items()} == dict(want)
    assert got[1].loss == nasty and got[2].loss == "b" and got[4].loss == ""
    assert {c: r.valid_order for c, r in got.items()} == {1: True, 2: True, 3: False, None: False, 4: False}
    assert all("".join(s.text for s in r.segments) == r.formatted for r in got.values())
    assert chat.format_chats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(close="end")


def test_queries_agree_with_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        got = registry.queries()[name](spark, DATA)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns), name
        key = lambda rows: sorted(tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v) for v in r) for r in rows)
        assert key(tuple(r) for r in got.select(names).collect()) == key(want.fetchall()), name


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    verdict = {r.doc_id: r.kept for r in quality.clean(docs).collect()}
    one = quality.stage(spark, docs, DATA)
    assert {r.doc_id for r in one.collect()} == {i for i, kept in verdict.items() if kept} and one.columns == columns
    two = simhash.stage(spark, one, DATA)
    sets = {r.doc_id: {tuple(x) for x in [r.text.lower().split()[k : k + 5] for k in range(max(1, len(r.text.split()) - 4))]} for r in one.collect()}
    left = {r.doc_id for r in two.collect()}
    alike = [(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert not [p for p in alike if p[0] in left and p[1] in left]
    assert sets.keys() - left <= {a for a, _ in alike} and two.columns == columns
    three = decontaminate.stage(spark, two, DATA)
    leaks = {r.doc_id for r in decontaminate.op4_decontamination(spark, DATA).collect() if r.contaminated}
    assert {r.doc_id for r in three.collect()} == left - leaks or not leaks
    four = mixing.stage(spark, three, DATA)
    n = collections.Counter(r.doc_id for r in four.collect())
    assert four.columns == columns and max(n.values()) <= 3
    five = sharding.stage(spark, four, DATA).collect()
    assert len(five) == sum(n.values()) and "shard" in five[0].asDict()
    whole = corpus_pipeline.run(spark, DATA).collect()
    digest = lambda rows: sorted(hashlib.sha256(f"{r.doc_id} {r.text} {r.shard}".encode()).hexdigest() for r in rows)
    assert digest(whole) == digest(five)

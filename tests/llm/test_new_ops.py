"""Packing, phrase mining and conversation repair against brute force and SQL, with nulls, ties, repeats, long texts and clashing names."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing, phrases, repair
from tidemark.llm.tokens import encoder, tokenizer_content


@pytest.fixture(scope="module")
def content():
    return tokenizer_content(packing.TOKENIZER)


def sql_rows(con, sql):
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


# packing


def test_coder_gives_the_librarys_ids(content):
    whole, coder = encoder(content), packing.Coder(content)
    assert coder.fast is not None
    rnd = random.Random(4)
    pools = ["abc XYZ'std.,!? \n\t", "éàß ñ'LL'll  \r\n1２²½", "日本語 かな。、！中文字 ", "​　 \u0085  x", "😀 ابج ٣ ก\U000e0100\U00031350x "]
    texts = ["".join(rnd.choice(p) for _ in range(rnd.randint(0, 60))) for p in pools for _ in range(200)]
    texts += ["", "a<|endoftext|>b <|endoftext|>", "x" * 3000, " " * 3000, "\n" * 500 + "y", "it's we'll I'M 'tis ''s"]
    for t in texts:
        want = whole.encode(t, add_special_tokens=False).ids
        assert coder.ids(t).tolist() == want and coder.ids(t, 7).tolist() == want, t


def test_coder_on_every_settled_character(content):
    whole, coder = encoder(content), packing.Coder(content)
    for a, b in packing.SETTLED:
        for at in range(a, b + 1, 512):
            t = "\n".join(f"a{c}b1{c}2-{c}- {c} {c}'s" for c in map(chr, range(at, min(at + 512, b + 1))))
            assert not packing.OUTSIDE.search(t) and coder.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids


def slots(runs):
    for length, rank, number, first, each, at in runs:
        for k in range(number):
            yield length, rank + k, first + k // each, at + k % each * length


def best_fit(counts, capacity):
    """Best fit, longest first, one piece after another: the number of sequences."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [r for r in rooms if r >= length]
            r = min(fitting) if fitting else None
            if r is not None:
                rooms.remove(r)
            rooms.append((capacity if r is None else r) - length)
    return collections.Counter(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_over_counts_is_best_fit_over_pieces(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 20, 64])
    counts = {rnd.randint(1, capacity): rnd.choice([1, 2, 5, 40]) for _ in range(rnd.randint(1, 15))}
    placed = list(slots(packing.plan(counts, capacity)))
    assert sorted((n, r) for n, r, _, _ in placed) == sorted((n, r) for n in counts for r in range(counts[n]))
    held = collections.defaultdict(list)
    for length, _, sequence, at in placed:
        held[sequence].append((at, length))
    for own in held.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(own))]
        assert [at for at, _ in sorted(own)] == ends[:-1] and ends[-1] <= capacity
    assert collections.Counter(capacity - sum(n for _, n in own) for own in held.values()) == best_fit(counts, capacity)


def test_plan_does_not_grow_with_counts():
    counts = {k: 10**12 + k for k in range(1, 2049)}
    runs = packing.plan(counts, 2048)
    assert len(runs) < 50_000
    made = max(first + -(-number // each) for _, _, number, first, each, _ in runs)
    assert made <= 1.01 * sum(k * n for k, n in counts.items()) / 2048


def test_pack_round_trip_with_hot_lengths_nulls_and_clashes(spark, content):
    whole = encoder(content)
    rnd = random.Random(2)
    texts = ["same text for a third of all"] * 120 + [" ".join(rnd.choice(["one", "two", "drei", "vier'll"]) for _ in range(rnd.randint(0, 90))) for _ in range(150)]
    texts += [None, "", "word " * 500, "<|endoftext|> inside", "x" * 5000]
    rows = [(k if k % 7 else None, t, "mine", "theirs", 5, "own") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, PIECE string, _part string, Sequence_ID int, _rank string").repartition(5)
    packed = packing.pack(df, content, capacity=64, with_ids=True)
    assert packed.columns == ["doc_id", "_part", "_rank", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    got = packed.collect()
    assert {(r["_part"], r["_rank"]) for r in got} == {("theirs", "own")}
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, (start, length) in enumerate(packing.cut(len(ids), 64)):
            own = ids[start : start + length]
            want[i, piece, start, length, zlib.crc32(np.array(own, "<u4")), tuple(own)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    made = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert max(map(len, made.values())) <= 64 and sum(map(len, made.values())) == sum(r.length for r in got)
    assert all(made[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in got)
    assert len(made) == sum(best_fit(collections.Counter(r.length for r in got), 64).values())
    assert packing.pack(df.limit(0), content).count() == 0
    assert packing.pack(df.filter("text is null or text = ''"), content, end=None).count() == 0


# phrase mining


def test_op12_sql_with_nulls_ties_and_repeats(spark, tmp_path):
    rnd = random.Random(9)
    words = ["the", "The", "cat", "sat", "on", "mat", "é", "ÉÀ", "a b", "x-y", "1"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!"]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    rows = [(t, rnd.choice(["en", "de", None, "und", ""]), t, 1) for t in texts] + [("same old story again", "en", "", 1)] * 40 + [(None, "en", "", 1), ("", None, "", 1), (". ! \n", "xx", "", 1)]
    df = spark.createDataFrame(rows, "text string, lang string, phrase string, _salt int").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names, want = sql_rows(con, phrases.OP12_SQL)
    got = phrases.op12_phrase_mining(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want) and len(want) > 40
    # few buckets let more be counted, more shards take more steps, and neither changes a count
    for shards, buckets in ((1, 64), (5, 64), (4, 1 << 12)):
        again = phrases.collocations(df, shards=shards, buckets=buckets)
        assert sorted(map(tuple, again.select(names).collect())) == sorted(want)


def brute_counts(texts, most):
    counts = collections.Counter()
    for t in texts:
        for piece in t.translate({ord(c): "\n" for c in ".,;:!?\x0b\x0c\r"}).split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in w]
            for k in range(1, most + 1):
                counts.update((" ".join(w[i : i + k]), k) for i in range(len(w) - k + 1))
    return counts


def test_long_texts_in_small_pieces_and_longer_phrases(spark, monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["aa", "b", "Cc", "d.", "ee"]) for _ in range(4000)), "aa b cc " * 50, "w" * 300]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    monkeypatch.setattr(phrases, "PIECE", 37)
    monkeypatch.setattr(phrases, "COUNTED", 50)
    monkeypatch.setattr(phrases, "MOST_KNOWN", 3)
    table = np.full(64, phrases.NEVER, np.uint8)
    table[:] = 0
    for step in (1, 2):
        scan = phrases.Scan("x", table, step, 2, 5)
        got: collections.Counter = collections.Counter()
        for b in itertools.chain(*(scan.add(t.encode()) for t in [*texts, "tail"]), scan.flush()):
            for p, k, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                got[p, k] += n
        every = got.pop(("", 0), 0)
        assert every == (sum(n for (_, k), n in brute_counts([*texts, "tail"], 1).items()) if step < 2 else 0)
        want = collections.Counter({x: n for x, n in brute_counts([*texts, "tail"], 5).items() if step < 2 or x[1] > 1})
        assert got == want
    monkeypatch.undo()
    found, totals = phrases.frequent(df, min_count=10, most_words=5, shards=3, buckets=1 << 10)
    want = {x: n for x, n in brute_counts(texts, 5).items() if n >= 10}
    assert {(r.phrase, r.k): r.n for r in found.collect()} == want
    assert totals.first().n == sum(n for (_, k), n in brute_counts(texts, 1).items())


def test_longer_phrases_start_before_shorter_ones_are_done(spark, monkeypatch):
    seen = []
    whole = phrases.scanned
    monkeypatch.setattr(phrases, "scanned", lambda texts, steps, step, *a: (seen.append((step, {r.k for r in whole(texts, steps, step, *a).select("k").distinct().collect()})), whole(texts, steps, step, *a))[1])
    df = spark.createDataFrame([("one two three four", "x")] * 120, "text string, lang string").repartition(3)
    assert {r.phrase: r.a for r in phrases.collocations(df).collect()} == {"one two three": 120, "two three four": 120}
    assert dict(seen) == {0: {0, 1}, 1: {0, 1, 2}, 2: {2, 3}, 3: {3}}


def test_no_documents(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# conversation repair


def brute_repair(rows):
    """All edit strings of bounded length, cheapest and then least: (cost, audit, repaired)."""
    seen, told = set(), []
    for role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        told.append((role, text, fault))
    best = None
    n = len(told)

    def legal(shape):
        body = shape[1:] if shape[:1] == "s" else shape
        return not shape or (body and len(body) % 2 == 0 and all(c == "ua"[i % 2] for i, c in enumerate(body)))

    def walk(i, cost, audit, out):
        nonlocal best
        shape = "".join(r[:1] for r, _ in out)
        if cost > 4 * n or (shape and not (shape in "s" or legal(shape) or legal(shape + "a") or legal(shape + "ua"))):
            return
        if i == n:
            if legal(shape):
                found = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
                best = found if best is None or found[:2] < best[:2] else best
        for r in ("user", "assistant"):
            if len(audit) < n + 3:
                walk(i, cost + 3, audit + "I", [*out, (r, "")])
        if i < n:
            role, text, fault = told[i]
            walk(i + 1, cost + 4, audit + "D", out)
            if fault in ("truncated", ""):
                more = 3 if fault else 0
                walk(i + 1, cost + more, audit + "K", [*out, (role, text)])
                for r in ("user", "assistant"):
                    walk(i + 1, cost + 3 + more, audit + "R", [*out, (r, text)])

    walk(0, 0, "", [])
    return best


def test_edits_are_the_cheapest_and_least(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for conv in range(150):
        own = [(rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["Yes.", "no", "", " \n", "Why?", "ok!", "end", f"t{rnd.randint(0, 9)}."])) for _ in range(rnd.randint(1, 5))]
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(own)]
        want[conv] = brute_repair(own)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: (r.cost, r.audit, r.repaired_sha256) for r in repair.summaries(df).collect()}
    assert got == {c: (cost, audit, hashlib.sha256(text.encode()).hexdigest()) for c, (cost, audit, text) in want.items()}
    turns = collections.defaultdict(list)
    for r in sorted(repair.repair(df).collect(), key=lambda r: (r.conv_id, r.place)):
        if r.edit != "D":
            turns[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: "\n".join(turns[c]) for c in want} == {c: text for c, (_, _, text) in want.items()}


def test_op13_sql_with_nulls_ties_gaps_and_lost_conversations(spark, tmp_path):
    rnd = random.Random(12)
    rows = [(rnd.choice([None, 1, 2, 3, 2**60 + 1]), rnd.choice([None, *range(30)]), rnd.choice([None, "user", "assistant", "system", "sam", "x"]), rnd.choice([None, "a.", "b", "c?", " ", "d!"]), "z") for _ in range(120)]
    rows += [(k, 0, "user", "only one.", "z") for k in range(100, 200)] + [(7, 2**40, "user", "far.", "z"), (7, -5, "assistant", "near.", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    names, want = sql_rows(con, repair.OP13_SQL)
    got = repair.op13_conversation_repair(spark, str(tmp_path)).select(names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(r.audit == "" and r.conv_id in range(100, 200) for r in got) and {r.conv_id for r in got} == {r[0] for r in rows}


def test_a_giant_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(6_000) if k != 3_001] + [(k, 0, "user", "q?") for k in range(2, 30)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
        got = {r.conv_id: r for r in repair.summaries(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[1].audit == "K" * 3_001 + "I" + "K" * 2_998 and (got[1].cost, got[1].gaps, got[1].illegal) == (3, 1, 1)
    assert got[2].audit == "KI" and len(got) == 29


def test_damage_follows_the_checksum(spark):
    df = spark.createDataFrame([(c, t, None if t == 3 else "system", "A. B! c" if t else None) for c in (5, None) for t in (*range(60), None)], "conv_id long, turn long, role string, text string")
    got = collections.Counter((r.conv_id, r.turn, r.role, r.text, r.present) for r in repair.damaged(df).collect())
    want = collections.Counter()
    for r in df.collect():
        kind = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        role, text = r.role or " ", r.text or " "
        text = {1: "", 2: text.replace(".", "").replace("!", "")}.get(kind, text)
        want[r.conv_id, r.turn, "user" if kind == 4 else role, text, kind != 0] += 2 if kind == 3 else 1
    assert got == want
    assert repair.damaged(df).filter(~F.col("present")).count() > 0


def test_phrases_wait_for_their_words_where_buckets_are_shared():
    # the bucket of "a b" reached the threshold before a, b and c did; "a b c" has to be counted in both shards all the same
    one = lambda w: np.array([phrases.xxhash.xxh64_intdigest(w, phrases.Known("x").seed)], dtype=np.uint64)
    table = np.full(1 << 16, phrases.NEVER, np.uint8)
    at = lambda c: int(c[0]) & (len(table) - 1)
    table[[at(one(w)) for w in (b"a", b"b", b"c")]] = 1
    table[[at(phrases.code(one(x), one(y))) for x, y in ((b"a", b"b"), (b"b", b"c"))]] = 0
    counted = []
    for step in range(2, 6):
        scan = phrases.Scan("x", table, step, 2, 3)
        rows = [r for b in itertools.chain(scan.add(b"a b c"), scan.flush()) for r in b.to_pylist()]
        counted.append(sum(r["n"] for r in rows if r["k"] == 3))
    assert counted == [0, 1, 1, 0]

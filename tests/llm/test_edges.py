"""Repeated rows, nulls, ties, clashing names and long texts through the operators and the pipeline's stages."""

import collections
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, lines, mixing, quality, sharding, simhash, tokens
from tidemark.llm.common import names_apart

DATA = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, _text string, _words int, _hash string, _token string, _shard string, size string, kept string"


def clashing(spark, rows):
    """documents with columns named like internal ones; rows of (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "x", s, len(t or ""), f"t{i}", 1, "h", "k", "s", "z", "q") for i, t, s in rows], CLASH)


def against_sql(spark, tmp_path, query, sql, rows, schema, name="documents"):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    got = query(spark, str(tmp_path))
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r)
    assert sorted(map(key, got.select(names).collect())) == sorted(map(key, found.fetchall()))
    return got


def test_op1_counts_repeated_rows_as_documents(spark, tmp_path):
    rows = [(7, "same line\nother")] * 12 + [(None, "null id\nx")] * 9 + [(None, "NULL ID \ny"), (1, None), (2, ""), (3, "same line"), (4, "a\na\na")] + [(5, "a")] * 8
    got = against_sql(spark, tmp_path, lines.op1_line_dedup, lines.OP1_SQL, rows, "doc_id long, text string")
    assert {r.n_dropped for r in got.collect() if r.doc_id == 7} == {2} and {r.n_dropped for r in got.collect() if r.doc_id == 4} == {0}


@pytest.mark.parametrize("partitions", [1, 7])
def test_op1_hot_lines_over_many_partitions(spark, partitions):
    rows = [(k % 50, f"hot\nline {k % 9}\nown {k}") for k in range(600)] + [(1, "twice\ntwice")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    counts = collections.Counter(line for _, t in rows for line in set(t.split("\n")))
    want = collections.Counter((i, "\n".join(x for x in t.split("\n") if counts[x] < 10)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.kept_text) for r in lines.dedup_lines(df).collect()) == want


def brute_components(prints):
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {frozenset(f for f in prints if find(f) == r) for r in map(find, prints)}


def linked(spark, prints):
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    pairs = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fingerprint long")).collect()]
    unsigned = lambda f: f % (1 << 64)
    assert all((unsigned(u) ^ unsigned(v)).bit_count() <= 2 for u, v in pairs) and len(set(pairs)) == len(pairs)
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for u, v in pairs:
        root[find(unsigned(u))] = find(unsigned(v))
    return {frozenset(f for f in prints if find(f) == r) for r in map(find, prints)}


def test_op2_links_agree_with_brute_force_in_crowded_cells_too(spark, monkeypatch):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(12)]
    near = [b ^ sum(1 << k for k in rnd.sample(range(64), n)) for b in base for n in (1, 2, 2, 2, 3, 4)]
    crowd = [base[0] ^ (1 << k) for k in range(64)] + [base[1] ^ (1 << k) ^ (1 << (k + 7) % 64) for k in range(60)]
    pair = [base[2] ^ (1 << 63) ^ 1, 0, 1 << 63, 3]
    prints = sorted({*base, *near, *crowd, *pair})
    want = brute_components(prints)
    assert linked(spark, prints) == want
    # candidates come from the grid: without the neighbouring cells pairs are lost
    monkeypatch.setattr(simhash, "nearby_cells", lambda cell: F.array(cell))
    assert linked(spark, prints) != want


def test_op3_sql_holds_with_groups_of_shards_and_ties(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, *range(60)]), " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(0, 30))), rnd.choice(["a", "a", "b", None])) for _ in range(500)]
    rows += [(1, "same words here", "b")] * 40 + [(2, None, "c"), (3, "", "c")]
    sql = mixing.OP3_SQL.replace("docs / 2000", "docs / 10").replace("shard // 1000", "shard // 4")
    made = lambda s, d: mixing.mix(s.read.parquet(f"{d}/documents.parquet"), docs_per_shard=10, shards_per_group=4).select("doc_id", "size", "source_size", "target", "taken")
    against_sql(spark, tmp_path, made, sql, rows, "doc_id long, text string, source string")


def test_op8_equal_rows_get_parts_that_fit(spark):
    rows = [(1, "x" * 50)] * 1000 + [(None, "y" * 30)] * 500 + [(k + 10, "z" * (k % 40)) for k in range(300)] + [(5000, "w" * 4000), (5001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hash", F.lit("mine")).repartition(6)
    got = sharding.shard(df, 1000).collect()
    held = collections.Counter()
    for r in got:
        held[r.shard] += r.n_bytes
    assert len(got) == len(rows) and all(n <= 1000 for s, n in held.items() if not s.endswith("-0") or n != 4000) and {r["_hash"] for r in got} == {"mine"}
    assert collections.Counter(r.part for r in got if r.doc_id == 1) == {k: 20 for k in range(50)}


def test_op7_chunks_of_long_texts(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdéß'9,") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (9_000, 30_000)] + ["a" * 40_000, "\n".join(["<|endoftext|>"] * 3_000)]
    content = tokens.tokenizer_content()
    whole = tokens.encoder(content)
    assert tokens.space_parts(whole, content)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, content).collect()}
    assert got == {k: len(whole.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)} and all(len(t) > tokens.CHUNK for t in texts)


def test_words_and_stretches_cover_a_text():
    rnd = random.Random(6)
    text = "".join(rnd.choice("aB9é,- \n") for _ in range(3_000)).encode()
    powers = decontaminate.Powers()
    whole = decontaminate.Words(text, powers)
    plain = text.translate(decontaminate.FOLD).decode().split()
    assert whole.listed(0, len(whole)) == plain
    hashes = {}
    for w, h in zip(plain, whole.hashes.tolist(), strict=True):
        assert hashes.setdefault(w, h) == h
    assert len(set(hashes.values())) == len(hashes)
    for piece in (1, 50, 700, 5_000):
        seen = []
        for ws, at, lo, hi in decontaminate.stretches(text, 10, 20, powers, piece):
            assert ws.listed(lo, hi) == plain[at + lo : at + hi] and lo >= min(10, at + lo) and (hi + 20 <= len(ws) or at + len(ws) == len(plain))
            seen += range(at + lo, at + hi)
        assert seen == list(range(len(plain)))
    assert list(decontaminate.stretches(b"", 1, 1, powers)) == []


def test_long_texts_through_the_native_operators(spark, tmp_path):
    long = " ".join(f"word{k % 5000}." for k in range(120_000))
    docs = [(1, long, "a"), (2, "short text of a few words that is long enough to stay.", "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert {r.doc_id: r.n_words for r in quality.clean(df).collect()} == {1: 120_000, 2: 12}
    assert {r.doc_id: r["size"] for r in mixing.mix(df).collect()} == {1: 120_000, 2: 12}
    turns = [(9, 0, "user", long), (9, 1, "assistant", long), (8, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op9_chat_formatting(spark, str(tmp_path)).collect()}
    assert got[9].loss_chars == len(long) and got[9].loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[8].n_turns == 1


def test_stages_keep_clashing_columns_and_defined_results(spark):
    good = [" ".join(f"{c}{k}" for k in range(40)) + "." for c in "abcdefgh"]
    rows = [(k, t, "one" if k % 2 else None) for k, t in enumerate(good)] + [(0, good[0], None), (None, good[1] + " more", "one"), (20, None, "one"), (21, "", None), (22, "too few", "one")]
    df = clashing(spark, rows)
    own = lambda out: {(r["_text"], r["_words"], r["_hash"], r["_token"], r["_shard"], r["size"], r["kept"]) for r in out.select(df.columns).collect()}
    whole = lambda out: {x[1:] for x in own(out)} == {(1, "h", "k", "s", "z", "q")}
    ids = lambda out: collections.Counter(r.doc_id for r in out.collect())
    one = quality.stage(spark, df, DATA)
    assert ids(one) == collections.Counter([*range(8), 0, None]) and one.columns == df.columns and whole(one)
    two = simhash.stage(spark, df, DATA)
    assert ids(two) == collections.Counter([*range(8), 20, 22]) and two.columns == df.columns and whole(two)  # 20: texts without words, the smallest id
    three = decontaminate.stage(spark, df, DATA)
    assert ids(three) == ids(df) and three.columns == df.columns and whole(three)
    four = mixing.stage(spark, df, DATA)
    assert four.columns == df.columns and whole(four) and max(ids(four).values()) <= 6 and not {20, 21} & set(ids(four))
    assert sorted(map(str, four.collect())) == sorted(map(str, mixing.stage(spark, df.repartition(5), DATA).collect()))
    five = sharding.stage(spark, df, DATA)
    assert five.count() == df.count() and whole(five)
    for stage in (quality, simhash, decontaminate, mixing, sharding):
        assert stage.stage(spark, df.limit(0), DATA).count() == 0


def test_names_come_back(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_a int, own_a int, b int")
    seen = []
    out = names_apart(lambda x: (seen.append(x.columns), x)[1])(df)
    assert out.columns == ["_a", "own_a", "b"] and "_a" not in seen[0] and tuple(out.first()) == (1, 2, 3)

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components, lines, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_fingerprint(text, k=3):
    w = WORD.findall(low(text))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    n = [0] * 64
    for x in sh:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for j in range(64):
            n[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * n[j] > len(sh))


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query_agrees_with_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    ids = sorted(docs)
    near = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = roots(ids, near)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, DATA).collect()}
    assert got == {i: (format(prints[i], "016x"), want[i]) for i in ids}


def test_links_find_all_pairs_within_two_bits(spark):
    rnd = random.Random(1)
    prints = set()
    for _ in range(60):
        base = rnd.getrandbits(64)
        prints.add(base)
        for _ in range(8):
            x = base
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)]
    got = {r.doc_id: r.component_id for r in simhash.grouped(spark.createDataFrame(signed, "doc_id long, fingerprint long")).collect()}
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert got == roots(range(len(prints)), near)


def test_simhash_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "one", "y"), (5, "ONE", "y"), (5, "ONE", "y"), (None, "one", "z"), (6, "w " * 300_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert collections.Counter(got) == collections.Counter([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (None, 4), (6, 6)])
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_pieces_do_not_change_the_hashes():
    text = ("Ab c dé " * 5000).encode()
    whole = np.concatenate(list(simhash.shingle_hashes(text, 5)))
    old, simhash.PIECE = simhash.PIECE, 101
    try:
        words = [w for part in simhash.pieces(text, 101) for w in part]
    finally:
        simhash.PIECE = old
    assert words == text.translate(simhash.LOWERED).split()
    assert len(whole) == len(words) - 4


def test_near_copies_agree_with_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    docs, i = [], 0
    for _ in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(60, 400))]
        docs.append((i, " ".join(base)))
        i += 1
        for _ in range(rnd.randint(0, 4)):
            copy = list(base)
            for _ in range(max(1, len(base) // rnd.choice([40, 50, 60, 100]))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            docs.append((i, " ".join(copy)))
            i += 1
    docs += [(i, docs[0][1]), (i + 1, ""), (i + 2, None), (i + 3, "short text")]
    sets = {d: {tuple(low(t).split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for d, t in docs}
    alike = [
        (a, b) for a in sets for b in sets if b < a and (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0) >= 0.8
    ]
    barely = [(a, b) for a, b in alike if sets[a] and len(sets[a] & sets[b]) <= 0.85 * len(sets[a] | sets[b])]
    assert barely
    got = {r.doc_id: (r.first_id, r.stays) for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: first for d, (first, _) in got.items()} == roots(sets, alike)
    assert all(stays == (first == d) for d, (first, stays) in got.items())


def test_near_copies_of_short_texts_miss_none(spark):
    rnd = random.Random(11)
    docs = []
    for _ in range(150):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(10, 40))]
        docs.append(base)
        for n in range(rnd.randint(1, 3)):
            docs.append(base + [f"x{rnd.randrange(3000)}" for _ in range(1 + n)])
    for _ in range(30):  # chains: each is like the next one only
        base = [f"y{rnd.randrange(3000)}" for _ in range(24)]
        docs += [base[n * 2 :] + [f"z{base[0]}{k}" for k in range(n * 2)] for n in range(6)]
    docs = list(enumerate(" ".join(d) for d in docs))
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in docs}
    alike = [(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert len(alike) > 150
    got = {r.doc_id: r.first_id for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == roots(sets, alike)


def test_common_shingles_do_not_change_which_prefixes_meet():
    rnd = random.Random(5)
    common = np.array(sorted(rnd.sample(range(1000), 300)), dtype=np.uint64)
    times = np.array([rnd.randint(4, 9) for _ in common])
    for _ in range(500):
        a = set(rnd.sample(range(1000), rnd.randint(1, 40)))
        b = set(list(a)[rnd.randint(0, 3) :]) | set(rnd.sample(range(1000), rnd.randint(0, 3)))
        if b and len(a & b) / len(a | b) >= 0.8:
            x, y = (simhash.prefix(np.array(sorted(s), dtype=np.uint64), 0.8, common, times) for s in (a, b))
            assert set(x.tolist()) & set(y.tolist())


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("least", [10, 3])
def test_lines_agree_with_brute_force(spark, least):
    rnd = random.Random(3)
    pick = lambda: rnd.choice(["hot", " Hot\t", f"warm{rnd.randrange(40)}", f"x{rnd.randrange(900)}", "", "É"])
    docs = [(i, "\n".join(pick() for _ in range(rnd.randint(0, 6)))) for i in range(400)] + [(None, None), (5000, "")]
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    seen = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    want = []
    for i, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (key(x) and len(seen[key(x)]) >= least)]
        want.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).repartition(5)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in lines.dedup_lines(df, least).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_lines_keep_first(spark):
    docs = [(i, f"same\nown{i}\nsame") for i in range(30)]
    left = collections.Counter(x for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), 2, True).collect() for x in r.kept_text.split("\n"))
    assert left["same"] == 1 and left["own3"] == 1


def test_near_copies_takes_simhashes_that_differ_in_two_bits(spark):
    # one refrain decides every bit of both, but of the distinct shingles they share few: far from a similarity of 0.8
    refrain = "over the hills and far away we " * 200
    own = lambda x: " ".join(f"{x}{k}" for k in range(60))
    docs = [(1, refrain + own("p")), (2, refrain + own("q")), (3, own("r") + " " + own("s")), (4, " ".join(f"t{k}" for k in range(90)))]
    a, b = (simhash.shingle_set(t.encode(), 5) for _, t in docs[:2])
    far = bin((simhash.simhash(docs[0][1].encode(), 5) ^ simhash.simhash(docs[1][1].encode(), 5)) & (2**64 - 1)).count("1")
    assert simhash.jaccard(a, b) < 0.2 and far <= 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.first_id for r in simhash.near_copies(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id for r in simhash.stage(spark, df, "").collect()} == {1, 3, 4}

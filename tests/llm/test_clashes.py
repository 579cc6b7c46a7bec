"""Columns named like those an operator makes, in other case of letters, and like its inner ones; spans; tables of two pipelines at once."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, common, decontaminate, html, lines, mixing, packing, phrases, quality, repair, sharding, simhash, tokens, urls

DATA = "/root/testdata/sf0.001"
INNER = ("how", "weight", "target_", "key", "node", "n", "h1", "d1", "code", "pos", "bits", "root", "k", "label", "entry", "docs", "rank", "seed")
MADE = {
    "lines": (lambda d: lines.dedup_lines(d), ("Kept_Text", "N_LINES", "Keep")),
    "simhash": (lambda d: simhash.near_duplicates(d, 3), ("FINGERPRINT", "Component_Id")),
    "mixing": (lambda d: mixing.mix(d), ("SIZE", "Source_Size", "TARGET", "Taken")),
    "decontaminate": (lambda d: decontaminate.decontaminate(d, d.sparkSession.createDataFrame([("i", "some item words")], "item_id string, text string")), ("Items", "SPANS", "N_Words")),
    "quality": (lambda d: quality.clean(d), ("KEPT", "N_words", "Lost")),
    "tokens": (lambda d: tokens.count_tokens(d, tokens.tokenizer_content()), ("N_Tokens", "N_BYTES")),
    "sharding": (lambda d: sharding.shard(d), ("Depth", "SHARD")),
    "packing": (lambda d: packing.pack(d, tokens.tokenizer_content(packing.TOKENIZER)), ("Piece", "OFFSET")),
}


def documents(spark, names):
    made = spark.createDataFrame([(k, f"some words of text number {k} that go on for a while.", "s") for k in range(12)], "doc_id long, text string, source string")
    return made.select("*", *(F.lit(f"mine {n}").alias(n) for n in (*names, *INNER, "_text", "_N")))


@pytest.mark.parametrize("name", sorted(MADE))
def test_new_columns_replace_those_of_other_case(spark, name):
    run, names = MADE[name]
    got = run(documents(spark, names))
    lowered = [c.lower() for c in got.columns]
    assert len(lowered) == len(set(lowered)) and {n.lower() for n in names} <= set(lowered)
    rows = got.collect()
    assert len(rows) == 12 and all(r[n] == f"mine {n}" for r in rows for n in (*INNER, "_text", "_N"))
    assert not any(str(r[n.lower()] if n.lower() in got.columns else "").startswith("mine") for r in rows for n in names)


@pytest.mark.parametrize("run, names", [(lambda p: urls.judge(p), ("Host", "VERDICT")), (lambda p: html.extract(p), ("Text", "N_Chars"))])
def test_pages_too(spark, run, names):
    pages = spark.createDataFrame([(k, f"http://h{k % 2}.org/{k}", f"<html><body><article><p>Text {k} of it.</p></article></body></html>") for k in range(6)], "page_id long, url string, html string")
    got = run(pages.select("*", *(F.lit(f"mine {n}").alias(n) for n in (*names, *INNER, "_host"))))
    rows = got.collect()
    assert len(rows) == 6 and all(r[n] == f"mine {n}" for r in rows for n in (*INNER, "_host")) and len({c.lower() for c in got.columns}) == len(got.columns)


@pytest.mark.parametrize("stage", [quality.stage, simhash.stage, decontaminate.stage, mixing.stage])
def test_stages_keep_columns_of_such_names(spark, stage):
    names = ("Size", "TAKEN", "Items", "Kept", "N_Words", "Fingerprint")
    docs = documents(spark, names)
    got = stage(spark, docs, DATA)
    assert got.columns == docs.columns and all(r[n] == f"mine {n}" for r in got.collect() for n in (*names, *INNER))


def test_turns_with_more_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "assistant", "yes.")], "conv_id long, turn long, role string, text string").select("*", *(F.lit("x").alias(n) for n in ("Audit", "fault", "_id", "given", "Formatted", "copy")))
    assert repair.summaries(turns).first().audit == "KK" and chat.format_chats(turns).count() == 1
    assert phrases.collocations(turns.withColumn("lang", F.lit("en")).withColumn("Rank", F.lit(1))).count() == 0


def test_spans_are_joined_in_time_that_follows_their_number(spark):
    rows = [("t", 10, 20), ("t", 0, 5), ("t", 5, 7), ("t", 8, 9), ("t", 12, 15), ("t", 20, 21), ("u", 3, 4), ("t", 0, 5)]
    df = spark.createDataFrame(rows, "t string, start long, end long")
    got = {r.t: [tuple(s) for s in r.spans] for r in decontaminate.joined_spans(df, ["t"]).collect()}
    assert got == {"t": [(0, 7), (8, 9), (10, 21)], "u": [(3, 4)]}
    took = []
    for n in (1_000, 20_000, 80_000):  # the first one starts the JVM's code
        began = time.time()
        apart = decontaminate.joined_spans(spark.range(n).select(F.lit("t").alias("t"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 2).alias("end")), ["t"])
        assert apart.select(F.size("spans").alias("n")).first().n == n
        took.append(time.time() - began)
    assert took[2] < 10 * took[1] + 1


def test_tables_of_two_callers_are_apart(spark):
    made, failed = {}, []

    def one(k):
        try:
            def make():
                first = common.stored(spark.range(50).withColumn("k", F.lit(k)), "first")
                time.sleep(0.5)
                return first.filter("id < 20")
            made[k] = common.settled(make, f"own{k}")
        except Exception as e:  # noqa: BLE001  told by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=one, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and all(made[k].count() == 20 and made[k].first().k == k for k in range(3))
    common.dropped(made[0])
    assert made[1].count() == 20

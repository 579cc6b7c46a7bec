"""Plans stay small: what is read twice is stored, so that no plan holds it twice and the driver's memory doesn't double with each step."""

import random

from pyspark.sql import functions as F

from tidemark.llm import components, mixing, simhash

#: Most exchanges in the plan of one query.
MOST = 10


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def watched(monkeypatch, *modules) -> list[int]:
    """Gets the exchanges of each table that the modules store."""
    seen = []
    for m in modules:

        def stored(df, name, *by, given=m.stored):
            seen.append(exchanges(df))
            return given(df, name, *by)

        monkeypatch.setattr(m, "stored", stored)
    return seen


def docs(spark):
    rng = random.Random(7)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(60)] for _ in range(12)]
    rows = []
    for k in range(60):
        words = list(base[k % 12])
        words[rng.randrange(60)] = f"w{k}"
        rows.append((k, " ".join(words), "xyz"[k % 3]))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing_plans(spark, monkeypatch):
    seen = watched(monkeypatch, mixing)
    made = mixing.repeated(docs(spark))
    assert made.count() and max([*seen, exchanges(made)]) <= MOST


def test_near_dedup_plans(spark, monkeypatch):
    seen = watched(monkeypatch, simhash, components)
    made = simhash.first_of_group(docs(spark))
    assert made.count() < 60 and len(seen) > 10 and max([*seen, exchanges(made)]) <= MOST


def test_components_of_a_long_path(spark, monkeypatch):
    seen = watched(monkeypatch, components)
    edges = spark.range(200).select((F.col("id") + 1).alias("u"), F.col("id").alias("v")).filter("v % 50 <> 49")
    found = {r.node: r.root for r in components.components(edges).collect()}
    assert found == {k: k // 50 * 50 for k in range(201) if k != 200}
    assert max(seen) <= 4

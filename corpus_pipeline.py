"""Corpus preparation from raw documents to shards, each stage one operator of tidemark.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, quality, sharding, simhash
from tidemark.llm.common import dropped, settled, table

STAGES = [
    ("quality rules", quality.stage),
    ("SimHash near-dedup", simhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", mixing.stage),
    ("sharding", sharding.stage),
]

#: SimHash and MD5 order of near copies can't be written in the checking engine's SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as a table that the next one reads. Only the last table stays."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        made = settled(lambda docs=docs, function=function: function(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            dropped(docs)
        docs = made
    return docs

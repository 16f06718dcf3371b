"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcgraph.llm import common, decontam, linededup, packing, simhash, toxicity

#: (name, function of (spark, docs, sf_dir)): toxic documents go; repeated lines go; one document of each near-duplicate
#: group stays; documents that hold benchmark items go; the rest is packed into training sequences.
STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", linededup.stage),
    ("simhash near-dedup", simhash.stage),
    ("benchmark decontamination", decontam.stage),
    ("best-fit packing", packing.stage),
]

#: Trained scores, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

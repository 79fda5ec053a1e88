"""The training-corpus pipeline: named stages, each over all that the one before kept."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leadloom.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity  # noqa: E402
from leadloom.session import staged  # noqa: E402


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier, learnt from ``labels``, rejects go."""
    return toxicity.drop(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark, docs, sf_dir):
    """One document of each group of equal texts stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of linked texts stays."""
    return jaccard_join.deduplicate(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents with a passage of ``benchmark`` go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark, docs, sf_dir):
    """Token sequences of power-of-two lengths."""
    return packing.pack(docs, special=True)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies),
          ("decontaminate", drop_contaminated), ("packing", pack)]

#: Neither the classifier nor the tokenizer can be said in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs

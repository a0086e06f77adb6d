"""The corpus pipeline: documents pass five stages, each stored and read again before the next.

The stages learn (toxicity) and count (mixing) as their operators do; a stage judges all that its
predecessor kept. The mixed corpus has the columns of documents, `copy` and `shuffle_key`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import mixing, simhash, suffix_dedup, toxicity, wu_manber
from tallyframe.llm.common import batch_settings
from tallyframe.session import checkpoint_dir


def _stage(fn):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        batch_settings(spark)
        return fn(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _stage(toxicity.clean_stage)),
    ("near_dedup", _stage(simhash.similar_stage)),
    ("repeat_dedup", _stage(suffix_dedup.cut_stage)),
    ("decontaminate", _stage(wu_manber.clean_stage)),
    ("mix", _stage(mixing.mix_stage)),
]

#: The learned and the suffix-array stages have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet under the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, fn) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        fn(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

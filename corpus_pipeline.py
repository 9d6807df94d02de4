"""A corpus pipeline of five stages: toxicity, quality, near-duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from colonnade.llm.queries import drop_low_quality, drop_near_copies, drop_toxic, mask_secrets, pack_documents
from colonnade.llm.sparkio import shared_dir

STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("packing", pack_documents),
]

#: SQL can't express the learned toxicity scores, nor packing; tests compare the near-dedup stage with a brute-force version and run the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{at}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

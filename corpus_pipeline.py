"""A corpus pipeline over ``documents``: language ID, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it lets pass, with the columns of ``docs``; the
last returns the pieces of the packed sequences.  ``run`` writes every stage's rows as Parquet to the shared folder
and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candor.llm import stages
from candor.llm.common import stored

STAGES = [
    ("language", stages.known_language),
    ("near_duplicates", stages.one_of_each_group),
    ("pii", stages.without_personal_data),
    ("mixing", stages.in_training_order),
    ("packing", stages.packed),
]

#: A trained network, span rewriting and tokenizers have no SQL form; tests/llm tests the operators by brute force and the stages one after the other.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

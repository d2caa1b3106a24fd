"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result
to the shared folder and reads it again as the next one's documents, so that a lost executor costs
no more than a stage, and each stage is planned on the sizes that the one before has left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwork.llm.byte_bpe import bpe_stage
from siftwork.llm.common import table, written
from siftwork.llm.line_dedup import line_dedup_stage
from siftwork.llm.mixing import mixing_stage
from siftwork.llm.near_dedup import near_dedup_stage
from siftwork.llm.quality import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("byte_bpe", bpe_stage),
]

#: Tokens of a vocabulary are beyond SQL; the tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

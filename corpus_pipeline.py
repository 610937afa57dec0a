"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Each stage works on all rows its predecessor kept and, but for the last, returns the columns of its
input.  Null and empty texts and those in no learned language are rejected by the first stage; later stages still accept them.
"""

from __future__ import annotations

from sparkseries.llm import queries as q
from sparkseries.llm.tables import written

STAGES = [
    ("language", q.keep_identified),
    ("toxicity", q.keep_civil),
    ("near_duplicates", q.keep_distinct),
    ("decontamination", q.keep_uncontaminated),
    ("bpe", q.tokenised),
]

#: The stages are trained models, signatures and a tokenizer: beyond SQL (tests hold the operators of the
#: stages against plain versions; the chain of stages has no test of its own).
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

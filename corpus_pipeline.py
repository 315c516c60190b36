"""The corpus pipeline: five stages over ``documents``, each one of the operators of ``planscope.llm``.

Every stage takes all rows that its predecessor kept: toxic documents go, common blocks of lines go from later
documents, of near duplicates the first stays, sources are mixed to their target weights (a row per copy taken),
and what is left is encoded. SQL can express neither the classifier nor the alignment nor the merges, so the stages
are tested against plain Python (tests/llm/test_pipeline.py).
"""

from __future__ import annotations

from planscope.llm.bpe import bpe_stage
from planscope.llm.common import checkpointed
from planscope.llm.line_dedup import line_dedup_stage
from planscope.llm.mixing import mix_stage
from planscope.llm.ngram_join import ngram_join_stage
from planscope.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("source_mix", mix_stage),
    ("bpe", bpe_stage),
]
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:  # each stage reads its input several times: it is written once
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

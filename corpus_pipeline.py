"""From documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``, and any others that its input has. ``run`` writes every
stage's result to the shared folder and reads it again as the next one's ``docs``; what a stage wrote
on its way is deleted then.

All stages take null and empty texts (no words, one end token), null doc_ids and sources, repeated
rows (each a row of its own until the copies go), very long texts, ties (decided by doc_id), columns
of any names and empty tables (an empty result).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import settled
from loomgraph.llm.exact_dedup import without_copies
from loomgraph.llm.jaccard_join import one_of_each
from loomgraph.llm.mixing import mixed_rows
from loomgraph.llm.packing import pack_documents
from loomgraph.llm.quality_crf import rows_of_quality

SEED = 7
#: Words that a worker remembers in the last stage: workers live on beside the other stages' memory.
REMEMBERED = 200_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-level random field finds good."""
    return rows_of_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest doc_id."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), that of the smallest doc_id."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets ask for."""
    return mixed_rows(docs, seed=SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), seed=SEED, remembered=REMEMBERED)


STAGES = [
    ("quality", quality),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("mix", mix),
    ("pack", pack),
]

#: The stages hold a trained model, a stream and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

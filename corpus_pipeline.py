"""Training-corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing to target weights, token files.

Every stage takes any columns besides doc_id, text, lang and source, of whatever names, and returns them as they are, but for the last.
Texts of any length are judged whole. An empty table gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codelode.llm import decontamination, mixing, simhash, token_files, toxicity
from codelode.llm.common import drop_materialized, materialize
from codelode.llm.queries import KEPT_SHARE, TARGETS

#: Bytes of words that a task of the last stage keeps: half of what it would by itself, as its processes have the earlier stages' memory too.
REMEMBERED = 32 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The model is fitted on this stage's own input, the documents of the run.

    Null and blank texts have the score of no words, equal texts equal scores, so all of a text's copies stay or go."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that of the smallest doc_id, once. Null and blank texts are one another's copies; rows
    without a doc_id stay all."""
    return simhash.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or are most of one, go. Null and blank texts hold none; repeated rows are judged each."""
    return decontamination.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that the tokens kept have the target shares by source, language and topic. Null and unlisted categories
    keep their own share; texts without words count no tokens; repeated rows are drawn together."""
    return mixing.sample(docs, TARGETS, KEPT_SHARE)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order, null ids first, and what reading them back gives. A null or empty text is the end id alone; repeated
    rows follow each other."""
    return token_files.token_digests(docs, public_tokenizers.path("word_bpe_49k.json"), REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]
#: A trained model, pairs within a Hamming radius and a tokenizer can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written as Parquet and read again, as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name)
        drop_materialized(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

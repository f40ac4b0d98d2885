"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing to target weights, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
the result of each as Parquet to the shared folder and gives the reread table to
the next.  Rows without an id or text pass through the stages as the operators
define it; an empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankwell.llm import toxicity as tox
from rankwell.llm.bpe import encode_documents
from rankwell.llm.common import documents, prepare, staged
from rankwell.llm.exact_dedup import keep_first_rows
from rankwell.llm.mixing import take_documents
from rankwell.llm.simhash import keep_representatives

#: Contract of the SimHash stage: words of a shingle and bits of a link.
SHINGLE, DISTANCE = 4, 4


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine trained on the labelled part of ``documents`` calls toxic go."""
    prepare(spark)
    return tox.keep_clean(docs, tox.trained(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for the case of A-Z, the one with the largest id stays."""
    prepare(spark)
    return keep_first_rows(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near fingerprints the document with the smallest id stays."""
    prepare(spark)
    return keep_representatives(docs, shingle=SHINGLE, distance=DISTANCE)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source has its target in words; one text per source is cut."""
    prepare(spark)
    return take_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every row."""
    import public_tokenizers

    prepare(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash", simhash), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: The toxicity, SimHash and BPE stages have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

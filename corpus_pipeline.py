"""A corpus pipeline over ``documents``: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.  The stages call the operators of ``foldwise.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldwise.llm.common import shared_folder, table
from foldwise.llm.pareto_mix import mix
from foldwise.llm.quality_rules import keep_quality
from foldwise.llm.queries import DICTIONARY, secret_model, tokenizer_path
from foldwise.llm.secret_forest import redact
from foldwise.llm.simhash_dedup import drop_near_duplicates
from foldwise.llm.vector_packing import pack_texts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_quality(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays (three-word shingles, two bits)."""
    return drop_near_duplicates(docs, shingle=3, distance=2)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return redact(docs, secret_model(docs), tokenizer_path(DICTIONARY), path_col="source")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens.  The memo is small, for workers that
    share an executor's memory with what the stages before have grown."""
    return pack_texts(docs, tokenizer_path(), end_id=1, memo_words=150_000)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", simhash_dedup), ("secret scans", secret_scan),
          ("mixing sources to target weights", mix_sources), ("packing", pack)]

#: the fingerprints, the forest and the tokenizer have no SQL; tests/llm hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "corpus-pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

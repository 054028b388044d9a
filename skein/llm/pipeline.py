"""A training-data pipeline: reject toxic documents, keep one of each near-duplicate group, drop
contaminated ones, mix the sources, and write token ids.

Each stage takes what its predecessor kept, as a table with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.decontaminate import without_contaminated
from skein.llm.jaccard_join import jaccard_components
from skein.llm.shared import stored, table
from skein.llm.source_mix import mix_sources
from skein.llm.token_files import token_file_digest
from skein.llm.toxicity import train, without_toxic

#: Near duplicates: words in a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Ids of duplicates that are broadcast at most (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Words that a worker remembers in the last stage, fewer than in the operator alone: the workers hold the other stages' memory too.
CACHE_WORDS = 400_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not reject; it learns from the labelled ones among docs."""
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component; rows without a doc_id stay."""
    found = jaccard_components(docs, SHINGLE, PERCENT)
    # a row goes if its component has a lesser doc_id; only the ids that go meet the texts again
    goes = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "goes")
    if goes.count() <= BROADCAST_IDS:
        goes = F.broadcast(goes)
    return docs.join(goes, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at equal weights, replicated and shuffled."""
    return mix_sources(docs).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and their digest."""
    return token_file_digest(docs, cache_words=CACHE_WORDS)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: The first and last stages can't be expressed in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

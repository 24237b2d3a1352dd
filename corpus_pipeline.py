"""Training-data pipeline: documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. A stage's result is written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm.common import ready, store, table
from vigil.llm.exact_dedup import deduplicate
from vigil.llm.mixing import mixed
from vigil.llm.ngram_join import one_per_group
from vigil.llm.packing import best_fit_packing
from vigil.llm.q_packing import vocabulary
from vigil.llm.quality_crf import accepted, train

LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF rejects (score below 0.3) go.

    A null or empty text is scored as a text without lines; without labels all
    rows stay; an empty table stays empty; rows repeated whole are scored alike.
    """
    ready(spark)
    return accepted(docs, train(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null texts count as empty, and empty texts as equal; null doc_ids are the
    smallest; of rows with one id and one text any one stays, with its columns.
    """
    ready(spark)
    return deduplicate(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Documents without words are in no group and all stay; a document with a null
    doc_id stays only where its whole group has none.
    """
    ready(spark)
    return one_per_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them.

    Null and empty texts have size 0 and are not taken; a null source is a
    source; of rows with one id and one text any one stands for all of them and
    has their copies.
    """
    ready(spark)
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens.

    A null or empty text is its end token; rows repeated whole, and documents
    taken twice, are packed as often as they stand there.
    """
    ready(spark)
    return best_fit_packing(docs, vocabulary())


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("mixing", mixing),
    ("packing", packing),
]

#: Trained scores, components and packings are not SQL; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = store(docs, f"stage-{name}")
    return docs

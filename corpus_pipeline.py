"""Documents to token ids in five stages, each written and read again as the next one's input.

Edge cases, alike in all stages: empty tables give empty tables; texts of any length are
read whole; extra columns, whatever their names, pass through the first four stages as
they are. A null or empty text is rejected by the first stage, as it has too few words;
given to a later one it is a class of its own, has no personal data, counts no words and
has no ids. Null ids, sources and languages are values like others. Rows that repeat are
one document for the second stage, and ties there go to the least id, null last; the
mixture draws by id, so rows of one id share their draw.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import mixing, ngram_join, pieces, pii, quality_rules
from tagmill.llm.common import shared_folder, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return quality_rules.passing(docs, quality_rules.learn_from(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return ngram_join.near_unique(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text gives way to the name of its kind; n_chars follows."""
    return pii.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected words meet the target shares of sources, languages and topics."""
    return mixing.sampled(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of each document."""
    return pieces.encoded(docs, pieces.model_bytes()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", rules), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixture", mixture), ("token ids", token_ids)]

#: Learning, similarity classes and segmentation have no SQL form; the tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

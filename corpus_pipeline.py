"""From raw documents to clean, tokenized ones, stage by stage; part of the subpackage ratelab.llm.

Every stage reads all that the one before it kept, applies one operator of ratelab.llm and, but for the last,
returns the columns of documents. Each result is written as Parquet and read again by the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratelab.llm import decontaminate, frames, simhash, surrogates, toxicity
from ratelab.llm.queries import bpe_digests


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of the classifier trained on the labels.

    Null and empty texts score like texts without n-grams; rows with a null id and repeated rows are scored each on
    its own and never learnt from without a label. All columns stay, clashing ones too; an empty table stays empty,
    and without labels of both kinds every score is their share.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.train(toxicity.labelled_sample(docs, labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Null, empty and blank texts share fingerprint zero, so one of them stays; equal rows, null ids included, leave
    one row, ties going to the smallest id. All columns stay; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which less than a twentieth of the words come from the benchmark.

    Null and empty texts have no words and stay, and so do repeated rows and null ids. All columns stay; an empty table
    stays empty, and an empty benchmark removes nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data.

    Null and empty texts stay as they are; repeated rows get the same surrogates. All columns stay; an empty table
    stays empty.
    """
    return surrogates.pseudonymize(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents: doc_id, n_tokens, ids_sha256 and decoded_sha256.

    Null and empty texts have no tokens; repeated rows and null ids each give a row; other columns stay out; an empty
    table gives an empty table.
    """
    return bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("byte_level_bpe", tokenize),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each over the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = frames.shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

"""The corpus pipeline: five stages over documents, each over all its predecessor kept.

Language ID drops documents without a letter or like no language learned; near
duplicates (five-word shingles, similarity 0.8) keep one document of each group;
personal data is replaced by the names of its kinds; sources are mixed to their
target weights, so documents may go or repeat; the last stage returns the token
ids of what is left.

Edge cases. Null, empty and blank texts hold no letter and go in the first stage.
Documents without a language or source are kept (a missing source is a source of its
own). Ids may repeat or be missing: near duplicates are told by their texts, and of a
group the row with the smallest id stays (a null id is the largest; of rows with the
same id and text one stays). Equal weights and ties are broken by hashes, so reruns
agree. Extra columns, whatever their names, come through all stages but the last. A
table without rows gives none. Texts of any length are whole in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import op1_language, op2_pii, op3_mixing, op5_sentencepiece, op9_minhash
from quarry.llm.common import prepare, shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_language.reject(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_minhash.keep_one(docs, width=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_pii.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_mixing.resample(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of every document."""
    out = op5_sentencepiece.encode(docs, keep=["doc_id", "source"])
    return out.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing", mixing),
    ("SentencePiece", encoding),
]

#: Kernels, tagger, rounding and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written as Parquet in the shared folder and read again.

    A stage's folder is deleted when the next one is written; the last one stays, as
    the result is read from it.
    """
    prepare(spark)
    root, own = shared_folder(spark), uuid.uuid4().hex
    docs, spent = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/pipeline-{own}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if spent:
            delete(spark, spent)
        spent = path
    return docs


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

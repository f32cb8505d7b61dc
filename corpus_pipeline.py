"""The corpus pipeline: toxic and poor documents go, one of each near-duplicate group stays,
secrets are masked, and what is left is packed into windows of tokens.

Every stage's rows are written as Parquet to the shared folder and read again by the next.
All stages take rows with any further columns, and keep them but for packing, whose rows are
pieces. Null and empty texts go through: they are neither toxic nor copies, hold no secret,
and pack as one end id, if the quality stage keeps them. Rows that are repeated stay so, and
empty tables give empty tables. Very long texts are read whole by every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, packing, quality, secrets, toxicity
from tidemark.llm.lineage import hand_back, shared_folder


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_back(spark)
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_back(spark)
    return quality.drop_poor(docs, _labels(spark, sf_dir))


#: The stage's own shingles and similarity; those of op5's contract bind only its query.
WORDS, PERCENT = 5, 80


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_back(spark)
    return jaccard.keep_one(docs, WORDS, PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_back(spark)
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hand_back(spark)
    import public_tokenizers

    return packing.pack(packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: Learned scores and differencing cannot be put in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows

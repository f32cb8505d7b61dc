"""Bounded samples of labelled documents, for the operators that learn from labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lineage import kept


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def signature(text: Column) -> Column:
    """The least hash of a text's three-word runs: alike for most near copies, so copies do not add up."""
    words = F.split(F.coalesce(text.cast("string"), F.lit("")), r"\s+")
    after = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    return F.array_min(F.zip_with(after, F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b)))


def sample_labelled(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, limit: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, text, label) of at most ``limit`` labelled documents, one of each signature and label.

    ``usable`` is a condition on the id in column ``id``. The sample is the same however
    rows are dealt: documents are taken in order of a hash of their id. Labels other than
    0 and 1 are left out; a document with both counts as 1. The sample's size is bounded by
    ``limit``, so its ids are broadcast.
    """
    wanted = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & usable)
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(limit)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(wanted), "id").withColumn("signature", signature(F.col("text")))
    # The least id of each signature and label stands for its copies.
    one = found.groupBy("signature", "label").agg(F.min_by(F.struct("id", "text"), F.struct("id", F.xxhash64("text"))).alias("doc"))
    return kept(one.select("doc.id", "doc.text", "label"))

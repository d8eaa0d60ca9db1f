"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

TRAIN_ROWS = 8000  # bound of every training sample


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Rows whose crc32(doc_id as text) mod ``modulus`` is ``remainder`` are
    never trained on. A null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int,
                  max_rows: int = TRAIN_ROWS) -> DataFrame:
    """``(text, y)`` of at most ``max_rows`` labelled documents outside the
    held-out part, the first in the order of a hash of doc_id. The sample of
    ids and labels is bounded by ``max_rows`` and is broadcast; conflicting
    labels of one document both count, null labels do not."""
    sample = (pick(labels, doc_id="doc_id", y=label).where("doc_id is not null and y is not null")
              .where(~held_out(F.col("doc_id"), modulus, remainder))
              .select(F.col("doc_id").cast("long"), F.col("y").cast("int")).distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows))
    src = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return src.join(F.broadcast(sample), "doc_id").select(
        "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "y")

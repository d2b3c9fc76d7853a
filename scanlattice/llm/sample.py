"""Bounded, repeatable samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, text_of


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label of at most ``most`` labelled documents, chosen by a hash of the id.

    ``train``: which ids may be used.  An id with several labels takes the largest, one with
    several rows the least of their texts; null ids and labels are left out.  The ids are at
    most ``most``, which bounds the broadcast, and so are the rows.
    """
    own = labels.where(named(id_col).isNotNull() & named(label).isNotNull() & train)
    own = own.groupBy(named(id_col).cast("long").alias("label_id")).agg(F.max(named(label).cast("int")).alias("label"))
    own = own.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    met = rows.join(F.broadcast(own), rows["doc_id"] == own["label_id"])
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

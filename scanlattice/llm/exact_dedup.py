"""Exact dedup by skew-safe combining.

1. *Local*: the map-side half of the first aggregation folds the copies within a task.
2. *Salted*: digest groups are merged per (digest, salt, whole text); the salt is the number
   of the task modulo ``salts``, so that no reducer gets more than its share of a hot text.
3. *Global*: the salt winners, at most ``salts`` rows a text, are merged per (digest, text).

The normalised text is part of every grouping key, so contents are compared in full at every
stage; the digest only deals the rows out.  The classes then meet the documents again in an
equi-join on the digest and the length, after which no two classes may share both: the query
fails rather than mix two texts.  The join's hot keys can be split, since nothing is gathered.

Defined results: a null text counts as empty, texts are equal when identical after
lower-casing A-Z.  The largest doc_id of a class stays; null ids lose to any other, and
rows that repeat the winning id all count as kept.  Empty tables give empty results.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii_bytes, named, rows_of, text_of

SALTS = 16


def _digests(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            texts = [lower_ascii_bytes(t) for t in batch.column(1).to_pylist()]
            out = {
                "doc_id": batch.column(0),
                "digest": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            }
            if with_text:
                out["norm"] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, digest, n_bytes and, if asked for, norm: the normalised text in UTF-8."""
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_digests(with_text), "doc_id long, digest binary, n_bytes long" + ", norm binary" * with_text)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: digest, n_bytes, keep_id, group_size."""
    local = digests(docs, id_col, text_col, with_text=True).withColumn("salt", F.spark_partition_id() % F.lit(salts))
    salted = local.groupBy("digest", "n_bytes", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    merged = salted.groupBy("digest", "n_bytes", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    # Dealt out as the join below needs it, so this adds no exchange to the query.
    alone = merged.groupBy("digest", "n_bytes").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    size = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a digest and a length")))
    return alone.select("digest", "n_bytes", "keep_id", size.cast("long").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    members = digests(docs, id_col, text_col)
    found = members.join(classes(docs, id_col, text_col, salts), ["digest", "n_bytes"])
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t"""

"""The corpus pipeline: documents to packed token sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next stage's ``docs``.

Defined results, by stage:

* ``quality_rules``: a null or empty text has no words and goes.
* ``quality_classifier``: fitted on the labelled rows that are left; without any, every score is
  the prior and all rows stay.
* ``line_dedup``: no row goes; rows that lose a line have their n_chars, if there is one, counted
  anew.  If all documents with a line have null ids, it stays in all of them.
* ``simhash``: of rows whose texts are near copies the smallest doc_id stays, once, whatever
  number of rows repeat it; rows with a null id stay and are copies of none.
* ``packing``: a null or empty text is one piece, its end token.

An empty table gives no rows at every stage.  All stages but the last return the columns of
``docs``, whatever else they are named, dots and names of the operators' own outputs included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlattice.llm import classifier, line_dedup, near_copies, packing, quality_rules, simhash
from scanlattice.llm.common import materialize, named, text_of, unused
from scanlattice.llm.queries import table, tokenizer_file


def good_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def good_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on those at hand, predicts to be good."""
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(classifier.scorer(model)(text_of()) >= classifier.THRESHOLD)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur; n_chars follows the text."""
    dropped = unused("_n_dropped", docs)
    left = line_dedup.dedup_lines(docs, count_col=dropped)
    n_chars = F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(named("n_chars")) if "n_chars" in docs.columns else None
    return left.select(*(n_chars.alias(c) if c == "n_chars" else named(c) for c in docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: by SimHash, checked and completed at a
    similarity of 0.8 or more of five-word shingles."""
    return simhash.keep_least(docs, near_copies.near_copies(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", good_by_rules),
    ("quality_classifier", good_by_classifier),
    ("line_dedup", without_boilerplate),
    ("simhash", one_of_near_copies),
    ("packing", packed),
]

#: SQL expresses neither the fitted models nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: quality rules, quality classifier, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
all but the last return the columns of ``docs``.

Defined results: null and empty texts fail the quality rules and go there. Without labelled
rows the classifier takes every document for a good one (score 0.5). Of rows that share a
set of shingles, or an id, one stays; rows with a null id are never linked and stay. Packing
gives a row for each piece, and none for an empty table. Texts of any length are judged,
compared and packed as a whole. Other columns of ``docs``, whatever their names, pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamline.llm import minhash_dedup, packing, quality_classifier, quality_rules
from loamline.llm.common import documents, labels, materialize
from loamline.llm.encoding import tokenizer_path


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules' threshold table."""
    return quality_rules.apply_rules(docs).filter("kept").select(*docs.columns)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows of ``documents``, takes for good ones."""
    known = labels(spark, sf_dir).select("doc_id", "quality")
    model = quality_classifier.fit_sample(documents(spark, sf_dir), known)
    return quality_classifier.score(docs, model).filter("predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at five words and 0.8."""
    return minhash_dedup.drop_near_duplicates(docs, width=5, percent=80).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All kept documents in sequences of 2048 ids."""
    return packing.pack(packing.encode_pieces(docs, tokenizer_path("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("minhash_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each on the Parquet that the one before it wrote."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: documents that fail quality rules or language identification go, one document of each class of
near duplicates stays, secrets are masked, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir), docs being what the stage before has kept, and all but the last return the
columns of docs, whatever their names.  Nulls, empty texts, repeated rows and empty tables have the results that each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import langid, ngram_join, packing, quality, secrets
from quillon.llm.common import materialise, read_table, ship


def aside(docs: DataFrame) -> DataFrame:
    """The text, and all other columns as one: no operator's result can meet a column of the same name."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("_all"), "text")


def back(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, out of rows set aside."""
    return kept.select("_all.*", "text").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep."""
    ship(spark)
    trees, bar = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return back(quality.judge(aside(docs), trees, bar, with_text=True).where("kept"), docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a distance under the floor; learned from the labelled ones among them."""
    ship(spark)
    model = langid.train(docs)
    return back(langid.identify(aside(docs), model, with_text=True).where("not rejected"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the least doc_id."""
    ship(spark)
    return ngram_join.drop_copies(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    ship(spark)
    return packing.pack(docs, packing.default_path(), ["doc_id"], with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: Trees, centroids, MinHash and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs

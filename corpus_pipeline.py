"""From documents to token ids: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns rows with the columns of docs; the
last returns token ids. `run` writes each result as a table before the next stage
reads it, so a lost executor never repeats more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlpit.llm import jaccard_join, mixing, pieces, quality_classifier, quality_rules
from marlpit.runtime import stage


def _packed(docs: DataFrame) -> DataFrame:
    """What operators read, and the whole row, so that no column of theirs meets one of docs."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_classifier.quality_scores(_packed(docs), labels, carry=("row",))
    return scored.filter("predicted = 1").select("row.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base and the likelihood ratio."""
    return quality_rules.quality_rules(_packed(docs), carry=("row",)).filter("kept").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each near-duplicate component.

    Repeated rows of an id are one document, the smallest row standing for all;
    rows without an id cannot be told apart by it and stay.
    """
    found = jaccard_join.near_duplicates(docs)
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    once = named.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.union(docs.filter("doc_id IS NULL"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources by weight, repeats as rows."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, compared with the original library's."""
    ids = pieces.encode(docs, pieces.read_model(), carry=("source",))
    return ids.select("doc_id", "source", "n_tokens", "ids", "round_trip", "parity")


STAGES = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("n-gram Jaccard join", one_of_each),
    ("mixing to target weights", mixed),
    ("SentencePiece encoding", encoded),
]

# SQL can express neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

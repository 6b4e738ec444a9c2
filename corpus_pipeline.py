"""A corpus pipeline of five stages; each takes what the one before has kept.

Language identification drops documents in no language, the toxicity chain drops toxic ones, near-deduplication keeps one
document of each group, personal data is replaced by its kind, and what is left is packed into sequences.

Every stage decides row by row: repeated rows and repeated or null ids are rows like others (near-deduplication keeps one of equal rows
with an id), null and empty texts have no language and go in the first stage, texts of any length are read whole, and further columns, whatever
their names, stay as they are.  Empty tables go through all stages as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import langid, neardup, packing, pii, toxicity
from voxtable.llm.common import settle, table, whole_row
from voxtable.llm.registry import ADDED, CATEGORIES, RANKS
from voxtable.runtime import ship


#: A document is in no language if none gets this share of its words, by their mean probability in the random field.
LEAST_SHARE = 1 / 3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or without text) go, and those whose best language has a score below ``LEAST_SHARE``.  Where no row is
    labelled nothing is known of any language, and all documents with a letter stay."""
    ship(spark)
    model = langid.train(docs)
    marked = langid.predict(docs, model, keep=True).where(F.col("n_words") > 0)
    return (marked.where(F.col("score") >= LEAST_SHARE) if model.langs else marked).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxic probability of a half or more go."""
    ship(spark)
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.predict(docs, chain, keep=True).where(F.col("p_toxic") < 0.5).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 over five-word shingles, one row stays: that with the smallest id (of equal ones, by text)."""
    ship(spark)
    return neardup.first_rows(docs, words=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; no document goes."""
    ship(spark)
    done = pii.redact(pii.find(docs.select("doc_id", "text", whole_row(docs).alias("whole")), keep=["whole"]))
    whole = F.col("row.whole")
    fields = {"text": F.when(whole.getField("text").isNotNull(), F.col("text")), "n_chars": F.length("text").cast("long")}
    return done.select(*[fields.get(c, whole.getField(c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document, in sequences of at most 1024."""
    ship(spark)
    return packing.pack(settle(packing.pieces(docs, RANKS, added=ADDED)))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs


#: Trained models, signatures and best fit have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None

"""From raw documents to packed sequences: toxicity, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm import mixing, packing, pii, simhash, toxicity
from lumisift.llm.common import discard, table, written

PIECES_KEPT = 100_000  # by a worker's encoder: fewer than packing alone keeps, as workers serve the other stages too


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is more likely above 0 than not go; null text counts as empty and stays, rows alike go together."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays.

    Rows that repeat an id stay or go together, as do all rows with a null id: they stay if any of them has a group of its own.
    """
    kept = simhash.near_duplicates(docs).where("kept or component_id is null").select("doc_id").distinct()
    return docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")), "left_semi")


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities and the terms that disclose them are replaced in the text, and n_chars, where there is one, follows; no document goes."""
    clean = pii.sanitised(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0)).cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sources below their weight are read again; every document, also of a null source, is read at least once."""
    return mixing.mix(docs, mixing.plan(docs)).drop("mixed")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 ids, null ids first; null text has its end id only."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), pieces=PIECES_KEPT)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("pii", sanitise),
    ("mixing", mix),
    ("packing", pack),
]
ORACLE_SQL = None  # the model, the fingerprints and the tokenizer are beyond SQL; tests/llm has brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each reading what the one before wrote; an empty table gives no pieces.

    Columns beside doc_id, text and source are carried along, whatever their names, up to the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

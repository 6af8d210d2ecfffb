"""A training-data pipeline over ``documents``, one operator a stage.

Each stage works on all that its predecessor kept.  All but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewalk.llm import langid, minhash, packing, secrets, toxicity
from gradewalk.llm.common import bounded_batches, cut, row_key, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _with_row(docs: DataFrame) -> DataFrame:
    """The columns that operators learn from, and the whole row as one column, so that no other name can clash."""
    return docs.select("doc_id", "text", *[c for c in ("lang",) if c in docs.columns], F.struct(*docs.columns).alias("_row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model marks as toxic go."""
    bounded_batches(spark, most_rows=2_000)  # whole rows pass through Python
    scored = toxicity.score_toxicity(_with_row(docs), table(spark, sf_dir, "labels"), row="_row")
    return scored.where("predicted = 0").select("_row.*")


#: Mean posterior that a document's best language needs; four languages have a quarter each by chance.
LEAST_POSTERIOR = 0.275


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = LEAST_POSTERIOR) -> DataFrame:
    """Documents without an identifiable language go: null texts, those without a letter, and those none of whose languages the model finds likelier than ``least``.

    Where no document has a language to learn from, nothing is known of any, and all stay.
    """
    if not langid.learnable(docs).limit(1).count():
        return docs
    bounded_batches(spark, most_rows=2_000)  # whole rows pass through Python
    labelled = langid.identify_language(_with_row(docs), row="_row")
    return labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id; rows of the same id and text are one document.

    Rows with a null id are in no class: only those with the same text as well are one.
    """
    gone = minhash.classified(docs).where(~F.col("kept")).select("doc_id", "key_hash").distinct()
    rows = row_key(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))).drop("text", "key_id")
    return rows.join(gone, ["doc_id", "key_hash"], "left_anti").dropDuplicates(["doc_id", "key_hash"]).select("_row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 1024 tokens."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: The models and the search can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Cleaning of a document table in five stages: quality, near-duplicates, benchmark items, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last
return the columns of `docs`. Rows of equal id share one decision. Nulls in any column, empty texts, repeated
rows and empty tables pass as the operators define it; a row without an id is never a near-duplicate or a leak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudspark.llm import bm25_wand, byte_bpe, quality_model, secrets, tensor_minhash
from fraudspark.llm.common import held_out
from fraudspark.llm.queries import PREDICTED_FROM, QUERIES, ready, table, vocabulary
from fraudspark.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject; it learns from the labels that op4 learns from."""
    weights = quality_model.train(docs, table(ready(spark), sf_dir, "labels").filter(~held_out("doc_id", 5, 0)))
    return quality_model.keep(docs, weights, PREDICTED_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, of five-word shingles in common at 80 % or more: that of the smallest id."""
    dropped = tensor_minhash.near_duplicates(docs, percent=80).filter("not kept").select("doc_id").distinct()
    return _without(docs, dropped)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    leaks = bm25_wand.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return _without(docs, leaks)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with its secrets replaced by a mark and `n_chars` counted again."""
    hidden = secrets.redact(docs, secrets.train(docs))
    return hidden.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every row."""
    return byte_bpe.encode(docs, vocabulary(ready(spark)))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
    ("hide_secrets", hide_secrets), ("token_ids", token_ids),
]

#: The classifier and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES["pipeline"] = run

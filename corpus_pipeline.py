"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, BPE.  Each stage works on all rows that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import bpe, exact_dedup, langid, mixing, simhash
from lexspark.llm.common import checkpoint_dir, fold, fresh, table
from lexspark.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised; those without a letter (null and empty texts too), and those that two languages fit equally, go.

    Every row is judged by its text alone, so repeated rows go or stay together.  All columns stay, whatever their names.  An empty table, or one
    without a label, recognises nothing.
    """
    model = langid.fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    (name,) = fresh(docs, "found_language")
    found = langid.predict(docs, model, out_col=name)
    return found.where(~F.col(f"{name}.rejected")).drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text, the one with the smallest id; a null text is an empty one, and of rows repeated whole one stays."""
    return exact_dedup.exact_dedup(docs, keep="smallest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8, verified), the one with the smallest id; null and empty texts are equal texts."""
    return simhash.keep_one(docs, words=5, radius=3, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the schedule's blocks read it, a partly read one included; one that is never read, or has no word, goes.  An empty table stays one."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row, with the columns that name it; a null text is an empty one, and repeated rows give a row each."""
    out = bpe.bpe_encode(docs, tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", F.size("bpe.ids").cast("long").alias("n_tokens"), F.col("bpe.ids").alias("ids"), F.col("bpe.decoded").alias("decoded"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mixed), ("bpe", tokens)]

#: SQL can't express language ID by compression, fingerprints or byte-pair encoding: tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read back for the next."""
    top = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs

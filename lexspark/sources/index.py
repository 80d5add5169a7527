"""A rule index that is refreshed book by book.

The index is a folder: ``rows=n`` holds the rule rows of the books that refresh n cut, ``manifest=n`` lists every book with the SHA-256 of its text and the
refresh that cut it.  The manifest is written last and decides what counts, so an interrupted refresh leaves the index as it was, and one that is run
again overwrites what it had written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators.rulebook import rule_chunks
from lexspark.operators.segment import lines
from lexspark.sources.shared import cut, numbered_folders, remove, shuffled


def cut_books(books: DataFrame) -> DataFrame:
    """Rule rows of (book, text)."""
    return rule_chunks(lines(books.select(F.col("book").alias("doc_id"), "text"))).withColumnRenamed("doc_id", "book")


def latest(spark: SparkSession, path: str) -> int:
    """Number of the last complete refresh, -1 if there is none."""
    return max(numbered_folders(spark, path, "manifest"), default=-1)


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(book, digest, cut_by, titled) of the index as it stands."""
    n = latest(spark, path)
    return None if n < 0 else spark.read.parquet(f"{path}/manifest={n}")


def refresh(books: DataFrame, path: str, force: bool = False, rows_of: Callable[[DataFrame], DataFrame] = cut_books) -> int:
    """Bring the index at ``path`` up to date with ``books`` (book, text) and return the refresh's number.

    Only books whose text is new or changed are cut; those that are gone leave the manifest; the rows of all others stay as they were
    written.  All books are cut anew with ``force``, or where no rule of the index has a title (an index of no use).  A null text is an empty book.  Of books
    of one name the one with the smallest text's digest counts.
    """
    spark = books.sparkSession
    named = books.select("book", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    now = cut(named.groupBy("book").agg(F.min("digest").alias("digest")))  # texts are read once more, for what is due
    old = manifest(spark, path)
    usable = old is not None and not force and not old.where("titled").isEmpty()
    n = latest(spark, path) + 1
    due = now if not usable else cut(now.join(shuffled(old.select("book", "digest")), ["book", "digest"], "left_anti"))
    # one shuffle by book serves the join, the repeats and the cutting
    fresh = named.join(shuffled(due.withColumnRenamed("digest", "_due")), "book").where("digest = _due").dropDuplicates(["book"])
    rows_of(fresh.select("book", "text")).write.mode("overwrite").parquet(f"{path}/rows={n}")
    titled = spark.read.parquet(f"{path}/rows={n}").groupBy("book").agg(F.bool_or(T.strip(F.col("title")) != "").alias("titled"))
    cut_now = due.join(shuffled(titled), "book", "left").select("book", "digest", F.lit(n).alias("cut_by"), F.coalesce("titled", F.lit(False)).alias("titled"))
    kept = old.join(shuffled(now), ["book", "digest"], "left_semi").select("book", "digest", "cut_by", "titled") if usable else None
    (cut_now if kept is None else cut_now.unionByName(kept)).write.mode("overwrite").parquet(f"{path}/manifest={n}")
    return n


def load(spark: SparkSession, path: str) -> DataFrame:
    """Rule rows of all books of the index, with ``cut_by``, the refresh that cut them."""
    held = manifest(spark, path)
    if held is None:
        raise FileNotFoundError(f"no index at {path}")
    used = [r[0] for r in held.select("cut_by").distinct().collect()]  # one a refresh
    parts = spark.read.option("basePath", path).parquet(*[f"{path}/rows={n}" for n in used] or [f"{path}/rows={latest(spark, path)}"])
    return parts.withColumnRenamed("rows", "cut_by").join(shuffled(held.select("book", "cut_by")), ["book", "cut_by"], "left_semi")


def tidy(spark: SparkSession, path: str) -> None:
    """Remove manifests that are not the last and rows that no book of the last one is read from."""
    used = {r[0] for r in manifest(spark, path).select("cut_by").distinct().collect()}
    for n in numbered_folders(spark, path, "rows"):
        if n not in used:
            remove(spark, f"{path}/rows={n}")
    for n in numbered_folders(spark, path, "manifest")[:-1]:
        remove(spark, f"{path}/manifest={n}")

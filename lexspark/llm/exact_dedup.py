"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Every row gets the SHA-256 of its text and a run number from a hash of its id.  A *run* is the set
of distinct digests of its rows, each with the identifier that stays and a count.  Runs are merged
``fan_in`` at a time: in round r, run i goes to run ``i >> bits`` (the binomial exchange with
2**bits-way nodes); each node sorts what it received by digest and walks it once, keeping one
entry a digest.  After the last round one logical run holds every digest once.  It is never in one
task: every exchange deals entries by (run, digest).

A digest that a third of all rows share has one entry a run after the first step, and at most
``fan_in`` entries a merge, so no task sees the group.  On the way back documents meet their own
run's entry, which deals the hot group over all runs.

Equality is decided by SHA-256 together with the byte length and an independent 64-bit hash, which are part of the key at every
level: an entry is merged only with one that agrees in all three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import cut, fresh

KEY = ("_digest", "_check")


def runs_of(docs: DataFrame, id_col: str, text_col: str, bits: int, levels: int) -> DataFrame:
    """Rows with their digest, the check value and the run they start in; the text is dropped."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.unhex(F.sha2(text, 256)).alias("_digest"),
        F.xxhash64(text, F.octet_length(text)).alias("_check"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit("run")), F.lit(1 << (bits * levels))).cast("int").alias("_run"),
    )


def merge(entries: DataFrame, bits: int, keep: str) -> DataFrame:
    """One round: 2**bits runs meet in their parent, sorted by digest, and leave one entry a digest."""
    order = F.col("_keep").desc_nulls_last() if keep == "largest" else F.col("_keep").asc_nulls_last()
    run = Window.partitionBy("_run", *KEY)
    up = entries.withColumn("_run", F.shiftright("_run", bits))
    up = up.withColumn("_n", F.sum("_n").over(run)).withColumn("_first", F.row_number().over(run.orderBy(order)))
    return up.where("_first = 1").drop("_first")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", bits: int = 4, levels: int = 2) -> DataFrame:
    """One row a document: ``id_col, keep_id, group_size, kept, text_sha256`` and ``__same``, the number
    of rows with the same id and text.

    ``keep`` says which identifier of equal texts stays, ``smallest`` or ``largest``.  A null text
    counts as empty; a null identifier is one like any other but stays only when the group has no
    other.  Rows repeated with the same id and text are returned each, count each in
    ``group_size``, and exactly one of them is kept.  Other columns are ignored.  An empty table gives an empty
    result.
    """
    best = F.max("_id") if keep == "largest" else F.min("_id")
    rows = cut(runs_of(docs, id_col, text_col, bits, levels))  # digests only: the texts are read once
    entries = rows.groupBy("_run", *KEY).agg(best.alias("_keep"), F.count(F.lit(1)).alias("_n"))
    root = entries
    for _ in range(levels):
        root = merge(root, bits, keep)
    root = root.select(*KEY, F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"))
    down = entries.select("_run", *KEY).join(root, list(KEY))
    found = rows.join(down, ["_run", *KEY])
    again = Window.partitionBy("_run", *KEY, "_id").orderBy(F.lit(1))
    return found.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(again) == 1)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
        F.count(F.lit(1)).over(again.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__same"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", bits: int = 4, levels: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns, whatever their names: one row of each distinct text."""
    stay, sha, same = fresh(docs, "stay_id", "stay_sha", "same")
    groups = exact_groups(docs, id_col, text_col, keep, bits, levels).where("kept").select(F.col(id_col).alias(stay), F.col("text_sha256").alias(sha), F.col("__same").alias(same))
    met = F.col(id_col).eqNullSafe(F.col(stay)) & (F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) == F.col(sha))
    # both branches read the one shuffle of the texts; only rows that are repeated whole pass the second
    once = docs.join(groups.where(F.col(same) == 1).hint("shuffle_hash"), met, "left_semi")
    more = docs.join(groups.where(F.col(same) > 1).hint("shuffle_hash"), met, "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(more)

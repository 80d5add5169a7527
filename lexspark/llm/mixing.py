"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

1.  Each source's documents are put in a fixed shuffled order (SHA-256 of seed and id) and laid
    end to end on a line of words.  The order is cut by its first hex digits into 4096 buckets, so that
    positions need only a running sum inside a bucket plus the bucket's offset: no task holds a source.
2.  The line is cut into blocks of equal size (to within the rounding of a word).  It is read in a circle, so a source that is
    used up starts again from its first block.
3.  The schedule has 2**k slots; slot i takes the i-th van der Corput point (its bits in reverse), or the golden-ratio point
    frac((i + 1) * golden ratio), which is mapped through the sources' cumulative shares of the blocks to a source.  The
    j-th slot of a source reads its j-th block, whole.  Ranks are counted per (source, run of 4096 slots) plus the run's offset.
4.  What a source's slots read is what the mix takes: nothing cuts it but the limit of ``most`` times its size.

A source has as many blocks as its target holds common blocks, at least ``least`` (or one a word), so that a small source comes near its
target too; its share of the slots is its share of the blocks.  Of 2**k van der Corput points an interval holds its due to within one,
so a source is within one of its own blocks of its target, and any prefix of the schedule keeps to the weights.

Targets: the sources weigh 1, 2, 3, 1, 2, 3 ... by code point with null last, and share ``share``
of all words; a source stops at ``most`` times its own size and the excess goes to the others by
weight (water-filling, in closed form over the sources sorted by size per weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import cut

GOLDEN = 0.6180339887498949
BUCKET_DIGITS = 3
RUN = 4096
CELLS = 1 << 14


def word_count(text):
    """Number of runs of characters other than space and \\x09-\\x0D; null is 0."""
    held = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(held == "", F.lit(0)).otherwise(F.size(F.split(held, "[ \\x09-\\x0D]+"))).cast("long")


def _by_name():
    return Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))


def targets(sizes: DataFrame, share: float, most: int) -> DataFrame:
    """(source, source_size) -> also weight and target.  One row a source throughout."""
    w = sizes.withColumn("weight", (F.row_number().over(_by_name()) - 1) % 3 + 1)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    w = w.withColumn("_level", level)
    free = F.col("_level") * F.col("weight") < F.lit(float(most)) * F.col("source_size")
    w = w.withColumn("_level", F.min(F.when(free, F.struct(F.col("source_size") / F.col("weight"), F.col("_level").alias("v")))).over(everything)["v"])
    cap = F.lit(float(most)) * F.col("source_size")
    return w.withColumn("target", F.least(cap, F.coalesce(F.col("_level") * F.col("weight"), cap))).drop("_level")


def blocks(plan: DataFrame, slots_per_root: int, least: int) -> DataFrame:
    """``plan`` (source, source_size, target) with the slots' number, each source's interval [lo, hi) and the words of its blocks.

    The common block grows as the square root of all words, so blocks get longer and shares truer as the corpus grows.
    """
    everything = Window.partitionBy()
    common = F.greatest(F.lit(1.0), F.ceil(F.sqrt(F.sum("target").over(everything)) / F.lit(slots_per_root)))
    due = F.greatest(F.col("target") / common, F.least(F.col("target"), F.lit(float(least))))
    plan = plan.withColumn("_due", due)
    plan = plan.withColumn("_all", F.sum("_due").over(everything)).withColumn("_hi", F.sum("_due").over(_by_name()))
    plan = plan.withColumn("slots", F.when(F.col("_all") > 0, F.pow(F.lit(2.0), F.ceil(F.log2("_all")))).otherwise(0.0))
    last = F.row_number().over(_by_name()) == F.count(F.lit(1)).over(everything)
    return plan.select(
        *[c for c in plan.columns if not c.startswith("_") and c != "slots"],
        F.col("slots").cast("long").alias("slots"),
        ((F.col("_hi") - F.col("_due")) / F.col("_all")).alias("lo"),
        F.when(last, 2.0).otherwise(F.col("_hi") / F.col("_all")).alias("hi"),
        F.when(F.col("_due") > 0, F.col("target") / (F.col("_due") / F.col("_all") * F.col("slots"))).otherwise(0.0).alias("block_words"),
    )


def point(slot: Column, slots: int, kind: str) -> Column:
    """Where slot i of 2**k looks: van der Corput (``corput``: its k bits in reverse) or golden ratio (``golden``)."""
    if kind == "golden":
        return (slot + 1) * F.lit(GOLDEN) % 1.0
    bits = slots.bit_length() - 1
    return F.conv(F.reverse(F.lpad(F.bin(slot), bits, "0")), 2, 10).cast("double") / slots if bits else F.lit(0.0)


def schedule(plan: DataFrame, kind: str = "corput") -> DataFrame:
    """(slot, source, rank): the order in which blocks are read; ``plan`` is that of :func:`blocks`."""
    n = plan.agg(F.max("slots")).first()[0] or 0  # one number for the whole corpus
    points = plan.sparkSession.range(n).select(F.col("id").alias("slot"), point(F.col("id"), n, kind).alias("_u"))
    # a range join by equal cells: an interval has a row for each cell that it meets, a point looks into its own cell
    edges = plan.where("block_words > 0").select("source", "lo", "hi")
    cells = edges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.least(F.col("hi"), F.lit(1.0)) * CELLS))))
    hit = points.withColumn("_cell", F.floor(F.col("_u") * CELLS)).join(cells, "_cell").where((F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi")))
    hit = hit.select("slot", "source", F.floor(F.col("slot") / RUN).alias("_part"))
    per = hit.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    off = per.withColumn("_off", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    off = off.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), "_off")
    ranked = hit.join(off, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    rank = F.col("_off") + F.row_number().over(Window.partitionBy("source", "_part").orderBy("slot")) - 1
    return ranked.select("slot", "source", rank.alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.0, most: int = 3, slots_per_root: int = 8, least: int = 64, seed: str = "mix", kind: str = "corput") -> DataFrame:
    """One row a document: ``id_col, source, size, source_size, target, taken, first_slot``.

    ``taken`` is the number of the document's words that the schedule's blocks hold, repeats counted, at
    most ``most`` times ``size``; ``first_slot`` is the slot that reads its first word, null where none does, so documents
    in its order are in the order of the mix.  A null text has size 0 and takes 0; a null source is a source of
    its own, last in order; a source without words has target 0.  Repeated rows are laid on the line
    one after the other.  An empty table gives an empty result.
    """
    laid = lay(docs, id_col, text_col, source_col, share, most, slots_per_root, least, seed)
    order = cut(schedule(laid.plan, kind))
    count = order.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_slots"))
    got = laid.plan.join(count, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    read = F.least(F.floor(F.coalesce("_slots", F.lit(0)) * F.col("block_words")), F.lit(most) * F.col("source_size"))
    got = got.select(F.col("source").alias("_s"), "source_size", "target", "block_words", read.cast("long").alias("_read"))
    offs = laid.buckets.join(got, F.col("source").eqNullSafe(F.col("_s"))).drop("source").withColumnRenamed("_bucket", "_b")
    # documents meet their bucket's offset: a source of any size is dealt over its 4096 buckets
    near = laid.rows.join(offs, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    line = Window.partitionBy("source", "_bucket").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_at", F.col("_off") + F.coalesce(F.sum("size").over(line), F.lit(0)))
    laps = F.when(F.col("source_size") > 0, F.floor(F.col("_read") / F.col("source_size"))).otherwise(F.lit(0))
    near = near.withColumn("_laps", laps).withColumn("_rest", F.col("_read") - F.col("_laps") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("_rest") - F.col("_at"), F.col("size")))
    near = near.withColumn("taken", (F.col("_laps") * F.col("size") + part).cast("long"))
    # block j holds the words below (j + 1) * block_words, so a document's first word lies in this one
    near = near.withColumn("_rank", F.when(F.col("taken") > 0, F.ceil((F.col("_at") + 1) / F.col("block_words")) - 1))
    slots = order.select(F.col("source").alias("_s"), F.col("rank").alias("_r"), F.col("slot").alias("first_slot"))
    near = near.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_rank") == F.col("_r")), "left")
    return near.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "taken", "first_slot")


class lay:
    """The word line of every source: rows, buckets with offsets, and the plan (sizes, targets, blocks)."""

    def __init__(self, docs, id_col, text_col, source_col, share, most, slots_per_root, least, seed):
        key = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
        rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.substring(key, 1, 16).alias("_key")).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
        self.rows = cut(rows)  # ids and sizes only; the texts are read once
        per = self.rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
        before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        self.buckets = per.withColumn("_off", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words")
        self.plan = cut(blocks(targets(per.groupBy("source").agg(F.sum("_words").alias("source_size")), share, most), slots_per_root, least))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.0, most: int = 3) -> DataFrame:
    """``docs`` with each row as often as :func:`mix` reads it: whole laps, and once more if a lap ends inside it.

    Rows that the mix does not reach go, as do rows without words.  Ids are taken to name rows; rows that repeat an id and a size are
    read alike.  Other columns may have any names.
    """
    taken = mix(docs, id_col, text_col, source_col, share, most).where("taken > 0")
    times = taken.select(F.col(id_col).alias("id"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times")).groupBy("id").agg(F.max("times").alias("times"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(times.hint("shuffle_hash"), F.col(f"row.`{id_col}`").eqNullSafe(F.col("id")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

"""Prefix trie of rebuilt conversations by whole-sequence collapse, in DataFrame operations but for one hash that must be fed in order.

1.  A conversation is rebuilt from the head of another one and its own tail; a turn is known by the SHA-256 of its role and text.
2.  *Fingerprints.*  Turn i of a rebuilt conversation gives two 64-bit hashes of (i, role, text).  A prefix is known by its depth and the XOR of its
    turns' hashes, which partial aggregation and running windows can both compute: 128 bits beside the depth.
3.  *Collapse.*  Rebuilt conversations with the same full fingerprint become one sequence with a weight, a smallest member and a list
    of ends.  A thousand copies cost one sequence from here on.
4.  *Prefixes.*  Only the smallest member's turns of each sequence are spread into prefixes; grouping them gives the nodes and the sum of
    weights.  Sequences that are a proper prefix of another one are dropped by anti-join; what is left are the leaves.
5.  *Subtree sums without a walk.*  Every node belongs to the sequence of its smallest member.  On a sequence's path its own nodes are the last
    ones, since members only leave on the way down.  So a node's subtree sum is what all sequences through it own, less what
    its owner owns above it: one weighted grouping of prefixes and one running sum, linear in the turns.

Running sums go over pieces of ``PIECE`` turns plus the pieces' offsets, so that one conversation that holds a large part of all rows is
dealt over many tasks.  Lists of ends are joined in blocks of 4096 ids before they meet; the digest of a node's list is fed block by
block and never holds the list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import cut, meet

PIECE = 1024
NODE = ("depth", "k1", "k2")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, digest, bytes) of the original turns, in order of turn (null first), then role and text.

    Ranks are counted inside runs of ``PIECE`` turn numbers and moved on by what the runs before hold.
    """
    t = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    t = t.withColumn("run", F.floor(F.col("turn") / PIECE).cast("long"))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text")))
    t = cut(
        t.select(
            "conv_id",
            "run",
            "rank",
            F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).alias("digest"),
            F.octet_length("text").cast("long").alias("bytes"),
        )
    )
    runs = t.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", F.coalesce("run", F.lit(-(1 << 62))).alias("run"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    moved = t.withColumn("run", F.coalesce("run", F.lit(-(1 << 62)))).join(runs, ["conv_id", "run"])
    return moved.select("conv_id", (F.col("rank") - 1 + F.col("offset")).alias("pos"), "digest", "bytes")


def head_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, h1, h2, bytes), (conv_id)): the turns of every rebuilt conversation, and all conversations, those without a turn included."""
    own = cut(numbered(turns))
    convs = cut(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    n = convs.count()
    base = F.col("conv_id") - F.col("conv_id") % 5
    wanted = convs.select(F.col("conv_id").alias("c"), base.alias("conv_id"), head_turns(F.col("conv_id")).alias("h"))
    # at most eight turns of a base, to at most nine conversations around it
    heads = own.where("pos < 8 and conv_id % 5 = 0").join(wanted, "conv_id").where("pos < h").select(F.col("c").alias("conv_id"), "pos", "digest", "bytes")
    short = wanted.join(convs, "conv_id", "left").select(F.col("c").alias("conv_id"), F.greatest(F.lit(0), F.col("h") - F.coalesce("n", F.lit(0))).alias("less"))
    tails = meet(own.where(F.col("pos") >= head_turns(F.col("conv_id"))), short.where("less > 0"), ["conv_id"], n, "left")
    tails = tails.select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "digest", "bytes")
    both = heads.unionByName(tails)
    return cut(both.select("conv_id", "pos", *(F.xxhash64(F.lit(f"turn {i}"), "digest", "pos").alias(f"h{i}") for i in (1, 2)), "bytes")), convs.select("conv_id")


def running(rows: DataFrame, key: str, at: str, exclusive: bool, **sums: Column) -> DataFrame:
    """``rows`` with running aggregates over ``at`` inside ``key``; each of ``sums`` is a pair (aggregate, how two of its values join)."""
    piece = F.floor(F.col(at) / PIECE)
    rows = rows.withColumn("_piece", piece)
    inside = Window.partitionBy(key, "_piece").orderBy(at).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    for name, (agg, _, _) in sums.items():
        rows = rows.withColumn(name, agg.over(inside))
    # only keys longer than a piece have anything before a piece
    totals = rows.groupBy(key, "_piece").agg(*(agg.alias(f"_t_{name}") for name, (agg, _, _) in sums.items()))
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_piece", *(over(F.col(f"_t_{name}")).over(before).alias(f"_o_{name}") for name, (_, over, _) in sums.items()))
    rows = rows.join(offsets.where("_piece > 0"), [key, "_piece"], "left")
    for name, (_, _, join) in sums.items():
        rows = rows.withColumn(name, join(F.coalesce(name, F.lit(0)), F.coalesce(f"_o_{name}", F.lit(0))))
    return rows.drop("_piece", *(f"_o_{name}" for name in sums))


def xor(col: str):
    return (F.bit_xor(col), F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def _feed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of lists that arrive block by block in order."""
    held, digest = None, None
    for part in parts:
        out = []
        for key, ids in zip(zip(part["depth"], part["k1"], part["k2"]), part["ids"]):
            if key != held:
                if held is not None:
                    out.append((*held, digest.hexdigest()))
                held, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
    if held is not None:
        yield pd.DataFrame([(*held, digest.hexdigest())], columns=[*NODE, "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) from one row (depth, k1, k2, conv_id) a conversation."""
    blocks = members.groupBy(*NODE, F.shiftright("conv_id", 12).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select(*NODE, "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInPandas(_feed, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """One row a distinct prefix of the rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns`` has conv_id, turn, role and text; other columns are ignored, whatever their names.  A null role or text is empty, a null turn comes
    first, and turns of the same number are ordered by role and text (code points); a row that is repeated whole is a turn
    each time.  Rows without a conv_id belong to no conversation and are left out.  A conversation whose rebuilt form has no turn ends at
    the root.  An empty table gives an empty result, without a root.  ``saved_tokens`` counts UTF-8 bytes.
    """
    rows, convs = rebuilt(turns)
    full = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("h1").alias("k1"), F.bit_xor("h2").alias("k2"))
    members = convs.join(full, "conv_id", "left").select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in NODE))
    members = cut(members)
    # whole sequences: weight, smallest member, and (below) the list of ends
    seqs = cut(members.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    ends_of = ends(members)

    n = seqs.count()
    turns_of = meet(rows, seqs.select(F.col("rep").alias("conv_id"), "weight", F.col("depth").alias("length")), ["conv_id"], n)
    path = running(turns_of, "conv_id", "pos", False, k1=xor("h1"), k2=xor("h2"))
    path = path.select(
        F.col("conv_id").alias("rep"), "weight", (F.col("pos") + 1).alias("depth"), "k1", "k2", "bytes", (F.col("pos") + 1 < F.col("length")).alias("inner"),
        F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"),
    )
    zero = F.lit(0).cast("long")
    root = seqs.select("rep", "weight", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("bytes"), (F.col("depth") > 0).alias("inner"), zero.alias("p1"), zero.alias("p2"))
    path = cut(path.unionByName(root))

    nodes = cut(
        path.groupBy(*NODE).agg(
            F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("inner").alias("inner"),
            F.min("p1").alias("p1"), F.min("p2").alias("p2"), ((F.sum("weight") - 1) * F.max("bytes")).alias("saves"),
        )
    )
    # a sequence that is a proper prefix of another one is no leaf
    leaves = seqs.join(nodes.where("inner"), list(NODE), "left_anti").select("rep", F.lit(1).alias("leaf"))
    owned = nodes.groupBy(F.col("conv_id").alias("rep")).agg(F.sum("saves").alias("owns"))
    worth = cut(seqs.select("rep").join(owned, "rep", "left").join(leaves, "rep", "left").select("rep", F.coalesce("owns", F.lit(0)).alias("owns"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")))
    weighted = meet(path.select("rep", *NODE), worth, ["rep"], n).groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("owns").alias("through"))
    above = running(nodes, "conv_id", "depth", True, above=(F.sum("saves"), F.sum, lambda a, b: a + b))

    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = above.join(weighted, list(NODE)).join(kids, list(NODE), "left").join(ends_of, list(NODE), "left")
    out = cut(out.select(*NODE, "p1", "p2", "conv_id", "n_convs", "n_leaves", (F.col("through") - F.col("above")).alias("saved_tokens"), "n_children", "ends_sha256"))
    total = out.count()
    # the children of a hot parent are many rows with one key
    return meet(out, parents, ["depth", "p1", "p2"], total, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )

"""Embedding near-deduplication by a subspace pigeonhole join.

Unit vectors with cosine of ``threshold`` or more lie within squared distance D = 2 (1 - threshold).  After
a fixed random rotation the coordinates are split into blocks of ``block_dims``; if every block's squared
distance exceeded its share of D in proportion to its dimensions, the sum would exceed D.  So each
pair within D is within budget in some block, and a range join inside every block finds it.

A block's range join deals the vectors by a tree of coordinate splits fitted to a bounded sample.
A vector has one home shard a block and visits the later shards that its ball meets; shards that no
split divides are dealt by hash.  Of a candidate pair only the first block within budget counts,
so the union over blocks has no repeats and needs no second shuffle; the pair is then verified by its cosine in double precision.
A shard returns link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import cut, meet, thinned
from lexspark.llm.components import connected_components
from lexspark.llm.simhash import named_components, unite

SLACK = 1e-9


@lru_cache(maxsize=64)
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int, block_dims: int) -> list[slice]:
    return [slice(a, min(a + block_dims, dims)) for a in range(0, dims, block_dims)]


@dataclass
class Node:
    shard: int = -1
    axis: int = 0
    at: float = 0.0
    children: list[Node] = field(default_factory=list)


def fit_tree(sample: np.ndarray, total: float, shard_rows: int, radius: float) -> Node:
    """Splits at medians of the widest coordinates; a node that most balls would cross is dealt by hash instead.

    Below the sample's resolution shards stay larger than ``shard_rows``: :func:`divided` divides them by what they hold.
    """
    shards = iter(range(1 << 62))

    def grow(x: np.ndarray, est: float) -> Node:
        if est <= shard_rows or len(x) < 16:
            return Node(shard=next(shards))
        axis = int(np.argmax(x.std(axis=0)))
        at = float(np.median(x[:, axis]))
        low = x[:, axis] <= at
        if 0 < low.sum() < len(x) and (np.abs(x[:, axis] - at) <= radius).mean() < 0.9:
            return Node(axis=axis, at=at, children=[grow(x[low], est / 2), grow(x[~low], est / 2)])
        return Node(axis=-1, children=[Node(shard=next(shards)) for _ in range(int(np.ceil(est / shard_rows)))])

    return grow(sample, total)


def route(tree: Node, x: np.ndarray, pick: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, home) of the home shard and of the later shards that the ball meets."""
    found: list[tuple[np.ndarray, int, np.ndarray]] = []

    def go(node: Node, idx: np.ndarray, home: np.ndarray) -> None:
        if not len(idx):
            return
        if node.shard >= 0:
            found.append((idx, node.shard, home))
        elif node.axis < 0:
            own = pick[idx] % np.uint64(len(node.children))
            for i, child in enumerate(node.children):
                go(child, idx, home & (own == i))
        else:
            v = x[idx, node.axis]
            low, high = v - radius <= node.at, v + radius > node.at
            go(node.children[0], idx[low], (home & (v <= node.at))[low])
            go(node.children[1], idx[high], (home & (v > node.at))[high])

    go(tree, np.arange(len(x)), np.ones(len(x), bool))
    idx, home = np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found])
    shard = np.concatenate([np.full(len(f[0]), f[1], np.int64) for f in found])
    own = np.zeros(len(x), np.int64)
    own[idx[home]] = shard[home]
    keep = home | (shard > own[idx])
    return idx[keep], shard[keep], home[keep]


def ball(threshold: float, dims: int, part: slice) -> float:
    """How far apart two linked vectors may lie in a block that is within its budget."""
    return float(np.sqrt(2 * (1 - threshold) * (part.stop - part.start) / dims + 2 * SLACK))


def divided(x: np.ndarray, home: np.ndarray, count: np.ndarray, b: int, threshold: float, block_dims: int, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`search` of one shard; one above ``2 * shard_rows`` is divided again by a tree fitted to what it holds.

    Two of its vectors meet in exactly one part, visitors as well; of two visitors neither is at home here, so they are left to other shards.
    """
    if len(x) <= 2 * shard_rows:
        return search(x, home, home, count, b, threshold, block_dims)
    part = blocks(x.shape[1], block_dims)[b]
    y = (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ rotation(x.shape[1])[:, part]
    radius = ball(threshold, x.shape[1], part)
    idx, shard, own = route(fit_tree(y, len(x), shard_rows, radius), y, np.arange(len(x), dtype=np.uint64), radius)
    links, parent, order = np.zeros(len(x), np.int64), np.arange(len(x)), np.argsort(shard, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        i = idx[at]
        n, roots = search(x[i], own[at], home[i], count[i], b, threshold, block_dims)
        links[i] += n
        unite(parent, i.copy(), i[roots])
    return links, parent


def search(x: np.ndarray, home: np.ndarray, settled: np.ndarray, count: np.ndarray, b: int, threshold: float, block_dims: int, step: int = 256, most: int = 65536) -> tuple[np.ndarray, np.ndarray]:
    """Link counts of the vectors and the root of each in the spanning forest: every vector against those at ``home``; of a pair one at least is ``settled``."""
    n, total = len(x), 2 * (1 - threshold)
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / norm[:, None]
    y = unit @ rotation(x.shape[1])
    parts = blocks(x.shape[1], block_dims)
    budget = np.array([total * (s.stop - s.start) / x.shape[1] for s in parts]) + SLACK
    homes = np.nonzero(home)[0]
    sub, width = y[:, parts[b]], (y[:, parts[b]] ** 2).sum(axis=1)
    links, parent = np.zeros(n, np.int64), np.arange(n)
    for lo, at in ((lo, at) for lo in range(0, n, step) for at in range(0, len(homes), most)):
        rows, own = np.arange(lo, min(lo + step, n)), homes[at : at + most]
        near = width[rows, None] + width[None, own] - 2 * (sub[rows] @ sub[own].T) <= budget[b] + SLACK
        # two that are at home here meet once
        near &= ~home[rows, None] | (rows[:, None] < own[None, :])
        if not settled[own].all():
            near &= settled[rows, None] | settled[None, own]
        i, j = np.nonzero(near)
        i, j = rows[i], own[j]
        for k in range(0, len(i), most):
            p, q = i[k : k + most], j[k : k + most]
            gap = (y[p] - y[q]) ** 2
            first = np.stack([gap[:, s].sum(axis=1) for s in parts], axis=1) <= budget
            mine = first[:, b] & ~first[:, :b].any(axis=1)
            p, q = p[mine], q[mine]
            good = (x[p] * x[q]).sum(axis=1) / (norm[p] * norm[q]) >= threshold
            p, q = p[good], q[good]
            np.add.at(links, p, count[q])
            np.add.at(links, q, count[p])
            unite(parent, p.copy(), q.copy())
    return links, parent


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, block_dims: int = 8, sample_rows: int = 16384, shard_rows: int = 2048) -> DataFrame:
    """One row a vector: ``id_col, n_links, component_id, kept``.

    Two vectors are linked if their labels are equal and not null, their lengths are equal, and
    their cosine is at least ``threshold``.  Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing.  Equal vectors of a label form one class before the search, so
    copies are counted and never paired.  Repeated rows count each; a null id is never a
    component's name unless it has no other.  Other columns are ignored.  ``sample_rows`` bounds the
    rows that the trees are fitted to; every row is routed, and a shard that is too large for that sample, or of a vector
    length that it lacks, is divided again inside its task.
    """
    sound = F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", F.coalesce(sound & F.col("label").isNotNull(), F.lit(False)))
    if dict(vectors.dtypes)[vector_col] == "array<double>":  # squares of such components would overflow or vanish; a cosine does not mind the scale
        most = F.array_max(F.transform("v", lambda e: F.abs(e)))
        rows = rows.withColumn("v", F.when(F.col("ok") & ((most > 1e100) | (most < 1e-100)), F.transform("v", lambda e: e / most)).otherwise(F.col("v")))
    # a class's number is written with the table, so it is one whatever happens to a task
    classes = cut(rows.where("ok").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    order = F.xxhash64("cls")
    sample = thinned(classes.select("v", "cls"), order, sample_rows, n).orderBy(order, "cls").limit(sample_rows).toPandas()["v"]
    # a tree for each vector length that the sample has, by the size of its largest label; a length too rare for the sample is one shard
    lengths = sorted({len(v) for v in sample})
    sized = classes.groupBy(F.size("v").alias("dims"), "label").count().where(F.col("dims").isin(lengths)).groupBy("dims").agg(F.max("count").alias("most"))
    biggest = {r["dims"]: r["most"] for r in sized.collect()}
    trees: dict[tuple[int, int], Node] = {}
    for dims, most in biggest.items():
        held = [np.asarray(v, float) for v in sample if len(v) == dims]
        y = np.array([v / np.sqrt((v * v).sum()) for v in held]).reshape(-1, dims) @ rotation(dims)
        for b, s in enumerate(blocks(dims, block_dims)):
            trees[dims, b] = fit_tree(y[:, s], most, shard_rows, ball(threshold, dims, s))

    # single precision travels as it is; it is compared in double
    kind = np.float32 if "float" in dict(classes.dtypes)["v"] else np.float64

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["v"].map(len)
            for dims, part in batch.groupby(size):
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                sent = x.astype(kind)
                y = (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ rotation(dims)
                raw = [v.tobytes() for v in sent]
                pick = part["cls"].to_numpy(np.int64).view(np.uint64)
                for b, s in enumerate(blocks(dims, block_dims)):
                    tree = trees.get((dims, b), Node(shard=0))
                    idx, shard, home = route(tree, y[:, s], pick, ball(threshold, dims, s))
                    yield pd.DataFrame({"label": part["label"].to_numpy()[idx], "dims": np.full(len(idx), dims, np.int32), "block": np.full(len(idx), b, np.int32), "shard": shard, "home": home, "cls": part["cls"].to_numpy()[idx], "n": part["n"].to_numpy()[idx], "x": [raw[i] for i in idx]})

    def join(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, kind) for v in part["x"]]).astype(np.float64)
        cls = part["cls"].to_numpy(np.int64)
        links, parent = divided(x, part["home"].to_numpy(bool), part["n"].to_numpy(np.int64), int(part["block"].iloc[0]), threshold, block_dims, shard_rows)
        hit = links > 0
        return pd.DataFrame({"cls": cls[hit], "links": links[hit], "root": cls[parent[hit]]})

    dealt = classes.select("v", "label", "cls", "n").mapInPandas(deal, f"label {dict(classes.dtypes)['label']}, dims int, block int, shard long, home boolean, cls long, n long, x binary")
    met = cut(dealt.groupBy("label", "dims", "block", "shard").applyInPandas(join, "cls long, links long, root long"))
    links = met.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected_components(met.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    known = cut(classes.join(links, "cls", "left").select("cls", F.col("rep").alias("first"), "label", "v", "n", F.coalesce("links", F.lit(0)).alias("links")))
    names = named_components(known, "cls", roots, n)
    named = known.join(names, "cls").select("label", "v", "component_id", (F.col("links") + F.col("n") - 1).alias("n_links"))
    # equality of arrays in the join ignores the sign of zero, as grouping does
    good = meet(rows.where("ok").select("id", "label", "v"), named, ["label", "v"], n, small=0).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

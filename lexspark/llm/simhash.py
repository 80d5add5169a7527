"""SimHash near-deduplication with vantage-point trees.

Fingerprints are 64-bit.  Two that differ in at most ``radius`` = 3 bits differ in at most one bit
in one of their 32-bit halves, so there is one tree for each half and a pair is found by a search with radius 1 in
at least one of them; whole fingerprints are compared before a link counts.  (On whole fingerprints
a radius of 3 is about as wide as the spread of random distances, so a tree over them prunes next to nothing; over
halves each level sends only about a quarter of the queries both ways.)

A tree is fitted to a bounded sample of fingerprints.  An inner node has a vantage point and a median
radius; fingerprints no farther than the radius go inside, the others outside.  A query goes
both ways only when the triangle inequality allows a neighbour on either side.  Spark deals every
fingerprint to its home shard and, as a query, to the overlapping shards that come later in
tree order (of two neighbours in different shards one always visits the other).  A shard that the distances can't
divide is dealt by hash and visited whole, so large groups of near copies spread over tasks too.

A shard returns a spanning forest of its links, not the pairs; a component search joins the forests.

:func:`keep_one` also looks for near copies of Jaccard similarity 0.8, which differ in about 15 % of the bits:
128-bit fingerprints of the distinct shingles, several trees that send a row to one shard each, and the shingles
themselves compared before a link counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import cut, meet, thinned
from lexspark.llm.components import connected_components

SEED = 42


def fingerprint(text: str | None, words: int = 3, step: int = 65536) -> int:
    """SimHash of ``words``-word shingles, ASCII lower-cased, repeats included; no words: 0.  Unsigned."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    first, last = starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, step):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(first[k : k + step], last[k : k + step])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(typed, "long")(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"))


def bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


@dataclass
class Node:
    """A vantage point with two sides, a deal by hash over children, or (with neither) a shard."""

    shard: int = -1
    vantage: int = 0
    median: int = 0
    children: list[Node] = field(default_factory=list)
    dealt: bool = False


def fit_tree(sample: np.ndarray, total: int, shard_rows: int, reach: int, tries: int = 8) -> Node:
    """Fit to ``sample`` (values of one half), which stands for ``total`` fingerprints.

    Vantage points are the sample value out of ``tries`` that leaves the fewest queries going both
    ways.  Below the sample's resolution shards stay larger than ``shard_rows``.
    """
    shards = iter(range(1 << 62))
    rng = np.random.default_rng(7)

    def grow(values: np.ndarray) -> Node:
        est = total * len(values) / max(1, len(sample))
        if est <= shard_rows or len(values) < 8:
            return Node(shard=next(shards))
        best = None
        for v in values[rng.integers(0, len(values), tries)]:
            d = bits(values ^ v)
            for m in np.unique(np.percentile(d, [35, 50, 65]).astype(np.int64)):
                inside = int((d <= m).sum())
                both = int(((d.astype(np.int64) - reach <= m) & (d.astype(np.int64) + reach > m)).sum())
                if 0 < inside < len(values):
                    cost = (max(inside, len(values) - inside) + both) / len(values)
                    if best is None or cost < best[0]:
                        best = (cost, int(v), int(m), d <= m)
        if best is None or best[0] > 1.25:
            k = int(np.ceil(est / shard_rows))
            return Node(children=[Node(shard=next(shards)) for _ in range(k)], dealt=True)
        _, v, m, inside = best
        return Node(vantage=v, median=m, children=[grow(values[inside]), grow(values[~inside])])

    return grow(sample)


def route(tree: Node, half: np.ndarray, other: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, home) of every visit: the home shard and the later ones that a ball of ``reach`` meets."""
    found: list[tuple[np.ndarray, int, np.ndarray]] = []

    def go(node: Node, idx: np.ndarray, home: np.ndarray) -> None:
        if not len(idx):
            return
        if node.shard >= 0:
            found.append((idx, node.shard, home))
            return
        if node.dealt:
            k = len(node.children)
            own = ((other[idx] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(k)
            for i, child in enumerate(node.children):
                go(child, idx, home & (own == i))
            return
        d = bits(half[idx] ^ np.uint64(node.vantage)).astype(np.int64)
        inside, outside = d - reach <= node.median, d + reach > node.median
        go(node.children[0], idx[inside], (home & (d <= node.median))[inside])
        go(node.children[1], idx[outside], (home & (d > node.median))[outside])

    go(tree, np.arange(len(half)), np.ones(len(half), bool))
    idx = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
    shard = np.concatenate([np.full(len(f[0]), f[1], np.int64) for f in found] or [np.zeros(0, np.int64)])
    home = np.concatenate([f[2] for f in found] or [np.zeros(0, bool)])
    own = np.zeros(len(half), np.int64)
    own[idx[home]] = shard[home]
    keep = home | (shard > own[idx])
    return idx[keep], shard[keep], home[keep]


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of all pairs, in place; roots are the smallest index of their set."""
    while len(a):
        for side in (a, b):
            while True:
                up = parent[side]
                if np.array_equal(up, side):
                    break
                side[:] = up
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        a, b = a.copy(), b.copy()
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return
        parent[:] = up


def forest(values: np.ndarray, home: np.ndarray, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one shard: every value against all that are at home here."""
    order = np.argsort(~home, kind="stable")
    values, n = values[order], int(home.sum())
    homes, parent = values[:n], np.arange(len(values))
    for k in range(0, len(values), block):
        part = values[k : k + block]
        a, b = np.nonzero(np.bitwise_count(part[:, None] ^ homes[None, :]) <= radius)
        a += k
        unite(parent, a, b.copy())
    child = np.nonzero(parent != np.arange(len(values)))[0]
    return values[child], values[parent[child]]


def shard_forest(half: np.ndarray, other: np.ndarray, values: np.ndarray, home: np.ndarray, radius: int, shard_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one shard.  A shard above ``shard_rows`` is divided again by a tree fitted to what it holds, so its work does not grow with the square of its rows."""
    if len(values) <= 2 * shard_rows:
        return forest(values, home, radius)
    tree = fit_tree(half, len(half), shard_rows, radius // 2)
    idx, shard, own = route(tree, half, other, radius // 2)
    order = np.argsort(shard, kind="stable")
    idx, own = idx[order], own[order]
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
    parts = [forest(values[i], h, radius) for i, h in zip(np.split(idx, edges[1:]), np.split(own, edges[1:]))]
    return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


def links(classes: DataFrame, radius: int = 3, sample_rows: int = 32768, shard_rows: int = 2048) -> DataFrame:
    """(a, b): links between distinct fingerprints that span every component.

    ``sample_rows`` bounds the fingerprints that the two trees are fitted to; every row is routed.  Shards that
    stay too large for that sample are divided again inside their tasks, by what they hold (:func:`shard_forest`).
    """
    total = classes.count()
    picked = thinned(classes.select("fp"), F.xxhash64("fp"), sample_rows, total).orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    low, reach = np.uint64(0xFFFFFFFF), radius // 2
    trees = [fit_tree(picked & low, total, shard_rows, reach), fit_tree(picked >> np.uint64(32), total, shard_rows, reach)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for t, (tree, half, other) in enumerate(((trees[0], fp & low, fp >> np.uint64(32)), (trees[1], fp >> np.uint64(32), fp & low))):
                idx, shard, home = route(tree, half, other, reach)
                yield pd.DataFrame({"tree": np.full(len(idx), t, np.int32), "shard": shard, "fp": fp[idx].view(np.int64), "home": home})

    def search(part: pd.DataFrame) -> pd.DataFrame:
        fp = part["fp"].to_numpy(np.int64).view(np.uint64)
        halves = (fp & low, fp >> np.uint64(32))
        t = int(part["tree"].iloc[0])
        a, b = shard_forest(halves[t], halves[1 - t], fp, part["home"].to_numpy(bool), radius, shard_rows)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = classes.select("fp").mapInPandas(deal, "tree int, shard long, fp long, home boolean")
    return dealt.groupBy("tree", "shard").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row a document: ``doc_id, fingerprint, component_id``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is
    the smallest id reachable by links.  A text without words, null included, has fingerprint 0 and
    is linked like any other.  Equal fingerprints form one class before the search, so copies cost one lookup.  Rows
    with a null id are returned; their component is named by its smallest non-null id, if any.
    Repeated rows are returned each.  Other columns are ignored; an empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, words))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    n = classes.count()
    named = cut(named_components(classes, "fp", connected_components(links(classes, radius)), n))
    out = meet(fps, named, ["fp"], n)
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def named_components(classes: DataFrame, key: str, roots: DataFrame, n: int) -> DataFrame:
    """(key, component_id): the smallest ``first`` of each class's component.  ``classes`` has key, first and ``n`` rows."""
    labelled = cut(classes.select(key, "first").join(roots.withColumnRenamed("node", key), key, "left").select(key, "first", F.coalesce("root", key).alias("root")))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return meet(labelled, smallest, ["root"], n).select(key, "component_id")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of the shingles that :func:`fingerprint` counts, repeats included; no words: none."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist())), np.uint64, n)


def majority(hashes: np.ndarray, step: int = 65536) -> int:
    """The bits that more than half of ``hashes`` have."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), step):
        h = np.ascontiguousarray(hashes[k : k + step], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def mixed_bits(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from each hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def jaccards(a: str | None, b: str | None, words: int) -> tuple[float, float]:
    """Jaccard similarity of the shingles: (repeats counted, as sets).  Two texts without words: 1."""
    (x, n), (y, m) = (np.unique(shingle_hashes(t, words), return_counts=True) for t in (a, b))
    if not len(x) and not len(y):
        return 1.0, 1.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (int(n.sum()) + int(m.sum()) - both), len(i) / (len(x) + len(y) - len(i))


def fit_wide(sample: np.ndarray, total: int, shard_rows: int, seed: int) -> np.ndarray:
    """A vantage-point tree over 128-bit fingerprints (rows of two words): (bit, v0, v1, median, inside, outside) a node.

    A node measures the distance to its vantage point over one drawn bit, which parts near copies least often, or
    over all (bit -1) where no bit divides its values well.  A side below 0 is a shard.
    """
    rng, nodes, shards = np.random.default_rng(seed), [], iter(range(1, 1 << 62))

    def grow(values: np.ndarray) -> int:
        if total * len(values) / max(1, len(sample)) <= shard_rows or len(values) < 8:
            return -next(shards)
        split = None
        for bit in rng.permutation(128)[:32]:
            outside = ((values[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)).astype(bool)
            if 0.25 <= outside.mean() <= 0.75:
                split = (int(bit), 0, 0, 0), outside
                break
        if split is None:
            best = 1.0
            for v in values[rng.integers(0, len(values), 8)]:
                d = bits(values ^ v).sum(axis=1, dtype=np.int64)
                for m in np.unique(np.percentile(d, [35, 50, 65]).astype(np.int64)):
                    larger = max((d <= m).mean(), (d > m).mean())
                    if larger < best:
                        best, split = larger, ((-1, int(v[0]), int(v[1]), int(m)), d > m)
        if split is None:
            return -next(shards)
        at = len(nodes)
        nodes.append(None)
        node, outside = split
        nodes[at] = (*node, grow(values[~outside]), grow(values[outside]))
        return at

    root = grow(sample)
    kinds = [("bit", np.int64), ("v0", np.uint64), ("v1", np.uint64), ("median", np.int64), ("inside", np.int64), ("outside", np.int64)]
    return np.array(nodes, kinds) if root == 0 else np.zeros(0, kinds)


def route_wide(tree: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The shard of every fingerprint."""
    at = np.zeros(len(words), np.int64)
    if not len(tree):
        return at
    going = np.arange(len(words))
    while len(going):
        node, w = tree[at[going]], words[going]
        bit = np.maximum(node["bit"], 0)
        one = (w[np.arange(len(w)), bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)
        far = bits(w[:, 0] ^ node["v0"]).astype(np.int64) + bits(w[:, 1] ^ node["v1"]) > node["median"]
        at[going] = np.where(np.where(node["bit"] < 0, far, one == 1), node["outside"], node["inside"])
        going = going[at[going] >= 0]
    return at


def smallest_forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the pairs, closest first: rounds in which every tree takes its closest pair."""
    order = np.argsort(d, kind="stable")
    a, b, d, parent, out = a[order], b[order], d[order], np.arange(n), []
    while True:
        apart = parent[a] != parent[b]
        a, b, d = a[apart], b[apart], d[apart]
        if not len(a):
            break
        best = np.full(n, len(a))
        for side in (a, b):
            np.minimum.at(best, parent[side], np.arange(len(a)))
        pick = np.unique(best[best < len(a)])
        out.append((a[pick], b[pick], d[pick]))
        unite(parent, a[pick], b[pick])
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (a, b, d)


def nearest_forest(words: np.ndarray, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within ``radius``, closest first (indices).

    A block's pairs are put together with the forest so far and thinned to a forest at once, so memory holds a block's pairs and no more.
    """
    n = len(words)
    a, b, d = (np.zeros(0, np.int64) for _ in range(3))
    for k in range(0, n, block):
        part, rest = words[k : k + block], words[k:]
        gap = np.bitwise_count(part[:, None, 0] ^ rest[None, :, 0]) + np.bitwise_count(part[:, None, 1] ^ rest[None, :, 1])
        gap[np.tril_indices(len(part), 0, n - k)] = 255  # each pair once
        i, j = np.nonzero(gap <= radius)
        if len(i):
            a, b, d = smallest_forest(n, np.concatenate((a, i + k)), np.concatenate((b, j + k)), np.concatenate((d, gap[i, j])))
    return a, b


def local_forest(words: np.ndarray, radius: int, shard_rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`nearest_forest` of a shard; one above ``shard_rows`` is divided again by a tree fitted to what it holds."""
    if len(words) <= 2 * shard_rows:
        return nearest_forest(words, radius)
    shard = route_wide(fit_wide(words, len(words), shard_rows, seed), words)
    order = np.argsort(shard, kind="stable")
    found = []
    for idx in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        a, b = nearest_forest(words[idx], radius)
        found.append((idx[a], idx[b]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def wide_links(classes: DataFrame, radius: int = 30, recall: float = 0.98, sample_rows: int = 32768, shard_rows: int = 2048) -> DataFrame:
    """(a, b): candidate links between rows of ``classes`` (node, w0, w1) within ``radius`` of 128 bits.

    Each tree sends a row to one shard only, so there are as many as it takes for a pair of Jaccard 0.8 (15 % of the
    bits differ) to share a shard with probability ``recall``; closer pairs meet more often.  ``sample_rows`` bounds the
    rows that the trees are fitted to; every row is routed.
    """
    total = classes.count()
    levels = max(0, int(np.ceil(np.log2(max(1, total) / shard_rows)))) + (total > shard_rows)
    trees_n = max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - min(0.848**levels, 1 - 1e-9)))))
    key = F.xxhash64("w0", "w1")
    picked = thinned(classes.select("w0", "w1"), key, sample_rows, total).orderBy(key, "w0", "w1").limit(sample_rows).toPandas()[["w0", "w1"]].to_numpy(np.int64).view(np.uint64)
    trees = [fit_wide(picked, total, shard_rows, seed) for seed in range(trees_n)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = np.ascontiguousarray(batch[["w0", "w1"]].to_numpy(np.int64)).view(np.uint64)
            for t, tree in enumerate(trees):
                yield pd.DataFrame({"tree": np.full(len(batch), t, np.int32), "shard": route_wide(tree, words), "node": batch["node"], "w0": batch["w0"], "w1": batch["w1"]})

    def search(part: pd.DataFrame) -> pd.DataFrame:
        a, b = local_forest(np.ascontiguousarray(part[["w0", "w1"]].to_numpy(np.int64)).view(np.uint64), radius, shard_rows, int(part["tree"].iloc[0]))
        node = part["node"].to_numpy(np.int64)
        return pd.DataFrame({"a": node[a], "b": node[b]})

    dealt = classes.mapInPandas(deal, "tree int, shard long, node long, w0 long, w1 long")
    return dealt.groupBy("tree", "shard").applyInPandas(search, "a long, b long")


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that name a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def similar_links(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): a node (node, h1, h2, first) a distinct text, and the verified links (a, b) between nodes.

    A link counts if the Jaccard similarity of the two texts' shingles, repeats counted, is at least ``similarity``,
    or if their fingerprints differ in at most ``radius`` bits and the sets of their shingles are that similar.
    """

    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                h = shingle_hashes(t, words)
                own = np.unique(h)
                rows.append((majority(h), majority(own), majority(mixed_bits(own))) if len(h) else (0, 0, 0))
            yield pd.DataFrame(np.array(rows, np.uint64).reshape(-1, 3).view(np.int64), columns=["fp", "w0", "w1"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), *text_key(text), F.pandas_udf(typed, "fp long, w0 long, w1 long")(text).alias("f"))
    nodes = rows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.first("f").alias("f"))
    # the number is written with the table, so it is one whatever happens to a task
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "first", "f.*"))
    n = nodes.count()
    narrow = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    near = links(narrow.select("fp"), radius)
    near = near.join(narrow.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(narrow.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    near = near.union(meet(nodes.select("fp", "node"), narrow, ["fp"], n).select("first", "node"))
    wide = cut(nodes.groupBy("w0", "w1").agg(F.min("node").alias("node")))
    far = wide_links(wide).union(meet(nodes.select("w0", "w1", "node"), wide.withColumnRenamed("node", "first"), ["w0", "w1"], n).select("first", "node"))
    pairs = near.select("x", "y", F.lit(True).alias("close")).union(far.select("a", "b", F.lit(False))).where("x <> y")
    pairs = cut(pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("close").alias("close")))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.select("node", "h1", "h2").join(ends, "node", "left_semi")
    held = docs.select(*text_key(text), text.alias("t")).join(wanted.hint("shuffle_hash"), ["h1", "h2"])
    held = cut(held.select("node", "t").dropDuplicates(["node"]))

    def compared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame([jaccards(x, y, words) for x, y in zip(a, b)], columns=["counted", "sets"])

    both = pairs.join(held.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(held.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    both = both.select("a", "b", "close", F.pandas_udf(compared, "counted double, sets double")("ta", "tb").alias("j"))
    return nodes, both.where((F.col("j.counted") >= similarity) | (F.col("close") & (F.col("j.sets") >= similarity))).select("a", "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document of each group of verified near copies (:func:`similar_links`), the one with the smallest id.

    A row whose id is null stays only if its component has no other; rows that repeat an id all stay or go together.  Null and
    empty texts are equal texts.  Other columns may have any names.
    """
    nodes, found = similar_links(docs, id_col, text_col, words, radius, similarity)
    n = nodes.count()
    names = cut(nodes.select("node", "h1", "h2", "first").join(named_components(nodes.select("node", "first"), "node", connected_components(found), n), "node"))
    rows = cut(docs.select(F.col(id_col).alias("id"), *text_key(F.coalesce(F.col(text_col), F.lit("")))))
    gone = meet(rows, names.select("h1", "h2", "component_id"), ["h1", "h2"], n).where("id is null and component_id is not null or id <> component_id").select("id").distinct()
    return docs.join(gone.hint("shuffle_hash"), docs[id_col].eqNullSafe(gone["id"]), "left_anti")

"""SimHash, vectors, exact dedup and components against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexspark.llm import components, exact_dedup, simhash, vectors
from lexspark.llm.common import meet


def closure(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text, words=3):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        parts = parts.replace(c, " ")
    parts = [p for p in parts.split(" ") if p]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "ÉPSILON", "zeta", "eta", "theta", "iota"]) + str(rng.randint(0, 40)) for _ in range(n))


def test_fingerprint_follows_its_definition(spark):
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "One  two", "a b\x0bc d e", *(words(rng, n) for n in (2, 3, 4, 50, 3000))]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(texts[-1], step=7) == simhash.fingerprint(texts[-1])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(df).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def test_hash_agrees_with_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_tree_finds_every_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    near = [int(base[0]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)) for _ in range(400)]
    near += [int(v) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for v in base[1:200]]
    # one half alike in all of a group
    near += [(int(base[3]) & 0xFFFFFFFF) | int(x) << 32 for x in rng.integers(0, 1 << 31, 200)]
    fps = sorted({*map(int, base), *near, 0})
    edges = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 3]
    want = closure(fps, edges)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for shard_rows in (40, 5000):
        got = simhash.links(df, shard_rows=shard_rows).collect()
        found = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in got]
        assert all(bin(a ^ b).count("1") <= 64 for a, b in found)
        assert closure(fps, found) == want


def test_near_duplicates_of_texts(spark):
    rng = random.Random(2)
    long = words(rng, 800)
    rows = [(9, long), (4, long.replace("alpha1 ", "alpha2 ", 1)), (7, long), (7, long), (3, None), (2, ""), (1, "solo"), (None, long), (12, words(rng, 500))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, component_id int, fp string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()]
    fps = {t: plain_fingerprint(t) for _, t in rows}
    want = closure(set(fps.values()), [(a, b) for a in fps.values() for b in fps.values() if bin(a ^ b).count("1") <= 3])
    first = {}
    for i, t in rows:
        if i is not None:
            first[want[fps[t]]] = min(i, first.get(want[fps[t]], i))
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(((i, f"{fps[t]:016x}", first[want[fps[t]]]) for i, t in rows), key=key)
    kept = simhash.keep_one(df, words=3).collect()
    assert {r.doc_id for r in kept} >= {1, 2, 12} and len([r for r in kept if r.text == long and r.doc_id is not None]) <= 2
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def shuffled_chain(n):
    names = list(range(n))
    random.Random(n).shuffle(names)
    return list(zip(names, names[1:]))


GRAPHS = {
    "mixed": [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(random.Random(i).randint(200, 260), random.Random(-i - 1).randint(200, 260)) for i in range(40)] + [(5, 5)],
    "chain": shuffled_chain(1000),
    "long chain": shuffled_chain(10000),
    "sorted path": [(i, i + 1) for i in range(10000)],
    "comb": [(i, i + 1) for i in range(300)] + [(i, 1000 + i) for i in range(300)],
    "star": [(1000, i) for i in range(2000) if i != 1000],
}


@pytest.mark.parametrize("graph", GRAPHS)
def test_components_are_exact(spark, graph):
    edges, rounds = GRAPHS[graph], []
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), rounds).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == closure(nodes, [e for e in edges if e[0] != e[1]])
    assert len(rounds) <= 2 * np.log2(len(nodes))


@pytest.mark.parametrize("graph", ["mixed", "star"])
def test_components_beyond_broadcast(spark, graph):
    """With no table small enough to broadcast whole, only the hot nodes' rows are."""
    edges = GRAPHS[graph]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), small=0).collect()}
    assert got == closure({x for a, b in edges if a != b for x in (a, b)}, [e for e in edges if e[0] != e[1]])


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_meet_keeps_every_row(spark):
    left = spark.createDataFrame([(i, 7 if i % 2 else i) for i in range(2000)], "id long, k long")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(1500)], "k long, v string")
    want = sorted((k, i, f"v{k}" if k < 1500 else None) for i, k in ((i, 7 if i % 2 else i) for i in range(2000)))
    for small in (0, 1 << 17):
        got = meet(left, right, ["k"], 1500, "left", small=small).select("k", "id", "v").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_large_shard_is_divided_again():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base[:800] ^ np.uint64(1 << 5), base[:500] ^ np.uint64((1 << 40) | 8)]))
    low = np.uint64(0xFFFFFFFF)
    pairs = [p for halves in ((fps & low, fps >> np.uint64(32)), (fps >> np.uint64(32), fps & low)) for p in zip(*(x.tolist() for x in simhash.shard_forest(*halves, fps, np.ones(len(fps), bool), 3, 200)))]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    want = closure(fps.tolist(), [(int(fps[i]), int(fps[j])) for i, j in zip(*np.nonzero(near))])
    assert closure(fps.tolist(), pairs) == want


def test_nearest_forest_by_blocks():
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 63, (60, 2), dtype=np.uint64)
    words = np.concatenate([base, *(base[:20] ^ (np.uint64(1) << rng.integers(0, 63, (20, 2), dtype=np.uint64)) for _ in range(15))])
    d = np.bitwise_count(words[:, None, :] ^ words[None, :, :]).sum(axis=2)
    want = closure(range(len(words)), list(zip(*np.nonzero(d <= 30))))
    for block in (16, 4096):
        a, b = simhash.nearest_forest(words, 30, block)
        assert len(a) == len(words) - len(set(want.values())) and closure(range(len(words)), list(zip(a.tolist(), b.tolist()))) == want


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, keep):
    rows = [(1, "a", None), (2, "a", "x"), (3, "A", "y"), (4, None, "z"), (5, "", "z"), (6, "long " * 5000, "s"), (7, "long " * 5000, "s"), (2, "a", "x"), (None, "n", "q"), (8, "a ", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, stay_id string")
    got = exact_dedup.exact_groups(df, keep=keep).collect()
    assert len(got) == len(rows)
    pick = min if keep == "smallest" else max
    for r in got:
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        ids = [i for i, t, _ in rows if (t or "") == text]
        assert r.group_size == len(ids) and r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.keep_id == (pick([i for i in ids if i is not None]) if any(i is not None for i in ids) else None)
    assert sum(r.kept for r in got) == len({t or "" for _, t, _ in rows})
    stay = exact_dedup.exact_dedup(df, keep=keep).collect()
    assert len(stay) == len({t or "" for _, t, _ in rows}) and set(stay[0].asDict()) == {"doc_id", "text", "stay_id"}
    assert exact_dedup.exact_groups(df.limit(0)).collect() == [] and exact_dedup.exact_dedup(df.limit(0)).collect() == []


@pytest.mark.parametrize(("shard_rows", "sample_rows"), [(50, 16384), (50, 24), (4000, 16384)])
def test_vectors_against_all_pairs(spark, shard_rows, sample_rows):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 20))
    rows, k = [], 0
    for v in base:
        for s in (0, 0.05, 0.08, 0.1, 0.2):
            rows.append((k, (v + s * rng.normal(size=20)).astype(np.float32).tolist(), int(rng.integers(0, 3))))
            k += 1
    for _ in range(120):  # one dense group
        rows.append((k, (base[0] + 0.06 * rng.normal(size=20)).astype(np.float32).tolist(), 1))
        k += 1
    rows += [(k, rows[0][1], rows[0][2]), (k + 1, rows[0][1], rows[0][2]), (k + 1, rows[0][1], rows[0][2]), (k + 2, None, 1), (k + 3, [0.0] * 20, 1), (k + 4, [1.0, None] * 10, 1), (k + 5, [float("nan")] * 20, 1), (k + 6, [float("inf")] * 20, 1), (k + 7, rows[0][1], None), (k + 8, [1.0, 2.0, 3.0], 1), (k + 9, [2.0, 4.0, 6.0], 1), (k + 10, [], 1), (k + 11, [5.0], 1)]
    ok = [v is not None and len(v) > 0 and all(e is not None and np.isfinite(e) for e in v) and any(v) and lab is not None for _, v, lab in rows]
    links, edges = [0] * len(rows), []
    for i, (a, v, la) in enumerate(rows):
        for j, (b, w, lb) in enumerate(rows[:i]):
            if ok[i] and ok[j] and la == lb and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    edges.append((a, b))
    want = closure({r[0] for r in rows}, edges)
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, root string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, shard_rows=shard_rows, sample_rows=sample_rows).collect())
    assert got == sorted((r[0], n, want[r[0]], r[0] == want[r[0]]) for r, n in zip(rows, links))
    assert vectors.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("visitors", [0, 400])
def test_a_divided_shard_finds_what_a_whole_one_does(visitors):
    """Links, roots and pairs of visitors, which belong to other shards."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(300, 16)), 4, axis=0) + 0.05 * rng.normal(size=(1200, 16))
    home, count = np.ones(1200, bool), rng.integers(1, 4, 1200)
    home[rng.permutation(1200)[:visitors]] = False
    want = vectors.divided(x, home, count, 0, 0.93, 8, 5000)
    assert (want[0] > 0).sum() > 100
    for shard_rows in (20, 300):
        got = vectors.divided(x, home, count, 0, 0.93, 8, shard_rows)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [2e200, 2.1e200], 0), (3, [1e-200, 1e-200], 0), (4, [-1e-200, 1e-200], 0), (5, [5e-324, 5e-324], 0), (6, [1.0, 1.0], 0)]
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == {1: (4, 1), 2: (4, 1), 3: (4, 1), 5: (4, 1), 6: (4, 1), 4: (0, 4)}

"""Near copies of the pipeline's similarity, planted and verified."""

import random

import corpus_pipeline
from lexspark.llm import simhash


def prose(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def test_near_copies_of_similarity(spark):
    rng, rows, wanted = random.Random(5), [], {}
    for i in range(200):
        words = prose(rng, 400)
        rows.append((i, " ".join(words)))
        target = (0.7, 0.82, 0.87, 0.92, 0.95)[i % 5]
        copy = list(words)
        while simhash.jaccards(rows[i][1], " ".join(copy), 5)[0] > target + 0.01:
            copy[rng.randrange(400)] = "new" + str(rng.random())[2:]
        rows.append((1000 + i, " ".join(copy)))
        wanted[1000 + i] = simhash.jaccards(rows[-2][1], rows[-1][1], 5)[0]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert set(range(200)) <= kept
    assert {i for i, j in wanted.items() if j < 0.8} <= kept
    near = {i for i, j in wanted.items() if j >= 0.8}
    assert len(near & kept) <= 0.02 * len(near)


def test_equal_bits_are_not_enough(spark):
    """One repeated passage holds most shingles of two texts that differ otherwise."""
    rng = random.Random(6)
    passage = "this line is said again and again "
    texts = [passage * 60 + " ".join(prose(rng, 120)) for _ in range(2)]
    assert (simhash.fingerprint(texts[0], 5) ^ simhash.fingerprint(texts[1], 5)).bit_count() <= 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.near(spark, docs, "").count() == 2


def test_wide_trees_share_shards(spark):
    """Pairs with 15 % of their bits different, over many shards."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (10000, 128), dtype=np.uint8)
    other = base[:1000] ^ (rng.random((1000, 128)) < 0.152).astype(np.uint8)
    w = np.packbits(np.concatenate([base, other]), axis=1).view("<u8").astype(np.uint64)
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(w.view(np.int64).tolist())]
    df = spark.createDataFrame(rows, "node long, w0 long, w1 long")
    found = {(min(r), max(r)) for r in simhash.wide_links(df, shard_rows=256).collect()}
    hit = sum((i, 10000 + i) in found for i in range(1000))
    print(hit)
    assert hit >= 930

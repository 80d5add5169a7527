"""The prefix trie of rebuilt conversations against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lexspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for s in nodes:
        if s:
            kids[s[:-1]].append(s)

    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in sorted(nodes.items(), key=lambda x: -len(x[0])):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = sum(saved[k] for k in kids[s]) + (len(m) - 1) * (len(s[-1][1].encode()) if s else 0)
    return sorted(
        (min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest())
        for s, m in nodes.items()
    )


def found(spark, rows, schema=SCHEMA):
    out = prefix_trie.prefix_nodes(spark.createDataFrame(rows, schema).repartition(3))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0], r[1], r[2] or 0))


def key(r):
    return r[0], r[1], r[2] or 0


def test_against_plain_python(spark):
    rng = random.Random(5)
    say = ["hi", "", None, "a longer text é", "x"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(say[: rng.choice([1, 2, 5])])) for c in range(400) for t in range(rng.randint(1, 10)) if c % 7]
    assert found(spark, rows) == sorted(plain(rows), key=key)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(1, 0, "user", "b", 1, 2), (1, 0, "user", "a", 1, 2), (1, 0, "user", "a", 1, 2), (1, None, None, None, 3, 4), (None, 0, "user", "lost", 0, 0), (0, 3, "user", "a", 0, 0), (6, 1, "user", "q", 0, 0), (7, 1, "user", "q", 0, 0)]
    assert found(spark, rows, SCHEMA + ", depth long, k1 long") == sorted(plain(rows), key=key)
    assert any(r[1] == 0 for r in found(spark, [r[:4] for r in rows[5:6]]))


def test_empty(spark):
    assert found(spark, [], SCHEMA) == []


def test_long_conversation_over_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    rng = random.Random(6)
    rows = [(c, t if rng.random() < 0.95 else None, "user", f"turn {min(t, 90 + c % 3)} {'x' * rng.randint(0, 1)}") for c in (0, 1, 2, 3, 4, 10, 15) for t in range(150)]
    assert found(spark, rows) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("n", [9000])
def test_a_large_group_of_copies_keeps_every_end(spark, n):
    rows = [(c, 0, "user", "same") for c in range(n)]
    got = {r[1]: r for r in found(spark, rows)}
    want = {r[1]: r for r in plain(rows)}
    assert got == want

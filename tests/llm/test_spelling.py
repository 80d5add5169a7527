"""Spelling variants against plain Python: every pair of words is compared."""

import random
import re
import zlib
from collections import Counter

from lexspark.llm import spelling

SCHEMA = "doc_id long, text string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, ratio=10):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    links = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: (v[0] if v and n[v[0]] >= ratio * n[w] else None) for w, v in links.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(links[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def found(spark, rows, schema=SCHEMA):
    out = spelling.spelling_variants(spark.createDataFrame(rows, schema).repartition(3))
    return sorted(tuple(r) for r in out.select("word", "n", "n_near", "form", "form_n", "root").collect())


def texts(seed, n):
    rng = random.Random(seed)
    base = ["together", "Çevirmen", "straßeÿn", "wonderful", "abcdefg", "anagram", "garaman", "zzzzzzz", "a×÷bcdefg"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(20):
            w = rng.choice(base) * rng.choice([1, 1, 1, 2])
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at, x = rng.randrange(len(w)), rng.choice(["", "x", "é", w[rng.randrange(len(w))] * 2])
                w = w[:at] + x + w[at + 1 :]
            words.append(rng.choice([w, w.upper()]))
        rows.append((rng.randint(0, 50), rng.choice([" ", ", ", "1", "\n"]).join(words)))
    return rows


def test_against_all_pairs(spark):
    rows = texts(1, 400)
    got = found(spark, rows)
    assert got == plain(rows)
    assert any(r[3] for r in got)


def test_forms_are_followed_to_the_last(spark):
    rows = [(i, "wonderful") for i in range(700)] + [(i, "wonderfull") for i in range(60)] + [(i, "wonderfulll") for i in range(5)]
    got = found(spark, rows)
    assert got == plain(rows)
    assert {r[0]: r[5] for r in got}["wonderfulll"] == "wonderful"


def test_pieces_of_any_size_agree(spark):
    rows = texts(2, 150)
    words = spelling.occurrences(spark.createDataFrame(rows, SCHEMA), 7).groupBy("word").count().withColumnRenamed("count", "n").where("n >= 2").cache()
    whole = sorted(map(tuple, spelling.links(words).collect()))
    assert whole
    for classes in (2, 4, 5):
        assert sorted(map(tuple, spelling.links(words, home=30, visit=50, classes=classes).collect())) == whole


def test_nulls_long_runs_repeats_and_clashing_names(spark):
    long = "ab" * 30000
    rows = [(None, "together together togethers togethers", "x", 1), (1, None, "x", 2), (2, "", "x", 3), (3, long + " " + long, "x", 4), (3, long + "c", "x", 5), (3, long + "c", "x", 5), *[(4, "together", "x", 5)] * 30]
    got = found(spark, rows, SCHEMA + ", word string, n long")
    assert got == plain(rows)
    assert ("together", 32, 1, None, None, "together") in got


def test_empty(spark):
    assert found(spark, [], SCHEMA) == []

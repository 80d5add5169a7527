"""The pipeline, stage by stage, against plain Python."""

import hashlib
import math
import random
import re

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from lexspark.llm import langid
from lexspark.llm.common import fold

PARTS = {"aa": ["tha", "ing", "er", "wo", "st"], "bb": ["eau", "oi", "que", "lé", "ç"], "cc": ["sch", "ung", "ein", "ö", "pf"]}


def corpus():
    rng = random.Random(21)
    text = lambda lang, n: " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = []
    for i in range(240):
        lang = rng.choice(list(PARTS))
        rows.append((i, text(lang, rng.randint(30, 250)), lang, f"s{i % 5}" if i % 3 else "s0"))
    for i in range(240, 270):  # exact copies
        rows.append((i, *rows[i - 240][1:]))
    for i in range(270, 300):  # near copies of long texts
        base = rows[i - 170]
        words = (base[1] + " " + base[1] + " x" + str(i - 170)).split(" ") * 4
        rows.append((i, " ".join(words), base[2], None))
        words[7] = "changed"
        rows.append((i + 100, " ".join(words), base[2], "s1"))
    rows += [(900, None, "aa", "s1"), (901, "", None, None), (902, "12 34", "bb", "s2"), (903, "same", "aa", "s2"), (904, "same", "aa", "s3")]
    return rows


def fingerprint(text, n=5):
    words = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_mix(rows, least=64.0):
    """How often each document is read, by loops over sources, slots and words."""
    size = {i: len([w for w in re.split("[ \t-\r]+", t) if w]) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    free, target = set(names), {}
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in names if s not in free)
        over = {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * total[s]}
        if not over:
            break
        free -= over
    target = {s: left * weight[s] / sum(weight[x] for x in free) if s in free else 3.0 * total[s] for s in names}
    common = max(1, math.ceil(math.sqrt(sum(target.values())) / 8))
    due = {s: max(target[s] / common, min(target[s], least)) for s in names}
    bits = math.ceil(math.log2(sum(due.values())))
    slots = dict.fromkeys(names, 0)
    edges, at = [], 0.0
    for s in names:
        edges.append((at / sum(due.values()), (at + due[s]) / sum(due.values()) if s != names[-1] else 2.0, s))
        at += due[s]
    for k in range(1 << bits):
        u = int(f"{k:0{bits}b}"[::-1], 2) / (1 << bits)
        slots[next(s for lo, hi, s in edges if lo <= u < hi)] += 1
    taken = dict.fromkeys(size, 0)
    for s in names:
        block = target[s] / (due[s] / sum(due.values()) * (1 << bits))
        line = [i for _, i in sorted((hashlib.sha256(f"mix:{i}".encode()).hexdigest()[:16], i) for i, _, x in rows if x == s) for _ in range(size[i])]
        for k in range(min(math.floor(slots[s] * block), 3 * total[s])):
            taken[line[k % len(line)]] += 1
    return {i: math.ceil(n / size[i]) for i, n in taken.items() if n}


def test_pipeline_against_plain_python(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        steps[name] = now.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    model = langid.fit(docs.where(fold(docs["doc_id"], 3) != 1))
    compressors = model.compressors()
    left = {i: t for i, t, _, _ in rows if (c := langid.classify(t, model, compressors))[0] != "und" and c[2] > 0 and c[2] >= model.min_margin}
    assert {r.doc_id for r in steps["language"]} == set(left) and len(left) > 320
    first = {}
    for i in sorted(left):
        first.setdefault(left[i], i)
    assert {r.doc_id for r in steps["exact"]} == set(first.values())
    fps = {i: fingerprint(t) for t, i in first.items()}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {i for i in ids if find(i) == i}
    assert {r.doc_id for r in steps["near"]} == kept and len(kept) < len(ids)
    texts = dict((i, t) for i, t, _, _ in rows)
    copies = {}
    for r in steps["mix"]:
        assert r.text == texts[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == plain_mix([(i, t, s) for i, t, _, s in rows if i in kept])
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(steps["bpe"]) == len(steps["mix"])
    for r in steps["bpe"]:
        want = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.decoded == lib.decode(want, skip_special_tokens=False) and r.n_tokens == len(want)
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens").collect()
    assert sorted(whole) == sorted((r.doc_id, r.n_tokens) for r in steps["bpe"])


def test_pipeline_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with word ends marked) and itself, each hashed
to a row of an embedding table; unseen misspellings share most of their n-grams with what was seen.
The mean of a passage's word vectors goes into a linear softmax.  A passage is a run of ``window``
words; passages overlap by half and cover the whole text, and a text scores as its most toxic passage.  (One mean over
a whole text would thin a few toxic words out with its length.)

Training knows labels of whole texts only, so it alternates: all passages of a clean text are
clean, and of a toxic text only the passages that the model now finds worst are toxic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import shuffled, thinned

#: A run of more than 64 word characters is read in consecutive pieces of 64.
WORD = re.compile(r"\w{1,64}")


def grams(word: str, buckets: int) -> list[int]:
    marked = f"<{word}>"
    out = [zlib.crc32(marked.encode()) % buckets]
    for n in range(3, 6):
        out += [zlib.crc32(marked[i : i + n].encode()) % buckets for i in range(len(marked) - n + 1)]
    return out


def windows(n: int, window: int) -> list[tuple[int, int]]:
    """Half-overlapping runs that cover n words."""
    step = max(1, window // 2)
    return [(a, min(a + window, n)) for a in range(0, max(1, n - window + step), step)] if n else []


@dataclass(frozen=True)
class Model:
    """``table``: embedding of each bucket; ``weights``, ``bias``: the softmax's two classes; folded into one value a bucket by :meth:`values`."""

    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    window: int

    def values(self) -> np.ndarray:
        return (self.table @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


class Scorer:
    """Scores texts; a word's contribution is kept for words seen before, up to ``most`` of them."""

    def __init__(self, values: np.ndarray, bias: float, window: int, most: int = 500_000):
        self.values, self.bias, self.window, self.most, self.known = values, bias, window, most, {}

    def word(self, w: str) -> float:
        v = self.known.get(w)
        if v is None:
            v = float(self.values[grams(w, len(self.values))].mean())
            if len(self.known) < self.most:
                self.known[w] = v
        return v

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.logit(text), -50, 50))))

    def logit(self, text: str | None) -> float:
        words = WORD.findall((text or "").lower())
        if not words:
            return self.bias
        known, word = self.known, self.word
        v = np.array([known[w] if w in known else word(w) for w in words])
        sums = np.concatenate(([0.0], np.cumsum(v)))
        step = max(1, self.window // 2)
        a = np.arange(0, max(1, len(v) - self.window + step), step)
        b = np.minimum(a + self.window, len(v))
        return float(((sums[b] - sums[a]) / np.maximum(b - a, self.window // 4)).max()) + self.bias


def unseen_lines(texts: list[str]) -> list[str]:
    """Texts without the lines that an earlier one has: copies would teach their chance words."""
    seen: set[str] = set()
    out = []
    for t in texts:
        lines = t.lower().split("\n")
        out.append("\n".join(x for x in lines if x not in seen))
        seen.update(lines)
    return out


def fit(texts: list[str], labels: np.ndarray, buckets: int = 1 << 20, dim: int = 8, window: int = 16, rounds: int = 4, epochs: int = 3, per_epoch: int = 4000, min_texts: int = 6, rate: float = 0.5, seed: int = 11) -> Model:
    """Joint training of embeddings and softmax by AdaGrad on passages."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    weights, bias = rng.normal(0, 0.1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    vocab: dict[str, int] = {}
    texts = unseen_lines(texts)
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in WORD.findall(t.lower())], np.int64) for t in texts]
    bags = [np.array(grams(w, buckets)) for w in vocab]
    if not bags:
        return Model(table, weights, bias, window)
    flat, size = np.concatenate(bags), np.array([len(b) for b in bags])
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    # what occurs in hardly any text is learnt by heart, not learnt: it keeps a zero vector
    texts_with = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=len(bags))
    usual = np.bincount(flat, np.repeat(texts_with, size), buckets) >= min_texts
    table[~usual] = 0
    spans = [(d, a, b) for d, x in enumerate(ids) for a, b in windows(len(x), window)]
    doc = np.array([s[0] for s in spans])
    truth = labels[doc].astype(np.int64)
    target, use = truth.copy(), np.ones(len(spans), bool)
    seen_t, seen_w, seen_b = np.full(buckets, 1e-6, np.float32), np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)

    def word_vectors() -> np.ndarray:
        return np.add.reduceat(table[flat], first, axis=0) / size[:, None]

    def all_logits() -> np.ndarray:
        v = word_vectors() @ (weights[:, 1] - weights[:, 0])
        out = np.empty(len(spans))
        k = 0
        for x in ids:
            if len(x):
                s = np.concatenate(([0.0], np.cumsum(v[x])))
                for a, b in windows(len(x), window):
                    out[k] = (s[b] - s[a]) / max(b - a, window // 4)
                    k += 1
        return out + bias[1] - bias[0]

    for r in range(rounds):
        if r:
            logit = all_logits()
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, doc, logit)
            # of a toxic text: its worst passage and those that the model already finds toxic; the others say nothing
            worst = logit >= best[doc]
            use = (truth == 0) | worst | (logit > 0)
            target = ((truth == 1) & use).astype(np.int64)
            hard = np.nonzero((truth == 0) & worst)[0]
        chosen = np.nonzero(use)[0]
        for _ in range(epochs):
            pos, neg = chosen[target[chosen] == 1], chosen[target[chosen] == 0]
            # an epoch sees a bounded random part of the passages of the (bounded) sample
            pos = rng.permutation(pos)[:per_epoch]
            neg = rng.permutation(neg)[: 2 * per_epoch]
            if r:  # and the passages that it takes for toxic in clean texts
                neg = np.concatenate([neg, rng.permutation(hard)[: 2 * per_epoch]])
            order = rng.permutation(np.concatenate([pos, neg]))
            for k in range(0, len(order), 256):
                part = order[k : k + 256]
                words = [ids[spans[i][0]][spans[i][1] : spans[i][2]] for i in part]
                n = np.array([max(len(w), window // 4) for w in words], np.float32)
                row = np.repeat(np.arange(len(part)), [len(w) for w in words])
                word = np.concatenate(words)
                cnt = size[word]
                g = flat[np.repeat(first[word], cnt) + (np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt))]
                share = np.repeat(1.0 / (cnt * n[row]), cnt).astype(np.float32)
                row = np.repeat(row, cnt)
                mean = np.zeros((len(part), dim), np.float32)
                vec = table[g] * share[:, None]
                for j in range(dim):
                    mean[:, j] = np.bincount(row, vec[:, j], len(part))
                z = mean @ weights + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(part)), target[part]] -= 1
                p /= np.sqrt(len(part))
                gw, gb, gm = mean.T @ p, p.sum(axis=0), p @ weights.T
                seen_w += gw**2
                seen_b += gb**2
                weights -= rate * gw / np.sqrt(seen_w)
                bias -= rate * gb / np.sqrt(seen_b)
                hit, inv = np.unique(g, return_inverse=True)
                grad = np.stack([np.bincount(inv, gm[row, j] * share, len(hit)) for j in range(dim)], axis=1).astype(np.float32)
                seen_t[hit] += (grad**2).mean(axis=1)
                grad[~usual[hit]] = 0
                table[hit] -= rate * grad / np.sqrt(seen_t[hit])[:, None]
    return Model(table, weights, bias, window)


def calibrate(model: Model, texts: list[str], labels: np.ndarray, weight: np.ndarray | float = 1.0, steps: int = 50) -> Model:
    """Scale and shift the logit so that the worst passage's score is a probability for the whole text (Newton steps of a two-parameter logistic fit).

    ``weight`` gives each class of the sample its share among all labelled texts.
    """
    if len(set(labels.tolist())) < 2:
        return model
    scorer = Scorer(model.values(), float(model.bias[1] - model.bias[0]), model.window)
    x = np.array([scorer.logit(t) for t in texts])
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = weight * p * (1 - p) + 1e-6
        off = weight * (p - labels)
        ga, gb = (off * x).sum() + 0.01 * (a - 1), off.sum()
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.linalg.solve(h, [ga, gb])
        a, b = max(0.05, a - np.clip(da, -1, 1)), b - np.clip(db, -2, 2)
    return Model(model.table, (model.weights * a).astype(np.float32), np.array([0.0, a * (model.bias[1] - model.bias[0]) + b], np.float32), model.window)


def class_totals(labels: DataFrame, label_col: str = "toxic") -> dict[int, int]:
    """Labelled rows of each class: two numbers."""
    return {r["y"]: r["count"] for r in labels.where(F.col(label_col).isNotNull()).groupBy((F.col(label_col) > 0).cast("int").alias("y")).count().collect()}


def label_sample(labels: DataFrame, totals: dict[int, int], label_col: str = "toxic", id_col: str = "doc_id", sample_rows: int = 2500) -> DataFrame:
    """(id, y): at most ``sample_rows`` rows of each class in a fixed shuffled order.  Small enough to go to every task, whatever the corpus."""
    out = None
    for y, n in sorted(totals.items()):
        rows = labels.where((F.col(label_col) > 0).cast("int") == y).select(F.col(id_col).alias("id"), F.lit(y).alias("y"), shuffled(F.col(id_col)).alias("k"))
        part = thinned(rows, F.col("k"), sample_rows, n).orderBy("k", "id").limit(sample_rows).drop("k")
        out = part if out is None else out.unionByName(part)
    return out


def train(docs: DataFrame, labels: DataFrame | None = None, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", sample_rows: int = 2500) -> Model:
    """Fit to the whole texts of at most ``sample_rows`` labelled rows of each class.

    ``labels`` (id, label) may come apart from the texts; its sample is then drawn first and only the
    sampled texts leave their tasks.  Rows with a null label are left out; a null text is empty; an id that several
    rows have stands for one of them.  ``sample_rows`` bounds what reaches the driver.  Three quarters train; the rest calibrates, on whole texts
    as they are scored, with the classes weighted as they occur.
    """
    source = docs if labels is None else labels
    totals = class_totals(source, label_col)
    if not totals:
        return fit([], np.zeros(0, np.int64))
    sample = label_sample(source, totals, label_col, id_col, sample_rows).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")).toPandas().sort_values("id")  # two bounded classes
    rows = rows.iloc[np.random.default_rng(5).permutation(len(rows))]
    y, chosen = rows["y"].to_numpy(np.int64), rows["text"].tolist()
    weight = np.array([totals[v] / max(1, int((y == v).sum())) for v in y])
    fits = np.zeros(len(y), bool)
    for v in totals:
        at = np.nonzero(y == v)[0]
        fits[at[: len(at) - len(at) // 4]] = True
    return calibrate(fit([t for t, f in zip(chosen, fits) if f], y[fits]), [t for t, f in zip(chosen, fits) if not f], y[~fits], weight[~fits])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``, 0 to 1, of every whole text; empty and null texts score the model's bias."""
    values, bias, window = model.values(), float(model.bias[1] - model.bias[0]), model.window
    held = docs.sparkSession.sparkContext.broadcast(values)  # buckets x 4 bytes, fixed

    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(held.value, bias, window)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype=float)

    return docs.withColumn("toxicity", F.pandas_udf(typed, "double")(F.coalesce(F.col(text_col), F.lit(""))))

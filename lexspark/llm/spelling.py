"""Grouping of spelling variants: blocked Gram matrices of letter counts propose, one edit is verified.

A word is a vector of its letters' counts.  One inserted or deleted letter moves it by a squared distance of 1, one replaced letter by 2, so words that
are one edit apart are at most two apart and of the same or adjacent length; the converse does not hold (anagrams), so edits are
verified on the code points.

*Blocks.*  Within a length, words are dealt further by how many of their letters fall into each of k classes of letters.  An insertion adds
one to one class and a replacement moves one from a class to another (or none), so a block needs only itself and the blocks one step
ahead of it: k of the next length and k (k - 1) / 2 of its own.  Each word is *at home* in its block and *visits* the blocks behind its own.  k
grows with the logarithm of the vocabulary, which keeps the blocks' sizes; the pairs compared change with it, the pairs found do not.

*Pieces.*  The home words of a block are dealt over pieces of about ``HOME`` and its visitors over pieces of about ``VISIT``, by hash and
from counted sizes, so a task's matrices are bounded however many words a block holds.  A pair meets in exactly one piece.  A piece returns one
row for each of its words that has a near word there (a count and the best), never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import cut, meet
from lexspark.llm.components import follow

HOME, VISIT = 2048, 8192
#: The letters of the contract: A-Z fall away by lower-casing.
LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
#: Cells of the comparison of candidates that are held at once.
CELLS = 1 << 22


def occurrences(docs: DataFrame, min_length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word), one row an occurrence of at least ``min_length`` letters, after the contract's deletions.

    A run shorter than that stays so, and a maximal run of that length is what the greedy pattern finds.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    rows = rows.select("run", h.alias("h"), (h % F.length("run")).cast("int").alias("at"))
    cut_out = F.concat(F.expr("substr(run, 1, at)"), F.expr("substr(run, at + 2)"))
    return rows.select(F.when(F.col("h") % 31 == 0, cut_out).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)


def class_counts(word: Column, classes: int) -> list[Column]:
    """How many letters of ``word`` are in each class; the letters are dealt to the classes in turn by code point."""
    return [F.length(word) - F.length(F.translate(word, "".join(x for x in LETTERS if ord(x) % classes == k), "")) for k in range(classes)]


def _near(a: np.ndarray, b: np.ndarray, la: int, lb: int) -> np.ndarray:
    """Row by row: whether code points ``a`` and ``b`` (lengths la <= lb <= la + 1) differ by exactly one edit."""
    if la == lb:
        return (a != b).sum(1) == 1
    head = np.logical_and.accumulate(a == b[:, :la], axis=1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= la


def _points(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)


def _letters(points: np.ndarray) -> np.ndarray:
    """Counts of each letter, a row a word; in double precision where squares of counts need it."""
    n, length = points.shape
    at = np.where(points < 0xC0, points - ord("a"), points - 0xC0 + 26).astype(np.int64)
    flat = np.bincount((at + np.arange(n)[:, None] * len(LETTERS)).ravel(), minlength=n * len(LETTERS))
    return flat.reshape(n, -1).astype(np.float32 if length < 1000 else np.float64)


def piece_links(home: pd.DataFrame, visit: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, best_n, best) for every word of a piece that has a near word in it.

    ``home`` and ``visit`` have (word, n) and ``visit`` also ``step``: 0 for words of the home block itself, which see each other from both
    sides and therefore count on the home side only.  Home words are all of one length.
    """
    if home.empty or visit.empty:
        return pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []})
    words_a, words_b = home["word"].tolist(), visit["word"].tolist()
    names = np.array(words_a + words_b)
    n = np.concatenate([home["n"].to_numpy(), visit["n"].to_numpy()])
    # a word's place in the order "largest n, then smallest word" decides who is best
    order = np.lexsort((names, -n))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    counts, best = np.zeros(len(order), np.int64), np.full(len(order), len(order), np.int64)

    pa = _points(words_a)
    ga, la = _letters(pa), pa.shape[1]
    used = np.nonzero(ga.any(0))[0]  # other letters have no part in a product
    # squared distance less 1.5 as one product: (-2a, a.a - 1.5, 1) . (b, 1, b.b)
    left = np.hstack([-2 * ga[:, used], (ga * ga).sum(1)[:, None] - 1.5, np.ones((len(ga), 1))]).astype(ga.dtype)
    steps = visit["step"].to_numpy()
    lengths = np.fromiter(map(len, words_b), np.int64, len(words_b))
    for step, lb in sorted({*zip(steps.tolist(), lengths.tolist())}):
        rows = np.nonzero((steps == step) & (lengths == lb))[0]
        pb_all = _points([words_b[r] for r in rows])
        for lo in range(0, len(rows), 1024):
            pb = pb_all[lo : lo + 1024]
            gb = _letters(pb)
            right = np.hstack([gb[:, used], np.ones((len(gb), 1)), (gb * gb).sum(1)[:, None]]).astype(gb.dtype)
            d = left @ right.T
            i, j = np.divmod(np.flatnonzero(np.abs(d, out=d) < 1), len(gb))
            size = max(1, CELLS // max(la, 1))
            for k in range(0, len(i), size):
                x, y = i[k : k + size], j[k : k + size]
                ok = _near(pa[x], pb[y], la, lb)
                x, y = x[ok], rows[lo + y[ok]] + len(words_a)
                np.add.at(counts, x, 1)
                np.minimum.at(best, x, place[y])
                if step:
                    np.add.at(counts, y, 1)
                    np.minimum.at(best, y, place[x])
    hit = np.nonzero(counts)[0]
    top = order[best[hit]]
    return pd.DataFrame({"word": names[hit].astype(object), "n_near": counts[hit], "best_n": n[top], "best": names[top].astype(object)})


def links(words: DataFrame, home: int = HOME, visit: int = VISIT, classes: int | None = None) -> DataFrame:
    """(word, n_near, best_n, best) from a table (word, n) of distinct words; words without a near word are absent."""
    classes = classes or 1 + math.ceil(max(0.0, math.log(max(1, words.count()) / 4000, 8)))
    v = words.select("word", "n", F.array(*class_counts(F.col("word"), classes)).alias("v"))

    def moved(*by: tuple[int, int]) -> Column:
        out = [F.col("v")[k] + sum(d for at, d in by if at == k) for k in range(classes)]
        return F.when(F.array_min(F.array(*out)) >= 0, F.array(*out))

    behind = [moved((k, -1)) for k in range(classes)] + [moved((k, 1), (m, -1)) for k in range(classes) for m in range(k + 1, classes)]
    name = lambda c: F.array_join(c.cast("array<string>"), ".")
    visits = F.array_compact(F.array(F.struct(F.col("v").alias("b"), F.lit(0).alias("step")), *(F.when(b.isNotNull(), F.struct(b.alias("b"), F.lit(1).alias("step"))) for b in behind)))
    homes = cut(v.select("word", "n", name(F.col("v")).alias("block")))
    guests = cut(v.select("word", "n", F.explode(visits).alias("x")).select("word", "n", name(F.col("x.b")).alias("block"), "x.step"))

    sizes = homes.groupBy("block").agg(F.count(F.lit(1)).alias("_h")).join(guests.groupBy("block").agg(F.count(F.lit(1)).alias("_g")), "block")
    pieces = cut(sizes.select("block", F.ceil(F.col("_h") / home).cast("int").alias("hp"), F.ceil(F.col("_g") / visit).cast("int").alias("gp")))
    n = pieces.count()
    split = lambda of, salt: F.pmod(F.xxhash64(F.lit(salt), "word"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    at_home = meet(homes, pieces, ["block"], n).withColumn("i", split("hp", "home")).withColumn("j", each("gp"))
    guests = meet(guests, pieces, ["block"], n).withColumn("j", split("gp", "visit")).withColumn("i", each("hp"))
    rows = at_home.select("block", "i", "j", "word", "n", F.lit(-1).alias("step")).unionByName(guests.select("block", "i", "j", "word", "n", "step"))

    def piece(part: pd.DataFrame) -> pd.DataFrame:
        mine = part["step"] < 0
        return piece_links(part[mine].reset_index(drop=True), part[~mine].reset_index(drop=True))

    found = rows.groupBy("block", "i", "j").applyInPandas(piece, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a word of at least ``min_length`` code points and ``min_count`` occurrences: ``word, n, n_near, form, form_n, root``.

    ``form`` is the near word of largest n (of equal ones the smallest in code-point order) where that n is at least ``ratio`` times the word's;
    ``root`` is the last form reached by following forms, the word itself where it has none.  Forms have larger n, so there is no cycle.
    A null text has no words; a null id counts as an empty one in the rule of deletions.  Repeated rows count each.  Other columns are ignored, whatever
    their names.  An empty table gives an empty result.
    """
    words = cut(occurrences(docs, min_length, id_col, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))
    near = links(words)
    out = cut(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")).alias("form"),
            F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_n")).alias("form_n"),
        )
    )
    moving = out.where("form is not null").select(F.col("word").alias("node"), F.col("form").alias("up"))
    ends = moving.select(F.col("up").alias("node")).distinct().join(moving.select("node"), "node", "left_anti")
    up = cut(moving.unionByName(ends.select("node", F.col("node").alias("up"))))
    if up.isEmpty():
        return out.withColumn("root", F.col("word"))
    roots = follow(up, up.count(), 1 << 17)
    return out.join(roots.withColumnRenamed("node", "word"), "word", "left").withColumn("root", F.coalesce("root", "word"))

"""TF-IDF index, similarity search and top-k."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.sources.shared import cut


def tokens(c: Column, mode: str = "words") -> Column:
    """Terms of a text in lower case, as an array: runs of letters, digits and underscores, or (``spaces``) of anything but white space."""
    if mode not in ("words", "spaces"):
        raise ValueError(f"unknown mode: {mode}")
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+" if mode == "words" else r"(?U)\S+"), F.lit(0))


def postings(docs: DataFrame, id_col: str, text_col: str, mode: str = "words") -> DataFrame:
    """(id, term, tf)."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col), mode)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def positional(docs: DataFrame, id_col: str, text_col: str, weights: DataFrame, dim: int, counted: bool = False) -> DataFrame:
    """(id, pos, w): slot i of a text holds the idf of its i-th term (``counted``: times how often the text has it), for the first ``dim`` terms.

    That is the vector the fallback index compares, slot by slot; a term that ``weights`` lacks weighs 1.  The first ``dim`` slots are the vector's
    length, not a cut of the text: counts are of the whole text.
    """
    terms = docs.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col), "spaces")).alias("pos", "term"))
    n = F.count(F.lit(1)).over(Window.partitionBy("id", "term")) if counted else F.lit(1)
    slots = terms.withColumn("n", n).where(F.col("pos") < dim).join(weights.select("term", "idf"), "term", "left")
    return slots.select("id", "pos", (F.col("n") * F.coalesce("idf", F.lit(1.0))).alias("w"))


def positional_search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query by the cosine of two :func:`positional` vectors."""
    unit = lambda v: v.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))
    met = unit(queries).select(F.col("id").alias("query_id"), "pos", F.col("w").alias("qw")).join(unit(index), "pos")
    return top_k(met.groupBy("query_id", "id").agg(F.round(F.sum(F.col("qw") * F.col("w")), 6).alias("score")), k)


def idf(post: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + N) / (1 + df)) + 1; ``n_docs`` is one row with ``n``."""
    counts = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.crossJoin(F.broadcast(n_docs)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(post: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, term, w): tf x idf over the vector's length; terms that the index lacks fall away."""
    raw = post.join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / F.when(norm > 0, norm).otherwise(1.0)).alias("w"))


def cosine_search(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, id, score) of pairs that share a term: a sparse equi-join on the term, summed before the shuffle."""
    pairs = queries.select(F.col("id").alias("query_id"), "term", F.col("w").alias("qw")).join(index, "term")
    return pairs.groupBy("query_id", "id").agg(F.round(F.sum(F.col("qw") * F.col("w")), 6).alias("score"))


#: Scores are compared after rounding to six digits, so a bound must be below the threshold by more than that.
SLACK = 2e-6


def bounded_scores(queries: DataFrame, index: DataFrame, k: int, seeds: int = 4) -> DataFrame:
    """(query_id, id, score) of every pair that can be among a query's ``k`` best, and perhaps of some that can't: :func:`top_k` of it is that of :func:`cosine_search`.

    1.  A term adds at most ``qw`` times its largest weight in the index.
    2.  A first threshold: the rarest terms of a query, as many as have about ``seeds * k`` postings together, give rows that are scored in full; the k-th
        best of them is a score that k rows reach.
    3.  Terms whose part of the query is shorter than the threshold can't make a row one of the best alone.  Only the postings of the other
        terms are read; the longest lists, those of common words, are left out first.
    4.  A row whose score over those terms, with all that the terms left out could add to what is left of its length, stays below the
        threshold is dropped; the rest is scored in full.

    Tables are written between the steps, as each is used twice.
    """
    q = queries.select(F.col("id").alias("query_id"), "term", F.col("w").alias("qw"))
    terms = index.groupBy("term").agg(F.max("w").alias("_most"), F.count(F.lit(1)).alias("_df"))
    q = cut(q.join(terms, "term").withColumn("_bound", F.col("qw") * F.col("_most")))
    index = cut(index)

    rare = Window.partitionBy("query_id").orderBy("_df", "term").rowsBetween(Window.unboundedPreceding, -1)
    first = q.withColumn("_before", F.coalesce(F.sum("_df").over(rare), F.lit(0))).where(F.col("_before") < seeds * k)
    some = first.select("query_id", "term").join(index.select("id", "term"), "term").select("query_id", "id").distinct()
    full = q.select("query_id", "term", "qw").join(some, "query_id").join(index, ["id", "term"]).groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("_s"))
    best = full.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_s")))).where(F.col("_r") == k).select("query_id", (F.col("_s") - SLACK).alias("_need"))

    # an index vector is at most 1 long, so terms left out add at most the length of the query's part: the most postings for the least length go
    least = Window.partitionBy("query_id").orderBy(F.col("qw") * F.col("qw") / F.col("_df"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = q.join(best, "query_id", "left").withColumn("_need", F.coalesce("_need", F.lit(0.0))).withColumn("_length", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(least)))
    q = cut(q.select("query_id", "term", "qw", "_need", "_bound", (F.col("_length") >= F.col("_need")).alias("_read")))
    rest = q.where("not _read").groupBy("query_id").agg(F.sum("_bound").alias("_rest"), F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("_long"))
    part = q.where("_read").join(index, "term").groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("_part"), F.sum(F.col("w") * F.col("w")).alias("_used"), F.first("_need").alias("_need"))
    at_most = F.least(F.coalesce("_rest", F.lit(0.0)), F.coalesce("_long", F.lit(0.0)) * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("_used"))))
    alive = cut(part.join(rest, "query_id", "left").where(F.col("_part") + at_most >= F.col("_need") - SLACK).select("query_id", "id", "_part"))
    more = alive.select("query_id", "id").join(q.where("not _read").select("query_id", "term", "qw"), "query_id").join(index, ["id", "term"])
    more = more.groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("w")).alias("_more"))
    return alive.join(more, ["query_id", "id"], "left").select("query_id", "id", F.round(F.col("_part") + F.coalesce("_more", F.lit(0.0)), 6).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query."""
    return top_k(bounded_scores(queries, index, k), k)


def search_post_filter(queries: DataFrame, index: DataFrame, keep: Column, k: int, over: int = 3) -> DataFrame:
    """The best ``over * k`` of all, then those that match, then k."""
    return post_filter(bounded_scores(queries, index, over * k), keep, k, over)


def search_pre_filter(queries: DataFrame, index: DataFrame, keep: Column, k: int) -> DataFrame:
    """Those that match, then k, then those with a score above zero; the threshold is one of rows that match."""
    return pre_filter(bounded_scores(queries, index.where(keep), k), F.lit(True), k)


def post_filter(scored: DataFrame, keep: Column, k: int, over: int = 3) -> DataFrame:
    """The best ``over * k`` of all, then those that match, then k."""
    return top_k(top_k(scored, over * k).where(keep).drop("rank"), k)


def pre_filter(scored: DataFrame, keep: Column, k: int) -> DataFrame:
    """Those that match, then k, then those with a score above zero."""
    return top_k(scored.where(keep), k).where("score > 0")


def _met(base: DataFrame, queries: DataFrame, piece: int, block: int):
    """Rows (asks, id, v) of ``base`` and ``queries`` grouped so that every query meets every row of its label: a label's rows are dealt over pieces and its
    queries over blocks, by counted sizes, and each block meets each piece in a group of its own."""
    sizes = base.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("_p")).join(queries.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_b")), "label")
    sizes = cut(sizes)
    part = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = base.join(sizes, "label").withColumn("i", part("_p")).withColumn("j", every("_b")).withColumn("asks", F.lit(False))
    right = queries.join(sizes, "label").withColumn("j", part("_b")).withColumn("i", every("_p")).withColumn("asks", F.lit(True))
    columns = ["label", "i", "j", "asks", "id", "v"]
    return left.select(*columns).unionByName(right.select(*columns)).groupBy("label", "i", "j")


def best_products(base: DataFrame, queries: DataFrame, piece: int = 16384, block: int = 8192) -> DataFrame:
    """(query_id, n, best): how many rows of its label other than itself a query meets, and the largest inner product by position, rounded to six digits.

    ``base`` and ``queries`` have id, label, v (an array of numbers).  The shorter of two arrays is padded with zeros and a null number is zero; a null array is
    counted and has no product.  Every pair is computed, by matrix products of a piece of rows and a block of queries; a task returns a row a query.
    """
    filled = lambda t: t.where("label is not null").select("id", "label", F.transform("v", lambda x: F.coalesce(x, F.lit(0))).alias("v"))
    base, queries = filled(base), filled(queries)

    def products(rows: pd.DataFrame) -> pd.DataFrame:
        asks, ids = rows["asks"].to_numpy(bool), rows["id"].to_numpy()
        has = rows["v"].notna().to_numpy()
        x = np.zeros((len(rows), max((len(v) for v in rows["v"][has]), default=0)))
        for i, v in zip(np.flatnonzero(has), rows["v"][has]):
            x[i, : len(v)] = v
        held, who = ids[~asks], ids[asks]
        if not len(held) or not len(who):
            return pd.DataFrame({"query_id": who[:0], "n": np.zeros(0, int), "best": np.zeros(0)})
        order = np.argsort(held, kind="stable")
        first, past = (np.searchsorted(held[order], who, side) for side in ("left", "right"))  # the rows that are the query itself
        best, right = [], x[~asks].T
        right_has = has[~asks]
        for k in range(0, len(who), 512):
            score = x[asks][k : k + 512] @ right
            score[:, ~right_has] = -np.inf
            for i, (a, z) in enumerate(zip(first[k : k + 512], past[k : k + 512])):
                score[i, order[a:z]] = -np.inf
            best.append(score.max(1))
        n = len(held) - (past - first)
        usable = right_has.sum() - np.array([right_has[order[a:z]].sum() for a, z in zip(first, past)])
        top = pd.array(np.concatenate(best), dtype=pd.ArrowDtype(pa.float64()))
        top[~has[asks] | (usable == 0)] = pd.NA
        return pd.DataFrame({"query_id": who, "n": n, "best": top})

    kind = dict(base.dtypes)["id"]
    found = _met(base, queries, piece, block).applyInPandas(products, f"query_id {kind}, n long, best double")
    return found.groupBy("query_id").agg(F.sum("n").alias("n"), F.round(F.max("best"), 6).alias("best")).where("n > 0")


def dense_search(base: DataFrame, queries: DataFrame, k: int, piece: int = 4096, block: int = 1024) -> DataFrame:
    """(query_id, id, score): of each query the ``k`` rows of its own label with the largest cosine, itself left out; ties go to the smallest id.

    ``base`` and ``queries`` have id, label, v (an array of numbers, all of a label of one length).  A label's rows are dealt over pieces and its queries over
    blocks, by counted sizes, and every block meets every piece in a task of its own: however many rows a label has, a task holds ``piece`` of them, and
    returns ``k`` a query instead of its pairs.  A null label or vector meets nothing; a vector without length has cosine 0 with all.
    """
    sound = lambda t: t.where("label is not null and v is not null").select("id", "label", F.col("v").cast("array<double>").alias("v"))
    base, queries = sound(base), sound(queries)

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        ids = rows["id"].to_numpy()
        x = np.stack(rows["v"].to_numpy()).astype(float)
        norm = np.sqrt((x * x).sum(1))
        x = x / np.where(norm > 0, norm, 1.0)[:, None]
        held, who = ids[~asks], ids[asks]
        out = []
        if len(held):
            score = np.round(x[asks] @ x[~asks].T, 6) + 0.0
            for q, row in zip(who, score):
                row[held == q] = -np.inf
                near = np.flatnonzero(row >= np.partition(row, -min(k, len(row)))[-min(k, len(row))])  # ties included
                near = near[np.lexsort((held[near], -row[near]))][:k]
                out += [(q, held[n], row[n]) for n in near if row[n] > -np.inf]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    kind = dict(base.dtypes)["id"]
    found = _met(base, queries, piece, block).applyInPandas(best, f"query_id {kind}, id {kind}, score double")
    return top_k(found, k).drop("rank")

"""Secret scan over an incremental blob ledger, in DataFrame operations only.

Every text is a *blob*, addressed by the SHA-256 of its content, and every rule has a version (the
SHA-256 of its pattern and least length).  The ledger records which (blob, rule version) pairs have been
scanned and what was found.  A scan takes a snapshot of paths (documents, or any older version of
them), drops the pairs that the ledger has, reads each remaining blob once however many paths lead
to it, and joins the findings of old and new blobs back to all paths.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import cut, meet

#: kind -> (Java pattern, characters that the match, or its group 2, must have).  Fixed values.
RULES = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12),
    "access": ("AKIA[A-Z0-9]+", 18),
    "hex": ("[0-9a-f]+", 16),
}
#: What the scan runs: the length goes into the pattern where a match is a maximal run, so that short runs are never built.
SCAN = {"assign": RULES["assign"][0], "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}"}
KINDS = tuple(RULES)


def version(kind: str) -> str:
    return hashlib.sha256(f"{RULES[kind][0]}\n{RULES[kind][1]}".encode()).hexdigest()[:16]


def empty_ledger(spark) -> tuple[DataFrame, DataFrame]:
    """(scanned, findings) of a ledger that has seen nothing."""
    return spark.createDataFrame([], "blob binary, rule string"), spark.createDataFrame([], "blob binary, rule string, kind string, start long, end long")


def _matches(text: Column, kind: str) -> Column:
    """Array of (gap before the match, match length, whether it counts), from one split and one extraction."""
    gaps = F.split(text, SCAN[kind], -1)
    hits = F.regexp_extract_all(text, F.lit(SCAN[kind]), F.lit(0))
    if kind == "assign":
        values = F.regexp_extract_all(text, F.lit(SCAN[kind]), F.lit(2))
        good = F.transform(values, lambda v: F.length(v) >= RULES[kind][1])
    else:
        good = F.transform(hits, lambda v: F.length(v) >= RULES[kind][1])
    zipped = F.arrays_zip(F.transform(gaps, lambda v: F.length(v)).alias("gap"), F.transform(hits, lambda v: F.length(v)).alias("len"), good.alias("good"))
    return F.when(text.rlike(SCAN[kind]), F.slice(zipped, 1, F.greatest(F.lit(0), F.size(hits))))


def scan(docs: DataFrame, ledger: tuple[DataFrame, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text") -> dict[str, DataFrame]:
    """Scan the blobs that the ledger has not seen.

    Returns ``scanned`` and ``findings`` (the ledger after this run; write them and hand them in
    next time) and ``paths`` (``id_col``, blob).  A null text is the empty blob.  Several rows may
    share an id (versions of one path); rows repeated whole are scanned once.  Columns other than
    the two named are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
    paths = rows.select("id", "blob")
    scanned, findings = ledger or empty_ledger(docs.sparkSession)
    # one path speaks for each blob; the texts are then dealt by (blob, path), which no group of copies can crowd
    first = paths.groupBy("blob").agg(F.min("id").alias("id"))
    rules = F.explode(F.array(*[F.lit(version(k)) for k in KINDS])).alias("rule")
    todo = first.select("blob", "id", rules).join(scanned, ["blob", "rule"], "left_anti")
    todo = todo.groupBy("blob", "id").agg(F.collect_set("rule").alias("rules")).hint("shuffle_hash")
    mine = rows.alias("r").join(todo.alias("t"), (F.col("r.blob") == F.col("t.blob")) & F.col("r.id").eqNullSafe(F.col("t.id")))
    mine = mine.select("r.blob", "r.text", "t.rules")
    hits = mine.select("blob", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.when(F.array_contains("rules", version(k)), _matches(F.col("text"), k)).alias("m")) for k in KINDS])).alias("h"))
    at = hits.where("h.m is not null").select("blob", "h.kind", F.posexplode("h.m").alias("i", "m")).dropDuplicates(["blob", "kind", "i"])
    run = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = at.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(run).cast("long"))
    rule = F.create_map(*[F.lit(x) for k in KINDS for x in (k, version(k))])[F.col("kind")]
    new = at.where("m.good").select("blob", rule.alias("rule"), "kind", (F.col("end") - F.col("m.len")).cast("long").alias("start"), "end")
    return {"scanned": scanned.unionByName(todo.select("blob", F.explode("rules").alias("rule"))), "findings": findings.unionByName(new), "paths": paths}


def report(found: dict[str, DataFrame], id_col: str = "doc_id") -> DataFrame:
    """Findings of all current rules joined back to every path: counts and the spans by start, then kind as listed.

    A path without findings has zeros and empty ``spans``.
    """
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    live = found["findings"].where(F.col("rule").isin([version(k) for k in KINDS]))
    item = F.struct("start", order[F.col("kind")].alias("o"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    per = live.groupBy("blob").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS], F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), ",").alias("spans"))
    per, paths = cut(per), cut(found["paths"])
    # the paths of a much copied blob meet its findings by broadcast, all others by shuffle
    out = meet(paths, per, ["blob"], per.count(), "left")
    return out.select(F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.coalesce("spans", F.lit("")).alias("spans"))

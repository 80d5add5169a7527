"""Scope keys, review modes, and which rules a document's scopes call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.sources.shared import shuffled

#: Names of scopes in use -> key.  Fixed values.
ALIASES = {
    "范围": "scope", "scope": "scope",
    "引用文件": "normative_references", "规范性引用": "normative_references", "normative_references": "normative_references",
    "术语": "terms_definitions", "术语和定义": "terms_definitions", "terms_definitions": "terms_definitions",
    "符号": "symbols_abbreviations", "符号和缩略语": "symbols_abbreviations", "symbols_abbreviations": "symbols_abbreviations",
    "前言": "foreword", "foreword": "foreword", "引言": "introduction", "introduction": "introduction",
    "目次": "toc", "目录": "toc", "toc": "toc", "封面": "cover", "cover": "cover",
    "正文": "other_body", "body": "other_body", "other_body": "other_body",
    "附录": "appendix", "appendix": "appendix", "参考文献": "references", "references": "references",
    "索引": "index", "index": "index", "结束": "end", "end": "end",
}

#: Scopes that a widened review looks in.  Fixed values.
WIDENED = ("cover", "toc", "foreword", "scope", "normative_references", "terms_definitions", "other_body", "appendix", "end")


def normalize_keys(keys: Column) -> Column:
    """Keys trimmed, put in their canonical form, without blanks and repeats, in order of first use."""
    table = F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p])
    held = F.filter(F.transform(keys, lambda k: T.strip(F.coalesce(k, F.lit("")))), lambda k: k != "")
    return F.array_distinct(F.transform(held, lambda k: F.coalesce(F.element_at(table, k), k)))


def canonical(keys: Column) -> Column:
    """Keys in canonical order; others fall away."""
    return F.array_intersect(F.array(*[F.lit(s) for s in T.SCOPES]), keys)


def select_scopes(rows: DataFrame, requested: list[str], map_col: str = "scopes", text_col: str = "text") -> DataFrame:
    """The requested entries of a scope map that have text; where none has, one ``full_document`` entry and a warning."""
    kept = F.map_filter(map_col, lambda k, v: k.isin(*requested) & (T.strip(v) != "")) if requested else F.map_filter(map_col, lambda k, v: T.strip(v) != "")
    whole = F.create_map(F.lit("full_document"), F.coalesce(F.col(text_col), F.lit("")))
    return rows.withColumn("_kept", kept).withColumns({"selected": F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(whole), "warning": F.when(F.size("_kept") == 0, "no requested scope has text")}).drop("_kept")


def expand_scopes(rows: DataFrame, rules: DataFrame, keys_col: str = "keys") -> DataFrame:
    """``expanded``: keys joined by the targets of cross-section rules that aim at one of them, in canonical order; ``added``: what came in."""
    aims = rules.where("analysis_mode = 'cross_section'").agg(F.collect_list("target_scopes").alias("_aims"))  # a book's rules
    rows = rows.crossJoin(F.broadcast(aims))
    hit = F.flatten(F.filter("_aims", lambda t: F.arrays_overlap(t, F.col(keys_col))))
    rows = rows.withColumn("expanded", canonical(F.array_union(keys_col, hit)))
    return rows.withColumn("added", F.array_except("expanded", keys_col)).drop("_aims")


def resolve_mode(requests: DataFrame) -> DataFrame:
    """``content``, ``format_only``, ``partial``, ``error`` of a request's mode and arguments (mode, has_content, has_source, scopes)."""
    mode, no_scope = F.col("mode"), F.coalesce(F.size("scopes"), F.lit(0)) <= 0
    content = mode.isin("full", "content", "partial", "chapters")
    formal = mode.isin("full", "format", "format_partial")
    partial = mode.isin("partial", "chapters", "format_partial")
    known = content | formal
    error = F.when(~known | mode.isNull(), "unknown mode").when(content & ~F.col("has_content"), "content is missing").when(formal & ~F.col("has_source"), "source is missing").when(partial & no_scope, "scopes are missing")
    return requests.withColumns({"content": F.coalesce(content, F.lit(False)), "format_only": F.coalesce(formal & ~content, F.lit(False)), "partial": F.coalesce(partial, F.lit(False)), "error": error})


def active_scopes(rows: DataFrame, active: str = "active", requested: str = "requested") -> DataFrame:
    """Active keys that are requested, or all of them where none is."""
    both = F.array_intersect(active, requested)
    return rows.withColumn("scopes", F.when(F.size(both) > 0, both).otherwise(F.col(active)))


def retrieve_rules(scopes: DataFrame, hits: DataFrame, rules: DataFrame, k: int = 8) -> DataFrame:
    """(doc_id, chunk_id, matched_scope, rank): for each scope that a document has, the best k rules of that scope's search.

    ``hits`` has scope, chunk_id, score: a scope's title is the query, so the search is done once a
    scope and not once a document.  Whole-document rules are left out; a rule found for several
    scopes stays with the first in canonical order.
    """
    aimed = rules.where("analysis_mode <> 'full_document'").select("chunk_id", F.col("scope").alias("_own"), "target_scopes")
    fits = (F.size("target_scopes") == 0) | F.array_contains("target_scopes", F.col("scope")) | (F.col("_own") == F.col("scope"))
    good = hits.join(aimed, "chunk_id").where(fits)
    top = good.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= k)
    order = F.create_map(*[F.lit(x) for i, s in enumerate(T.SCOPES) for x in (s, i)])
    met = scopes.select("doc_id", "scope").join(F.broadcast(top.select("scope", "chunk_id", "rank")), "scope").withColumn("_o", order[F.col("scope")])  # k rows for each of 13 scopes
    first = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy("_o"))
    return met.withColumn("_f", first).where("_f = 1").select("doc_id", "chunk_id", F.col("scope").alias("matched_scope"), "rank")


def full_document_rules(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, matched_scope): every document with the rules of the whole document, which are a book's few."""
    whole = rules.where("analysis_mode = 'full_document'").select("chunk_id", F.lit("full_document").alias("matched_scope"))
    return docs.select("doc_id").crossJoin(F.broadcast(whole))


def retrieve_again(docs: DataFrame, hits: DataFrame, rules: DataFrame, k: int = 8) -> DataFrame:
    """(doc_id, chunk_id, matched_scope) of a widened review: the best k rules of each scope in :data:`WIDENED` that aim at it, whether
    or not a document has that scope, and the rules of the whole document; all of them match the full document.

    The rules are the same for every document: at most k a scope, so they go to every task.
    """
    aimed = rules.where("analysis_mode <> 'full_document'").select("chunk_id", F.col("scope").alias("_own"), "target_scopes")
    best = Window.partitionBy("scope").orderBy(F.desc("score"), "chunk_id")
    top = hits.where(F.col("scope").isin(*WIDENED)).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).join(aimed, "chunk_id")
    fits = (F.size("target_scopes") == 0) | F.array_contains("target_scopes", F.col("scope")) | (F.col("_own") == F.col("scope"))
    section = docs.select("doc_id").crossJoin(F.broadcast(top.where(fits).select("chunk_id").distinct().withColumn("matched_scope", F.lit("full_document"))))
    return section.unionByName(full_document_rules(docs, rules))


def keyword_search(queries: DataFrame, rules: DataFrame, hits: DataFrame) -> DataFrame:
    """Score 0.5 for rules that hold any word of a query which has no hit; the words meet the rules' own words, not every rule."""
    bare = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    words = bare.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("w"))
    held = rules.select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "content", "scope")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("w"))
    return words.join(held, "w").select("query_id", "chunk_id").distinct().withColumn("score", F.lit(0.5))


def positional_cosine(q: Column, d: Column) -> Column:
    """Inner product of two weight arrays by position, the shorter padded with zeros."""
    return F.aggregate(F.zip_with(q, d, lambda a, b: F.coalesce(a, F.lit(0.0)) * F.coalesce(b, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def context_units(plans: DataFrame, units: DataFrame, limit: int = 2200) -> DataFrame:
    """The units that :func:`build_context` takes for each (doc_id, chunk_id), with ``_best``: 0 a target, 1 front matter, 2 end matter, 3 the first unit.

    ``units`` may have ``chars``, the length of a unit's text (0 for a blank one), instead of the text.
    """
    sized = "chars" in units.columns
    body = F.array(*[F.lit(s) for s in T.BODY_SCOPES])
    wants_body = F.arrays_overlap("targets", body) | F.array_contains("targets", "body")
    met = plans.select("doc_id", "chunk_id", "targets").join(shuffled(units.where(F.col("chars") > 0 if sized else T.strip(F.col("text")) != "")), "doc_id")
    tier = F.when(F.array_contains("targets", F.col("scope")) | (F.col("scope").isin(*T.BODY_SCOPES) & wants_body), 0).when(F.col("scope").isin("foreword", "introduction"), 1).when(F.col("scope").isin(*T.END_SCOPES, "end"), 2).otherwise(3)
    met = met.withColumn("_tier", tier)
    met = met.withColumn("_best", F.min("_tier").over(Window.partitionBy("doc_id", "chunk_id")))
    kept = met.where("_tier = _best")
    w = Window.partitionBy("doc_id", "chunk_id").orderBy("ord")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.col("chars") if sized else F.length("text")
    kept = kept.withColumn("_i", F.row_number().over(w)).withColumn("_sum", F.sum(n).over(run))
    over = F.when(F.col("_best") == 0, (F.col("_sum") > limit) & (F.col("_i") > 1)).when(F.col("_best") == 3, F.col("_i") > 1).otherwise((F.col("_sum") - n > limit))
    return kept.withColumn("_over", F.max(over.cast("int")).over(run)).where("_over = 0").drop("_over", "_i", "_sum", "_tier")


def build_context(plans: DataFrame, units: DataFrame, limit: int = 2200) -> DataFrame:
    """(doc_id, chunk_id, context): units of a rule's targets in order within the budget; without any, front matter, then end matter, then the first unit's head.

    ``plans`` has doc_id, chunk_id, targets; ``units`` has doc_id, ord, scope, heading, text.
    """
    kept = context_units(plans, units, limit)
    piece = F.when(F.col("_best") == 3, F.substring("text", 1, limit)).otherwise(F.concat(F.lit("## "), F.coalesce(F.nullif("heading", F.lit("")), "scope"), F.lit("\n"), "text"))
    return kept.groupBy("doc_id", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", piece.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))

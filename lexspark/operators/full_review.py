"""A review from documents to issues: retrieve rules, choose contexts, judge, check coverage and format, widen where context lacked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import audit, review, scopes
from lexspark.sources.shared import cut, shuffled

ISSUE = ("doc_id", "rule_id", "scope", "status", "severity", "confidence", "actual", "strategy", "round", "audit_track")


def contexts(plans: DataFrame, units: DataFrame, limit: int = 2200) -> DataFrame:
    """(doc_id, chunk_id, length, units): what a rule's context is made of and how long it is, from lengths alone.

    ``units`` has doc_id, ord, chars and title_chars; the context is put together by :func:`texts`, of the units whose ``ord`` is listed.
    """
    kept = scopes.context_units(plans, units, limit)
    whole = F.sum(F.col("chars") + F.col("title_chars") + 4) + 2 * (F.count(F.lit(1)) - 1)
    length = F.when(F.max("_best") == 3, F.least(F.max("chars"), F.lit(limit))).otherwise(whole)
    return kept.groupBy("doc_id", "chunk_id").agg(length.alias("length"), (F.max("_best") == 3).alias("head_only"), F.array_sort(F.collect_list("ord")).alias("units"))


def texts(planned: DataFrame, units: DataFrame, limit: int = 2200) -> DataFrame:
    """``planned`` with ``context``: only now are texts read, those of the units that a context takes."""
    rows = planned.select("doc_id", "chunk_id", "head_only", F.explode("units").alias("ord")).join(shuffled(units.select("doc_id", "ord", "scope", "heading", "text")), ["doc_id", "ord"])
    titled = F.concat(F.lit("## "), F.coalesce(F.nullif("heading", F.lit("")), "scope"), F.lit("\n"), "text")
    piece = F.when(F.col("head_only"), F.substring("text", 1, limit)).otherwise(titled)
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("ord", piece.alias("p")))).getField("p"), "\n\n")
    made = rows.groupBy("doc_id", "chunk_id").agg(joined.alias("context"))
    return planned.join(shuffled(made), ["doc_id", "chunk_id"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def prompt(related: Column) -> Column:
    """What the judge is asked, in the form of the plan's strategy; needs strategy, chunk_id, title, scope, content, target_scopes and part."""
    rule = F.concat(F.lit("rule: "), "title", F.lit(" ("), "chunk_id", F.lit(")\n"), "content")
    asked = F.concat_ws(", ", F.when(F.size("target_scopes") > 0, F.col("target_scopes")).otherwise(F.array("scope")))
    lead = (
        F.when(F.col("strategy") == "window", F.concat(rule, F.lit("\n\nrelated rules:\n"), F.coalesce(F.nullif(related, F.lit("")), F.lit("none")), F.lit("\n\ntext, a window of a longer one:\n")))
        .when(F.col("strategy") == "cross_section", F.concat(rule, F.lit("\nsections asked for: "), asked, F.lit("\n\ntext of several sections:\n")))
        .when(F.col("strategy") == "full_document", F.concat(rule, F.lit("\n\ntext of the document:\n")))
        .otherwise(F.concat(rule, F.lit("\napplies to: "), "scope", F.lit("\n\ntext:\n")))
    )
    return F.concat(lead, "part", F.lit("\n\nAnswer with one JSON object: pass, severity_level, confidence, actual, evidence_text, suggestion, reasoning."))


def judged(picks: DataFrame, units: DataFrame, rules: DataFrame, judge, limit: int, most: int) -> DataFrame:
    """Issues of one round: (doc_id, rule_id, scope, status, severity, confidence, actual, strategy).

    A context longer than ``most`` is judged in windows of ``limit`` characters, whatever its strategy, so all of it is read; the worst answer counts.
    """
    book = rules.select("chunk_id", "title", "scope", "content", "analysis_mode", "target_scopes")
    same = rules.select(F.explode(F.when(F.size("target_scopes") > 0, F.col("target_scopes")).otherwise(F.array("scope"))).alias("t"), "chunk_id", "title")
    beside = same.alias("a").join(same.alias("b"), (F.col("a.t") == F.col("b.t")) & (F.col("a.chunk_id") != F.col("b.chunk_id")))
    beside = beside.groupBy(F.col("a.chunk_id").alias("chunk_id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), F.col("b.chunk_id"), F.lit(": "), F.col("b.title")))), "\n").alias("related"))
    sizes = units.select("doc_id", "ord", "scope", F.when(T.strip(F.col("text")) == "", 0).otherwise(F.length("text")).alias("chars"), F.length(F.coalesce(F.nullif("heading", F.lit("")), "scope")).alias("title_chars"))
    plan = picks.select("doc_id", "chunk_id").join(F.broadcast(book), "chunk_id")
    chosen = contexts(plan.select("doc_id", "chunk_id", F.col("target_scopes").alias("targets")), sizes, limit)
    plan = plan.join(shuffled(chosen), ["doc_id", "chunk_id"], "left").withColumn("length", F.coalesce("length", F.lit(0)))
    plan = cut(plan.withColumn("strategy", review.strategy(F.col("analysis_mode"), F.col("length"), most=most)).where("strategy <> 'skip'"))
    asked = texts(plan, units, limit).join(F.broadcast(beside), "chunk_id", "left")
    asked = asked.withColumn("part", F.explode(F.when(F.length("context") > most, review.windows(F.col("context"), limit)).otherwise(F.array("context"))))
    asked = asked.select("doc_id", F.col("chunk_id").alias("rule_id"), prompt(F.col("related")).alias("prompt"))
    answers = review.offline_judge(asked) if judge is None else review.with_judge(asked, judge)
    found = review.judge_issues(answers)
    worst = F.max_by(F.struct("status", "severity", "confidence", "actual"), F.struct((F.col("status") == "fail").cast("int"), "confidence"))
    found = found.groupBy("doc_id", "rule_id").agg(worst.alias("w")).select("doc_id", "rule_id", "w.*")
    return found.join(shuffled(plan.select("doc_id", F.col("chunk_id").alias("rule_id"), "scope", "strategy")), ["doc_id", "rule_id"])


def coverage(picks: DataFrame, held: DataFrame, rules: DataFrame) -> DataFrame:
    """Scopes that the rules picked for a document ask for and that it has no text in, each named by the first such rule (``held``: doc_id, scopes)."""
    asked = picks.select("doc_id", "chunk_id").join(F.broadcast(review.targets(rules)), "chunk_id")
    first = asked.groupBy("doc_id", F.col("target").alias("scope")).agg(F.min(F.struct("ord", "chunk_id")).alias("r"))
    have = held.select("doc_id", F.explode("scopes").alias("scope"))
    return first.join(shuffled(have), ["doc_id", "scope"], "left_anti").select("doc_id", F.col("r.chunk_id").alias("rule_id"), "scope")


def full_review(units: DataFrame, held: DataFrame, rules: DataFrame, hits: DataFrame, facts: DataFrame | None = None, judge=None, max_rounds: int = 2, k: int = 8, limit: int = 2200, most: int = 3600) -> DataFrame:
    """Issues (:data:`ISSUE`) of every document of ``held`` (doc_id, scopes).

    ``units`` has doc_id, ord, scope, heading, text; ``hits`` (scope, chunk_id, score) is the search of the rules for each scope; ``facts`` adds the format
    track.  Round 1 judges the rules that the document's own scopes retrieve and those of the whole document.  A document that was left
    with insufficient context is judged again by the rules of the widened scopes, up to ``max_rounds``.  Rounds are written, so none is computed twice.
    Only the book goes to every task; what grows with the corpus meets by shuffles.
    """
    docs, units = held.select("doc_id"), cut(units)
    picks = scopes.retrieve_rules(held.select("doc_id", F.explode("scopes").alias("scope")), hits, rules, k).select("doc_id", "chunk_id")
    picks = cut(picks.unionByName(scopes.full_document_rules(docs, rules).select("doc_id", "chunk_id")))
    fixed = coverage(picks, held, rules).select("doc_id", "rule_id", "scope", F.lit("warn").alias("status"), F.lit("中度").alias("severity"), F.lit(0.6).alias("confidence"), F.lit("").alias("actual"), F.lit("scope_coverage").alias("strategy"))
    out = fixed.withColumns({"round": F.lit(1), "audit_track": F.lit("content_llm")})
    for n in range(1, max_rounds + 1):
        found = cut(judged(picks, units, rules, judge, limit, most))
        out = out.unionByName(found.withColumns({"round": F.lit(n), "audit_track": F.lit("content_llm")}))
        lacking = found.where("status = 'insufficient_context'").select("doc_id").distinct()
        if n == max_rounds or lacking.isEmpty():
            break
        picks = cut(scopes.retrieve_again(lacking, hits, rules, k).select("doc_id", "chunk_id").distinct())
    if facts is not None:
        formal = audit.format_issues(facts, docs)
        out = out.unionByName(formal.select("doc_id", "rule_id", F.lit("format").alias("scope"), "status", "severity", F.lit(1.0).alias("confidence"), F.col("reason").alias("actual"), F.lit("deterministic").alias("strategy"), F.lit(1).alias("round"), F.lit("format").alias("audit_track")))
    return out.select(*ISSUE)

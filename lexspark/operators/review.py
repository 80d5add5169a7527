"""Documents against rules: coverage, presence, plans, contexts, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.sources.shared import cut, shuffled


def targets(rules: DataFrame) -> DataFrame:
    """Rules exploded to the scopes that they ask for: their targets, or their own scope."""
    asked = F.when(F.size("target_scopes") > 0, F.col("target_scopes")).otherwise(F.array("scope"))
    return rules.select(F.explode(asked).alias("target"), "chunk_id", "title", "content", "ord").where("target <> ''")


def _lacking(docs: DataFrame, held: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, scope) and what ``asked`` says of the scope, for each asked scope that a document has no text in.

    ``held`` has one row a document with its ``scopes`` as an array, so documents meet it once by id; the
    asked scopes are a handful whatever the corpus and go to every task.
    """
    want = asked.agg(F.collect_set("scope").alias("_want"))
    none = F.array().cast("array<string>")
    rows = docs.select("doc_id").join(held, "doc_id", "left").crossJoin(F.broadcast(want))
    rows = rows.select("doc_id", F.explode(F.array_except("_want", F.coalesce("scopes", none))).alias("scope"))
    return rows.join(F.broadcast(asked), "scope")


def coverage_issues(docs: DataFrame, held: DataFrame, rules: DataFrame) -> DataFrame:
    """One ``warn`` issue for each required scope that a document has no text in (``held``: doc_id, scopes); the first rule that asks for it names it."""
    first = targets(rules).groupBy(F.col("target").alias("scope")).agg(F.min_by("chunk_id", "ord").alias("rule_id"), F.min_by("title", "ord").alias("rule_name"), F.min_by("content", "ord").alias("expected"))
    missing = _lacking(docs, held, first)
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy("scope"))
    issue = F.concat(F.lit("COVERAGE-"), "rule_id", F.lit("-"), F.lpad(no.cast("string"), 3, "0"))
    return missing.withColumn("issue_id", issue).withColumns({"status": F.lit("warn"), "severity": F.lit("中度"), "confidence": F.lit(0.6), "audit_track": F.lit("content_llm")})


def presence_issues(docs: DataFrame, rules: DataFrame, held: DataFrame) -> DataFrame:
    """Local rules whose scope has no text in a document (``held``: doc_id, scopes)."""
    lacks = _lacking(docs, held, rules.where("analysis_mode = 'local'").select(F.col("chunk_id").alias("rule_id"), "scope", "ord"))
    return lacks.withColumn("status", F.lit("insufficient_context")).withColumn("issue_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))


def strategy(mode: Column, context: Column, least: int = 40, most: int = 3600) -> Column:
    """How a rule is judged, from its mode and the length of its context."""
    return F.when(mode.isin("full_document", "cross_section"), mode).when((mode == "deterministic") | (context < least), "skip").when((mode == "local") & (context > most), "window").otherwise("single")


def plans(docs: DataFrame, rules: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, strategy): every document with every rule, by the length of the rule's scope (``sizes``: doc_id, sizes, a map)."""
    want = F.broadcast(rules.select("chunk_id", "scope", "analysis_mode"))
    met = docs.select("doc_id").join(sizes, "doc_id", "left").crossJoin(want)
    return met.withColumn("strategy", strategy(F.col("analysis_mode"), F.coalesce(F.element_at("sizes", F.col("scope")), F.lit(0)))).drop("sizes")


def within_budget(parts: DataFrame, limit: int) -> DataFrame:
    """Sections in order while their total length fits; the first always does, and the first that does not fit ends it."""
    run = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = parts.withColumn("_over", (F.sum(F.length("text")).over(run) > limit) & (F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) > 1))
    return total.withColumn("_over", F.max(F.col("_over").cast("int")).over(run)).where("_over = 0").drop("_over")


def audit_counts(issues: DataFrame) -> DataFrame:
    """Counters by document."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), n("pass"), n("fail"), n("warn"), n("info"), n("insufficient_context"), n("llm_error"), n("not_ready"))


def scope_summary(issues: DataFrame) -> DataFrame:
    """Buckets by track and scope; a missing scope is ``full_document``, a missing track ``content_llm``."""
    track, scope = F.coalesce(F.nullif("audit_track", F.lit("")), F.lit("content_llm")), F.coalesce(F.nullif("scope", F.lit("")), F.lit("full_document"))
    n = lambda s: F.count_if(F.col("status") == s)
    return issues.groupBy(track.alias("track"), scope.alias("scope")).agg(F.count(F.lit(1)).alias("total"), n("fail").alias("fail"), n("warn").alias("warn"), n("pass").alias("pass"), n("insufficient_context").alias("insufficient"))


def review_summary(issues: DataFrame) -> DataFrame:
    """One row for the whole corpus: counts, and maps by severity and by track."""
    each = issues.groupingSets([["severity"], ["audit_track"], []], "severity", "audit_track").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("fail", "warn", "insufficient_context")])
    as_map = lambda g, k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("g") == g, F.struct(F.coalesce(F.col(k), F.lit("")), "n")))))
    return each.agg(*[F.max(F.when(F.col("g") == 3, F.col(c))).alias(a) for c, a in (("n", "total_issues"), ("fail", "failed"), ("warn", "warn"), ("insufficient_context", "insufficient_context"))], as_map(1, "severity").alias("by_severity"), as_map(2, "audit_track").alias("by_track"))


def verdict(issues: DataFrame) -> DataFrame:
    """Whether a document passes: no failure and nothing critical."""
    bad = (F.col("status") == "fail") | (T.severity(F.col("severity")) == "critical")
    return issues.groupBy("doc_id").agg((F.count_if(bad) == 0).alias("passed"))


def insufficient_scopes(issues: DataFrame) -> DataFrame:
    """Scopes without enough context, in the order they were first seen."""
    first = issues.where("status = 'insufficient_context'").groupBy("doc_id", "scope").agg(F.min("ord").alias("ord"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "scope"))), lambda x: x["scope"]).alias("scopes"))


def issue_digest(issues: DataFrame, most: int = 6) -> DataFrame:
    """Per document: total, issues by severity (in the order first seen), the three scopes with most issues (ties: first seen), what the first ``most``
    issues suggest, and the first ``most`` different rules without enough context.

    ``issues`` has doc_id, ord, scope, status, severity, rule_name and, if there, suggestion.
    """
    listed = lambda order, text: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("s")))), lambda x: x["s"])
    levels = issues.groupBy("doc_id", F.coalesce("severity", F.lit("")).alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    levels = levels.groupBy("doc_id").agg(F.array_join(listed("first", F.concat_ws(" ", "severity", "n")), ", ").alias("severities"))
    by = issues.groupBy("doc_id", "scope").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("o"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "o"))
    tops = by.withColumn("r", rank).where("r <= 3").groupBy("doc_id").agg(F.array_join(listed("r", F.concat("scope", F.lit("（"), F.col("n").cast("string"), F.lit(" 项）"))), "、").alias("top_scopes"))
    thin = issues.where("status = 'insufficient_context'").groupBy("doc_id", "rule_name").agg(F.min("ord").alias("first"))
    thin = thin.groupBy("doc_id").agg(F.array_join(F.slice(listed("first", F.col("rule_name")), 1, most), "、").alias("insufficient"))
    out = issues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total")).join(levels, "doc_id").join(tops, "doc_id", "left").join(thin, "doc_id", "left")
    if "suggestion" in issues.columns:
        first = issues.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where((F.col("r") <= most) & (F.coalesce("suggestion", F.lit("")) != ""))
        out = out.join(first.groupBy("doc_id").agg(F.array_join(listed("r", F.col("suggestion")), "；").alias("suggestions")), "doc_id", "left").withColumn("suggestions", F.coalesce("suggestions", F.lit("")))
    return out.withColumn("insufficient", F.coalesce("insufficient", F.lit("")))


def render_report(issues: DataFrame, per_page: int = 500) -> DataFrame:
    """(doc_id, page, report): text of a document's issues in order, on numbered pages of at most ``per_page`` issues, so no value grows with a document."""
    line = F.format_string("%d. [%s] %s：%s", F.col("ord"), F.col("status"), F.col("rule_name"), F.col("scope"))
    page = F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1) / per_page) + 1
    rows = issues.select("doc_id", "ord", line.alias("s"), page.cast("int").alias("page"))
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("ord", "s"))).getField("s"), "\n").alias("report"))


def judge_object(response: Column) -> Column:
    """The JSON object of a judge's answer: the whole, without a code fence, or from the first brace to the last; else null."""
    bare = F.regexp_replace(response, r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    inner = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.get_json_object(c, "$").startswith("{"), c)
    return F.coalesce(ok(bare), ok(inner))


def judge_issues(answers: DataFrame, floor: float = 0.35) -> DataFrame:
    """(doc_id, rule_id, status, severity, confidence, actual) from (doc_id, rule_id, response) and, if there, ``error``.

    A pass gives none, confidence up to ``floor`` is insufficient context, an unreadable or missing answer is a low-confidence record.  A
    call that failed (``error``) is a failure that a person must look at, with the error's first 200 characters, whatever its answer says.
    """
    failed = F.col("error").isNotNull() if "error" in answers.columns else F.lit(False)
    held = answers.withColumn("_o", F.when(~failed, judge_object(F.col("response")))).withColumn("_failed", failed)
    get = lambda k: F.get_json_object("_o", f"$.{k}")
    confidence = F.when(F.col("_o").isNull(), 0.1).otherwise(F.coalesce(get("confidence").try_cast("double"), F.lit(0.0)))
    rows = held.withColumn("confidence", confidence).where(F.col("_o").isNull() | (F.coalesce(get("pass"), F.lit("false")) != "true"))
    status = F.when(F.col("_failed") | (F.col("confidence") > floor), "fail").otherwise("insufficient_context")
    severity = F.coalesce(get("severity_level"), get("severity"), F.when(F.col("_o").isNull(), "轻度"), F.lit("中度"))
    error = F.substring("error", 1, 200) if "error" in answers.columns else F.lit("")
    actual = F.when(F.col("_failed"), F.concat(F.lit("LLM 审核异常："), error)).when(F.col("_o").isNull(), "无法解析 LLM 响应").otherwise(F.coalesce(F.nullif(get("actual"), F.lit("")), F.lit("未在文档中明确说明")))
    return rows.select("doc_id", "rule_id", status.alias("status"), severity.alias("severity"), "confidence", actual.alias("actual"))


def offline_judge(plans: DataFrame) -> DataFrame:
    """``response`` of every plan without a model: a constant failure of low confidence."""
    return plans.withColumn("response", F.lit('{"pass": false, "severity_level": "轻度", "confidence": 0.1}'))


def with_judge(plans: DataFrame, judge) -> DataFrame:
    """``response`` and ``error`` from ``judge(prompt) -> str``, called inside the tasks; a call that fails fails its own row only."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for prompt in batch["prompt"]:
                try:
                    texts.append(judge(prompt))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  whatever the caller's judge raises is noted on its row
                    texts.append(None)
                    errors.append(str(e)[:200])
            yield batch.assign(response=pd.Series(texts, index=batch.index, dtype=object), error=pd.Series(errors, index=batch.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plans.schema)
    return plans.mapInPandas(run, f"{fields}, response string, error string")


def prompt(strategy: Column, title: Column, content: Column, context: Column) -> Column:
    """What the judge is asked."""
    return F.concat_ws("\n", F.concat(F.lit("strategy: "), strategy), F.concat(F.lit("rule: "), title), content, F.lit("text:"), F.coalesce(context, F.lit("")))


def judged(plans: DataFrame, judge=None) -> DataFrame:
    """Issues of the plans that are not skipped."""
    asked = plans.where("strategy <> 'skip'")
    answers = offline_judge(asked) if judge is None else with_judge(asked, judge)
    return judge_issues(answers.select("doc_id", F.col("chunk_id").alias("rule_id"), "response", *[c for c in ("error",) if c in answers.columns]))


def windows(text: Column, size: int = 2200) -> Column:
    """Consecutive windows of a text: together the whole of it; an empty text is one."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size)).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def run_review(docs: DataFrame, scopes: DataFrame, rules: DataFrame, max_rounds: int = 2, judge=None, budget: int = 2200, whole_chars: int = 3600) -> DataFrame:
    """(doc_id, rule_id, status, round): a first round by scope; documents left with missing context are judged again with their whole text.

    What is judged by ``window``, every text of a later round, and any text longer than ``whole_chars`` is read in consecutive windows of ``budget``
    characters; a rule fails if it fails in any.  Shorter texts are read whole, in one piece.
    ``max_rounds`` bounds the loop.  The scopes' texts and each round's issues are written, so nothing is computed or judged twice.
    """
    scopes = cut(scopes)
    whole = scopes.where("scope <> 'end'").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("scope", "text"))).getField("text"), "\n\n").alias("_all"))
    out, todo = None, docs.select("doc_id")
    want = F.broadcast(rules.select("chunk_id", "scope", "analysis_mode", "title", "content"))
    for i in range(1, max_rounds + 1):
        plan = todo.crossJoin(want)
        if i == 1:
            plan = plan.join(shuffled(scopes.select("doc_id", "scope", F.col("text").alias("_text"))), ["doc_id", "scope"], "left")
        else:
            plan = plan.join(shuffled(whole.withColumnRenamed("_all", "_text")), "doc_id", "left")
        plan = plan.withColumn("_text", F.coalesce("_text", F.lit("")))
        plan = plan.withColumn("strategy", strategy(F.col("analysis_mode"), F.length("_text"))).where("strategy <> 'skip'")
        parts = windows(F.col("_text"), budget)
        plan = plan.withColumn("_part", F.explode(parts if i > 1 else F.when((F.col("strategy") == "window") | (F.length("_text") > whole_chars), parts).otherwise(F.array("_text"))))
        plan = plan.withColumn("prompt", prompt(F.col("strategy"), F.col("title"), F.col("content"), F.col("_part")))
        found = judged(plan.select("doc_id", "chunk_id", "strategy", "prompt"), judge)
        found = found.groupBy("doc_id", "rule_id").agg(F.when(F.bool_or(F.col("status") == "fail"), "fail").otherwise("insufficient_context").alias("status")).withColumn("round", F.lit(i))
        found = cut(found)
        out = found if out is None else out.unionByName(found)
        todo = docs.select("doc_id").join(shuffled(found.where("status = 'insufficient_context'").select("doc_id")), "doc_id", "left_semi")
    return out.select("doc_id", "rule_id", "status", "round")

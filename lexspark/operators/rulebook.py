"""Rule books in Markdown to rule rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators.segment import paragraphs

#: Scope keywords of rule-book titles in order of precedence.  Fixed values.
TITLE_SCOPES = (
    ("full_document", ("全文",)),
    ("format", ("格式规范",)),
    ("cover", ("封面",)),
    ("toc", ("目次",)),
    ("foreword", ("前言",)),
    ("introduction", ("引言",)),
    ("normative_references", ("规范性引用文件",)),
    ("terms_definitions", ("术语和定义",)),
    ("symbols_abbreviations", ("符号和缩略语", "符号缩略语", "代号和缩略语")),
    ("scope", ("范围",)),
    ("appendix", ("附录",)),
    ("references", ("参考文献",)),
    ("index", ("索引",)),
    ("body", ("正文",)),
)


def title_scope(title: Column) -> Column:
    held, found = F.replace(title, F.lit(" "), F.lit("")), F.lit("other_body")
    for scope, words in reversed(TITLE_SCOPES):
        test = F.lit(False)
        for w in words:
            test = test | held.contains(w)
        found = F.when(test, scope).otherwise(found)
    return found


def rule_sections(lines: DataFrame) -> DataFrame:
    """(doc_id, sec, title, tags, line_no, line): body lines of sections that an H1 or H2 opens.

    Deeper headings stay in the body; an H2 below 正文 or 格式规范 is titled ``H1/H2``.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pattern = r"^(#{1,2})[\x09-\x0D\x20]+(.+?)[\x09-\x0D\x20]*$"
    rows = lines.withColumn("_mark", F.regexp_extract("line", pattern, 1)).withColumn("_text", T.strip(F.regexp_extract("line", pattern, 2)))
    rows = rows.withColumn("_h1", F.last(F.when(F.col("_mark") == "#", F.col("_text")), ignorenulls=True).over(so_far))
    rows = rows.withColumn("sec", F.sum((F.col("_mark") != "").cast("int")).over(so_far)).where("sec > 0")
    opened = Window.partitionBy("doc_id", "sec")
    rows = rows.withColumn("_mark1", F.max("_mark").over(opened)).withColumn("_own", F.max("_text").over(opened))
    title = F.when((F.col("_mark1") == "##") & F.col("_h1").isin("正文", "格式规范"), F.concat_ws("/", "_h1", "_own")).otherwise(F.col("_own"))
    tags = F.when(F.col("_mark1") == "#", F.array("_own")).otherwise(F.array(F.coalesce("_h1", "_own"), "_own"))
    return rows.where("_mark = ''").select("doc_id", "sec", title.alias("title"), tags.alias("tags"), "line_no", "line")


def infer_mode(title: Column, scope: Column) -> tuple[Column, Column]:
    """Analysis mode and target scopes of a rule."""
    held = F.lower(F.replace(title, F.lit(" "), F.lit("")))
    whole = held.contains("全文") | (scope == "full_document")
    fixed = held.contains("格式") | (scope == "format")
    cross = held.contains("跨") | held.contains("整体")
    mode = F.when(whole, "full_document").when(fixed, "deterministic").when(cross, "cross_section").otherwise("local")
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    targets = F.when(whole, lit("cover", "toc", "foreword", "body", "end")).when(fixed, F.array().cast("array<string>")).when(cross, lit("scope", "normative_references", "terms_definitions", "other_body")).otherwise(F.array(scope))
    return mode, targets


def rule_chunks(lines: DataFrame) -> DataFrame:
    """One row a paragraph of each section, numbered within its book: chunk_id, title, scope, content, source_ref, tags, analysis_mode, target_scopes."""
    # everything is grouped within the document, so its lines are shuffled once
    paras = paragraphs(rule_sections(lines), "sec", ("title", "tags")).where(T.strip(F.col("text")) != "")
    rows = paras.select("doc_id", "sec", "para", T.strip(F.col("text")).alias("content"), "title", F.col("tags").alias("_tags"))
    rows = rows.withColumn("scope", title_scope(F.col("title")))
    mode, targets = infer_mode(F.col("title"), F.col("scope"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("sec", "para"))
    p = F.row_number().over(Window.partitionBy("doc_id", "sec").orderBy("para"))
    return rows.select(
        "doc_id",
        F.format_string("RAG-%04d", n).alias("chunk_id"),
        "title",
        "scope",
        "content",
        F.concat(F.lit("#"), "title", F.lit("-p"), p.cast("string")).alias("source_ref"),
        F.array_distinct(F.concat(F.array("scope", "title"), "_tags")).alias("tags"),
        mode.alias("analysis_mode"),
        targets.alias("target_scopes"),
    )


def retrieval_text() -> Column:
    """What the index reads of a rule: title, content, scope, mode, targets and tags, a line each."""
    return F.concat_ws("\n", "title", "content", "scope", "analysis_mode", F.concat_ws(" ", "target_scopes"), F.concat_ws(" ", "tags"))


def content_rules(rules: DataFrame) -> DataFrame:
    return rules.where("scope <> 'format' and analysis_mode <> 'format_only'")


def rules_for_mode(rules: DataFrame, keys: list[str], include_full: bool) -> DataFrame:
    """Rules of a partial review: local and cross-section ones that aim at an active scope, whole-document ones on request, others always."""
    active = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")
    aimed = F.arrays_overlap("target_scopes", active)
    mode = F.col("analysis_mode")
    return rules.where(F.when(mode.isin("local", "cross_section"), aimed).when(mode == "full_document", F.lit(include_full)).otherwise(True))


def distribution(rules: DataFrame) -> DataFrame:
    """Rules by scope and by mode."""
    sets = rules.groupingSets([["scope"], ["analysis_mode"]], "scope", "analysis_mode").agg(F.count(F.lit(1)).alias("n"))
    return sets.select(F.when(F.col("scope").isNull(), "mode").otherwise("scope").alias("kind"), F.coalesce("scope", "analysis_mode").alias("value"), "n")


def rules_hash(rules: DataFrame) -> DataFrame:
    """SHA-256 of a book's rules in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))), lambda x: x["content"]), "\n")
    return rules.groupBy("doc_id").agg(F.sha2(text, 256).alias("rules_hash"), F.count(F.lit(1)).alias("n_rules"))


def rule_headings(lines: DataFrame) -> DataFrame:
    """(doc_id, rule_id, rule_name, text): the other form of a book, a rule at each H2 to H6; the id stands in the title or is counted."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    pattern = r"^#{2,6}[\x09-\x0D\x20]*([^#\x09-\x0D\x20].*?)[\x09-\x0D\x20]*$"
    rows = lines.withColumn("_title", T.strip(F.regexp_extract("line", pattern, 1)))
    rows = rows.withColumn("_n", F.sum((F.col("_title") != "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_n > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_title") == "", F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    rules = rows.groupBy("doc_id", "_n").agg(F.max("_title").alias("_title"), T.strip(body).alias("text"))
    own = F.upper(F.regexp_extract("_title", r"(?i)([A-Z]{1,4}[-_][0-9]{1,4})", 1))
    name = T.strip(F.regexp_replace("_title", r"^[\[【]?[A-Za-z0-9_.-]+[\]】]?[\x09-\x0D\x20]*", ""))
    return rules.select("doc_id", F.coalesce(F.nullif(own, F.lit("")), F.format_string("R-%03d", "_n")).alias("rule_id"), F.coalesce(F.nullif(name, F.lit("")), "_title").alias("rule_name"), "text")

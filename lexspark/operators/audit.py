"""Format checks over paragraph facts: one row a paragraph, in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

#: Rule numbers of the checks.  Fixed values.
CHECKS = {"chapters": "DOCX-FMT-001", "clauses": "DOCX-FMT-002", "dangling": "DOCX-FMT-003", "lists": "DOCX-FMT-004", "toc": "DOCX-FMT-006"}
MARKER = "^(——|·|[a-z]）|[0-9]+）)"


def _by_order():
    return Window.partitionBy("doc_id").orderBy("idx")


def facts(zoned: DataFrame) -> DataFrame:
    """(doc_id, idx, kind, role, scope, display_heading, text_excerpt) of the non-blank lines of a segmented corpus."""
    held, head = F.col("_held"), F.when(F.col("_head") != "", F.col("_head")).otherwise(F.col("_held"))
    role = (
        F.when(F.col("_toc_title"), "toc_title")
        .when(F.col("zone") == "toc", "toc_entry")
        .when((F.col("_head") != "") & F.col("_kind").isin("foreword", "introduction", "references", "index"), "front_title")
        .when((F.col("_head") != "") & (F.col("_kind") == "appendix"), "appendix_title")
        .when(head.rlike(r"^[0-9]+(?:\.[0-9]+)+"), "clause")
        .when((F.col("_head") != "") & head.rlike("^[0-9]+ "), "chapter")
        .when(F.col("_head") != "", "chapter")
        .otherwise("paragraph")
    )
    rows = zoned.where("_held <> ''").withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))).withColumn("role", role)
    sets = F.when(F.col("_toc_title"), "toc").when(F.col("role").isin("front_title", "appendix_title", "chapter"), F.coalesce("_kind", F.lit("other_body")))
    scope = F.coalesce(F.last(sets, ignorenulls=True).over(_by_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit("cover"))
    return rows.select("doc_id", "idx", F.lit("paragraph").alias("kind"), "role", scope.alias("scope"), F.when(F.col("role") != "paragraph", head).alias("display_heading"), F.substring(held, 1, 300).alias("text_excerpt"))


def _heading():
    return F.coalesce(F.nullif("display_heading", F.lit("")), F.col("text_excerpt"))


CLAUSE = r"^([0-9]+(?:\.[0-9]+)+)[\x09-\x0D\x20]*(.*)$"


def checked(facts: DataFrame) -> DataFrame:
    """Paragraphs with what every check finds, in one pass over a document's rows: ``looked`` and ``found``, a map of check -> reason.

    ``chapters``: chapter numbers that do not go on from the last numbered chapter, from 1.  ``deep`` and ``clauses``: clauses
    deeper than five levels, and every clause of a level where some have a title and some have none; terms are exempt.
    ``dangling``: a paragraph between a chapter and its first clause, or between a clause and a deeper one (the reason stands on
    that paragraph); terms and symbols are exempt.  ``lists`` never fails a row, as its rule is stated.
    """
    w = _by_order()
    rows = facts.where("kind = 'paragraph'").withColumn("_h", _heading())
    style = F.coalesce(F.col("style_name"), F.lit("")) if "style_name" in facts.columns else F.lit("")
    chapter, terms = F.col("role") == "chapter", F.col("scope") == "terms_definitions"
    clause = (F.col("role") == "clause") & ~terms
    rows = rows.withColumns({
        "_n": F.when(chapter, F.nullif(F.regexp_extract("_h", r"^([0-9]+)[\x09-\x0D\x20]+.+$", 1), F.lit("")).try_cast("int")),
        "_number": F.when(clause, F.regexp_extract("_h", CLAUSE, 1)),
        "_titled": F.when(clause & F.col("_h").rlike(CLAUSE), T.strip(F.regexp_extract("_h", CLAUSE, 2)) != ""),
        "_level": T.heading_level(F.col("_h")),
        "_list": style.contains("列项") | F.col("text_excerpt").rlike(MARKER),
    })
    rows = rows.withColumns({
        "_depth": F.when(F.col("_titled").isNotNull(), F.size(F.split("_number", r"\."))),
        "_due": F.coalesce(F.last("_n", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1,
        "_role0": F.lag("role").over(w),
        "_scope0": F.lag("scope").over(w),
        "_level0": F.lag("_level").over(w),
        "_next": F.first(F.when(F.col("role").isin("clause", "chapter"), F.struct("role", "_level")), ignorenulls=True).over(w.rowsBetween(1, 6)),
    })
    level = Window.partitionBy("doc_id", "_depth")
    mixed = F.col("_depth").isNotNull() & F.bool_or("_titled").over(level) & ~F.bool_and("_titled").over(level)
    after = F.col("_role0").isin("chapter", "clause") & ~F.col("_scope0").isin("terms_definitions", "symbols_abbreviations") & (F.col("role") == "paragraph") & (F.col("scope") == F.col("_scope0")) & (F.col("_next.role") == "clause")
    reasons = {
        "chapters": F.when(chapter & F.col("_n").isNull(), "no number").when(chapter & (F.col("_n") != F.col("_due")), F.format_string("number %d, due %d", "_n", "_due")),
        "deep": F.when(F.col("_depth") > 5, F.format_string("depth %d", "_depth")),
        "clauses": F.when(mixed, F.format_string("titles differ at level %d", "_depth")),
        "dangling": F.when(after & ((F.col("_role0") == "chapter") | (F.col("_next._level") > F.col("_level0"))), F.concat(F.lit("after "), "_role0")),
    }
    found = F.map_filter(F.create_map(*[x for k, v in reasons.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    looked = F.array_compact(F.array(F.when(chapter, "chapters"), F.when(clause, "clauses"), F.lit("dangling"), F.when(F.col("_list"), "lists")))
    return rows.select("doc_id", "idx", found.alias("found"), looked.alias("looked"))


def _failures(facts: DataFrame, *names: str) -> DataFrame:
    """Failures (doc_id, idx, reason) of some checks."""
    rows = checked(facts).select("doc_id", "idx", F.explode("found").alias("_k", "reason"))
    return rows.where(F.col("_k").isin(*names)).drop("_k")


def check_chapters(facts: DataFrame) -> DataFrame:
    return _failures(facts, "chapters")


def check_clauses(facts: DataFrame) -> DataFrame:
    return _failures(facts, "deep", "clauses")


def check_dangling(facts: DataFrame) -> DataFrame:
    return _failures(facts, "dangling")


def list_items(facts: DataFrame) -> DataFrame:
    """Paragraphs that the list check looks at; as stated by the rule it never fails one."""
    style = F.coalesce(F.col("style_name"), F.lit("")) if "style_name" in facts.columns else F.lit("")
    return facts.where("kind = 'paragraph'").where(style.contains("列项") | F.col("text_excerpt").rlike(MARKER))


def _check_of(key: Column) -> Column:
    table = {"chapters": "chapters", "deep": "clauses", "clauses": "clauses", "dangling": "dangling", "lists": "lists"}
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, CHECKS[v])])[key]


def evaluations(facts: DataFrame) -> DataFrame:
    """(doc_id, rule_id, checked, failed) of every check that a document has rows for."""
    both = F.concat(F.transform("looked", lambda k: F.struct(_check_of(k).alias("rule_id"), F.lit(1).alias("c"), F.lit(0).alias("f"))), F.transform(F.map_keys("found"), lambda k: F.struct(_check_of(k).alias("rule_id"), F.lit(0).alias("c"), F.lit(1).alias("f"))))
    rows = checked(facts).select("doc_id", F.explode(both).alias("e"))
    return rows.groupBy("doc_id", "e.rule_id").agg(F.sum("e.c").alias("checked"), F.sum("e.f").alias("failed"))


def failures_to_issues(failed: DataFrame, most: int = 20) -> DataFrame:
    """Numbered issues of the first ``most`` failures of each document and rule: the cap is part of the rule.  ``failed`` has doc_id, rule_id, idx, reason."""
    n = F.row_number().over(Window.partitionBy("doc_id", "rule_id").orderBy("idx", "reason"))
    rows = failed.withColumn("_n", n).where(F.col("_n") <= most)
    return rows.select("doc_id", F.concat("rule_id", F.lit("-"), F.lpad(F.col("_n").cast("string"), 3, "0")).alias("issue_id"), "rule_id", "idx", "reason", F.lit("fail").alias("status"), F.lit("中度").alias("severity"))


def format_issues(facts: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """The format track: issues of all row checks, and with ``docs`` one ``info`` issue for each document without facts."""
    failed = checked(facts).select("doc_id", "idx", F.explode("found").alias("_k", "reason")).withColumn("rule_id", _check_of(F.col("_k"))).drop("_k")
    out = failures_to_issues(failed)
    if docs is None:
        return out
    none = docs.select("doc_id").join(facts.select("doc_id"), "doc_id", "left_anti")
    return out.unionByName(none.select("doc_id", F.lit("DOCX-FMT-000-001").alias("issue_id"), F.lit("DOCX-FMT-000").alias("rule_id"), F.lit(None).cast("int").alias("idx"), F.lit("no paragraph facts").alias("reason"), F.lit("info").alias("status"), F.lit("提示").alias("severity")))


def toc_entries(facts: DataFrame) -> DataFrame:
    """Contents rows: number, title, key, page and page scheme, without the contents' own row."""
    title, page = T.title_and_page(F.col("text_excerpt"))
    rows = facts.where("role = 'toc_entry'").withColumns({"_t": title, "page": page})
    number, name = T.number_and_title(F.col("_t"))
    rows = rows.withColumns({"number": number, "title": name}).where(~T.heading_key(F.col("title")).isin("目次", "目录"))
    scheme = F.when(F.regexp_extract("text_excerpt", r"([0-9]+)$", 1) != "", "arabic").when(F.col("page").isNotNull(), "roman")
    return rows.select("doc_id", "idx", "number", "title", T.match_key(F.col("number"), F.col("title")).alias("key"), "page", scheme.alias("page_scheme"))


def heading_facts(facts: DataFrame) -> DataFrame:
    """Headings of the body, keyed like contents rows; clauses of the terms are left out."""
    rows = facts.where("role in ('chapter', 'clause', 'front_title', 'appendix_title') and not (role = 'clause' and scope = 'terms_definitions')")
    number, name = T.number_and_title(F.col("display_heading"))
    rows = rows.withColumns({"number": number, "title": name})
    return rows.select("doc_id", "idx", "number", "title", T.match_key(F.col("number"), F.col("title")).alias("key"))


def align_toc(toc: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, toc_idx, heading_idx): each contents row, in order, takes the first free heading that shares a bookmark with it, else one with its key, else with its title.

    Bookmarks are looked at where both sides have an array ``bookmarks``.  A document's headings are folded over its contents rows, inside the JVM:
    what is carried along is the headings that are still free.  Contents rows without a heading, and headings that no row took, are rows too.
    """
    marks = "bookmarks" in toc.columns and "bookmarks" in headings.columns
    none = F.array().cast("array<string>")
    name = lambda c: T.match_key(F.lit(""), c)

    def row(names: DataFrame) -> Column:
        held = F.coalesce(F.col("bookmarks"), none) if marks else none
        return F.struct(F.col("idx"), F.coalesce("key", F.lit("")).alias("key"), F.coalesce(name(F.col("title")), F.lit("")).alias("title"), held.alias("marks"))

    left = toc.groupBy("doc_id").agg(F.array_sort(F.collect_list(row(toc))).alias("_rows"))
    right = headings.select(F.col("doc_id").alias("h_doc"), row(headings).alias("_h")).groupBy("h_doc").agg(F.array_sort(F.collect_list("_h")).alias("_heads"))
    both = left.join(right, F.col("doc_id") == F.col("h_doc"), "full").select(F.coalesce("doc_id", "h_doc").alias("doc_id"), "_rows", "_heads")
    empty = F.filter(F.coalesce("_heads", F.array()), lambda h: F.lit(False))
    pair = "array<struct<toc_idx:int,heading_idx:int>>"

    def step(s: Column, t: Column) -> Column:
        first = lambda test: F.get(F.filter(s["free"], test), 0)["idx"]
        hit = F.coalesce(
            F.when(F.size(t["marks"]) > 0, first(lambda h: F.arrays_overlap(h["marks"], t["marks"]))),
            F.when(t["key"] != "", first(lambda h: h["key"] == t["key"])),
            F.when(t["title"] != "", first(lambda h: h["title"] == t["title"])),
        )
        free = F.when(hit.isNull(), s["free"]).otherwise(F.filter(s["free"], lambda h: h["idx"] != hit))
        return F.struct(free.alias("free"), F.concat(s["out"], F.array(F.struct(t["idx"].alias("toc_idx"), hit.alias("heading_idx"))).cast(pair)).alias("out"))

    start = F.struct(F.coalesce("_heads", empty).alias("free"), F.array().cast(pair).alias("out"))
    done = both.select("doc_id", F.when(F.col("_rows").isNull(), start).otherwise(F.aggregate("_rows", start, step)).alias("s"))
    left_over = F.transform("s.free", lambda h: F.struct(F.lit(None).cast("int").alias("toc_idx"), h["idx"].alias("heading_idx"))).cast(pair)
    return done.select("doc_id", F.explode(F.concat("s.out", left_over)).alias("p")).select("doc_id", "p.*")


def page_estimate(rows: DataFrame, break_col: str = "is_break", table_col: str = "in_table") -> DataFrame:
    """Page of each row: one plus the breaks outside tables so far; and the breaks inside tables and the tables so far."""
    run = _by_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.col(table_col) & ~F.coalesce(F.lag(table_col).over(_by_order()), F.lit(False))
    rows = rows.withColumn("_open", opened)
    return rows.withColumns({"page": 1 + F.sum((F.col(break_col) & ~F.col(table_col)).cast("int")).over(run), "table_breaks": F.sum((F.col(break_col) & F.col(table_col)).cast("int")).over(run), "tables": F.sum(F.col("_open").cast("int")).over(run)}).drop("_open")


def facts_summary(facts: DataFrame) -> DataFrame:
    """Facts and characters by document and kind."""
    return facts.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("facts"), F.sum(F.length(F.coalesce("text_excerpt", F.lit("")))).cast("long").alias("chars"))

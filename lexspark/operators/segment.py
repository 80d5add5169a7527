"""Documents to lines, sections and scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T

#: What ends a line besides \\n, and \\r\\n as one.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def _split_lines(text: Column) -> Column:
    """A text's lines, split at a single character: other line breaks, where there are any, become that first."""
    plain = F.when(text.rlike(f"[{OTHER_BREAKS}]"), F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), OTHER_BREAKS, "\n" * len(OTHER_BREAKS))).otherwise(text)
    return T.bound(F.split(plain, "\n", -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def _doc():
    return Window.partitionBy("doc_id")


def _by_line():
    return _doc().orderBy("line_no")


def _so_far():
    return _by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line), numbered from 1; a text's closing line break opens no line, null has none."""
    return docs.select("doc_id", F.posexplode(_split_lines(F.col(text_col))).alias("_i", "line")).select("doc_id", (F.col("_i") + 1).alias("line_no"), "line")


def slice_lines(rows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Lines start to end, both included, open where None."""
    kept = rows
    if start is not None:
        kept = kept.where(F.col("line_no") >= start)
    return kept if end is None else kept.where(F.col("line_no") <= end)


def paragraph_ids(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``rows`` with ``fenced`` and ``para``: blank lines part paragraphs unless they stand inside a code fence."""
    mark = T.strip(F.col("line")).startswith("```")
    so_far = Window.partitionBy(*(by or ["doc_id"])).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_fences", F.sum(mark.cast("int")).over(so_far))
    rows = rows.withColumn("fenced", (F.col("_fences") % 2 == 1) | mark)
    gap = (T.strip(F.col("line")) == "") & ~F.col("fenced")
    return rows.withColumn("para", F.sum(gap.cast("int")).over(so_far)).withColumn("_gap", gap).drop("_fences")


def paragraphs(rows: DataFrame, part: str | None = None, held: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, para, text): paragraphs in order, numbered from 1; with ``part``, those of each part of a document, and the columns ``held`` that are one value a part."""
    by = ["doc_id", *([part] if part else [])]
    kept = paragraph_ids(rows, by).where(~F.col("_gap"))
    joined = kept.groupBy(*by, "para").agg(_joined("line", "line_no", "\n").alias("text"), *[F.first(c).alias(c) for c in held])
    return joined.withColumn("para", F.row_number().over(Window.partitionBy(*by).orderBy("para")))


def _joined(value: str, order: str, sep: str) -> Column:
    """Values of a group joined in order."""
    return F.array_join(F.sort_array(F.collect_list(F.struct(order, value))).getField(value), sep)


def _whole():
    return _by_line().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def marked_lines(rows: DataFrame) -> DataFrame:
    """Lines with their marks (:func:`text.line_marks`)."""
    return rows.withColumn("_m", T.line_marks(F.col("line"))).select("*", *[F.col(f"_m.{f}").alias(f"_{f}") for f in ("held", "head", "kind", "toc_title", "code", "opens", "plain", "cut")]).drop("_m")


def zones(rows: DataFrame) -> DataFrame:
    """Lines with ``zone``: cover, toc or body.

    With contents, the body starts at the first opening heading after their title whose next lines
    look like a body: of up to 12 non-blank lines among the next 30, running text before any contents
    row says yes; a heading or two contents rows say no.  Without, it starts at the first classified heading
    or numbered line.  A document's bare lines are shuffled once, before anything is computed of them; its codes are one string, which only opening
    headings look into.
    """
    rows = marked_lines(rows.repartition("doc_id")).withColumn("_codes", F.array_join(F.collect_list("_code").over(_whole()), ""))
    rows = rows.withColumn("_toc", F.min(F.when(F.col("_toc_title"), F.col("line_no"))).over(_whole()))
    ahead = F.substring(F.replace(F.substring(F.col("_codes"), F.col("line_no") + 1, F.lit(30)), F.lit(" "), F.lit("")), 1, 12)
    real = lambda seen: F.when(seen.rlike("^[NH]*[PQ]"), True).when(seen.rlike("^[NH]*T[TN]*[HQ]"), False).when(seen.rlike("^[NH]*T[TN]*P"), True).otherwise(F.length(F.regexp_replace(seen, "[^T]", "")) < 2)
    starts = F.when(F.col("_toc").isNull(), F.col("_plain")).otherwise(F.when(F.col("_opens") & (F.col("line_no") > F.col("_toc")), T.bound(ahead, real)))
    rows = rows.withColumn("_body", F.coalesce(F.min(F.when(starts, F.col("line_no"))).over(_whole()), F.lit(2**31 - 1)))
    return rows.withColumn("zone", F.when(F.col("line_no") >= F.col("_body"), "body").when(F.col("line_no") >= F.col("_toc"), "toc").otherwise("cover")).drop("_codes")


def pieces(zoned: DataFrame) -> DataFrame:
    """(doc_id, _sec, zone, scope, heading, text, line_start, line_end): cover (-2), contents (-1) and the sections of the body in order, without blank ones.

    Appendix, index and references pass their scope on to unclassified sections that follow, until
    a classified one.  One grouping on the document's own partitioning gives all of them.
    """
    body = F.col("zone") == "body"
    sec = F.when(body, F.sum(F.when(body, F.col("_cut")).cast("int")).over(_so_far())).otherwise(F.when(F.col("zone") == "cover", -2).otherwise(-1))
    parts = zoned.withColumn("_sec", sec).groupBy("doc_id", "_sec", "zone").agg(
        T.strip(_joined("line", "line_no", "\n")).alias("text"),
        F.min_by(F.when(F.col("_head") != "", F.col("_head")).otherwise(F.col("_held")), "line_no").alias("heading"),
        F.min_by("_kind", "line_no").alias("_own"),
        F.max("_cut").alias("_any"),
        F.min("line_no").alias("line_start"),
        F.max(F.when(F.col("_held") != "", F.col("line_no"))).alias("line_end"),
    ).where("text <> ''")
    own = F.when(F.col("zone") == "body", F.col("_own"))
    own = F.when(own.isNull() & (F.col("zone") == "body"), T.classify(F.col("heading"))).otherwise(own)
    parts = parts.withColumn("_own", own)
    headless = F.max(F.when(F.col("zone") == "body", F.col("_any").cast("int"))).over(_doc()) == 0  # no section opens at all: one section without a heading
    before = _doc().orderBy("_sec").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("_none", headless).withColumn("_last", F.last("_own", ignorenulls=True).over(before))
    scope = F.when(F.col("zone") != "body", F.col("zone")).when(F.col("_none"), "other_body").otherwise(F.coalesce("_own", F.when(F.col("_last").isin(*T.END_SCOPES), F.col("_last")), F.lit("other_body")))
    heading = F.when((F.col("zone") == "body") & ~F.col("_none"), F.col("heading")).otherwise("")
    return parts.select("doc_id", "_sec", "zone", scope.alias("scope"), heading.alias("heading"), "text", "line_start", "line_end")


def _numbered(parts: DataFrame) -> DataFrame:
    return parts.select("doc_id", F.row_number().over(_doc().orderBy("_sec")).alias("ord"), "scope", "heading", "text", "line_start", "line_end")


def sections(zoned: DataFrame) -> DataFrame:
    """(doc_id, ord, scope, heading, text, line_start, line_end) of the body (:func:`pieces`), numbered anew without blank ones."""
    return _numbered(pieces(zoned).where("zone = 'body'"))


def scope_text(zoned: DataFrame) -> DataFrame:
    """(doc_id, scope, text) of every scope that has text; ``end`` gathers appendix, index and references."""
    scope = F.explode(F.when(F.col("scope").isin(*T.END_SCOPES), F.array("scope", F.lit("end"))).otherwise(F.array("scope")))
    return pieces(zoned).select("doc_id", "_sec", "text", scope.alias("scope")).groupBy("doc_id", "scope").agg(_joined("text", "_sec", "\n\n").alias("text"))


def held_scopes(zoned: DataFrame) -> DataFrame:
    """(doc_id, scopes): the scopes that have text, one row a document that has any."""
    held = pieces(zoned).groupBy("doc_id").agg(F.collect_set("scope").alias("scopes"))
    return held.withColumn("scopes", F.when(F.arrays_overlap("scopes", F.array(*[F.lit(s) for s in T.END_SCOPES])), F.array_append("scopes", F.lit("end"))).otherwise(F.col("scopes")))


def scope_sizes(zoned: DataFrame) -> DataFrame:
    """(doc_id, sizes): characters of each scope's text as a map, without gathering the texts."""
    scope = F.explode(F.when(F.col("scope").isin(*T.END_SCOPES), F.array("scope", F.lit("end"))).otherwise(F.array("scope")))
    n = pieces(zoned).select("doc_id", F.length("text").alias("n"), scope.alias("scope")).groupBy("doc_id", "scope").agg((F.sum("n") + 2 * (F.count(F.lit(1)) - 1)).alias("n"))
    return n.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("scope", "n"))).alias("sizes"))


def body_text(parts: DataFrame) -> DataFrame:
    """(doc_id, text): sections of the body scopes, from the first ``scope`` section on."""
    first = F.min(F.when(F.col("scope") == "scope", F.col("ord"))).over(_doc())
    kept = parts.withColumn("_first", F.coalesce(first, F.lit(0))).where(F.col("scope").isin(*T.BODY_SCOPES) & (F.col("ord") >= F.col("_first")))
    return kept.groupBy("doc_id").agg(_joined("text", "ord", "\n\n").alias("text"))


def scope_map(scopes: DataFrame) -> DataFrame:
    """(doc_id, scopes): every canonical scope as a key, empty where the document has none."""
    held = scopes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("scope", "text"))).alias("_m"))
    keys = F.array(*[F.lit(s) for s in T.SCOPES])
    return held.select("doc_id", F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.element_at("_m", k), F.lit("")))).alias("scopes"))


def line_ranges(zoned: DataFrame) -> DataFrame:
    """First and last non-blank line of each zone."""
    return zoned.where("_held <> ''").groupBy("doc_id", "zone").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))


def toc_items(zoned: DataFrame) -> DataFrame:
    """Titles of contents rows in order, without pages."""
    rows = zoned.where("zone = 'toc' and _held <> '' and not _toc_title").where(~F.col("_held").startswith("#") | (F.col("_head") != ""))
    title = T.squeeze(T.strip_page(F.when(F.col("_held").startswith("#"), F.col("_head")).otherwise(F.col("_held"))))
    return rows.select("doc_id", "line_no", title.alias("title")).where("title <> ''")


def restrict(scopes: DataFrame, keys: list[str], partial: bool = False) -> DataFrame:
    """(doc_id, text): the active scopes joined in canonical order, with a header each in partial mode."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(T.SCOPES) for x in (s, i)])
    kept = scopes.where(F.col("scope").isin(*keys)).withColumn("_o", order[F.col("scope")])
    if partial:
        kept = kept.withColumn("text", F.concat(F.lit("# "), "scope", F.lit("\n"), "text"))
    return kept.groupBy("doc_id").agg(_joined("text", "_o", "\n\n").alias("text"))


def units(zoned: DataFrame) -> DataFrame:
    """Cover, contents, then sections, numbered in that order."""
    return _numbered(pieces(zoned)).withColumn("heading", F.when(F.col("scope").isin("cover", "toc"), F.col("scope")).otherwise(F.col("heading"))).select("doc_id", "ord", "scope", "heading", "text")


#: Words of headings for documents that the line rules find no sections in, in order of precedence.  Fixed values.
FALLBACK_WORDS = (
    ("scope", ("范围",)),
    ("normative_references", ("规范性引用", "引用文件")),
    ("terms_definitions", ("术语", "定义")),
    ("toc", ("目次", "目录")),
    ("foreword", ("前言",)),
    ("cover", ("封面",)),
)


def fallback_split(rows: DataFrame) -> DataFrame:
    """(doc_id, scope, text): the first region of each class, regions opened by Markdown headings; without headings all is ``other_body``."""
    mark = r"^#{1,6}[\x09-\x0D\x20]+(.+?)[\x09-\x0D\x20]*$"
    rows = rows.withColumn("_title", T.strip(F.regexp_extract("line", mark, 1)))
    rows = rows.withColumn("_sec", F.sum((F.col("_title") != "").cast("int")).over(_so_far()))
    rows = rows.withColumn("_none", F.max("_sec").over(_doc()) == 0).where("_none or _sec > 0")
    regions = rows.groupBy("doc_id", "_sec").agg(F.max("_title").alias("_title"), T.strip(_joined("line", "line_no", "\n")).alias("text"))
    scope = F.lit("other_body")
    for name, words in reversed(FALLBACK_WORDS):
        test = F.lit(False)
        for w in words:
            test = test | F.col("_title").contains(w)
        scope = F.when(test, name).otherwise(scope)
    return regions.groupBy("doc_id", scope.alias("scope")).agg(F.min_by("text", "_sec").alias("text"))


def body_headings(texts: DataFrame) -> DataFrame:
    """(doc_id, line_no, heading) of a body text: lines with a heading mark or a number in front."""
    rows = lines(texts).withColumn("_held", T.strip(F.col("line")))
    marked = F.col("_held").startswith("#")
    head = T.squeeze(F.when(marked, F.regexp_replace("_held", r"^#[\x09-\x0D\x20]*", "")).otherwise(F.col("_held")))
    return rows.where(marked | F.col("_held").rlike(r"^[0-9]+(\.[0-9]+)*[\x09-\x0D\x20]+")).select("doc_id", "line_no", head.alias("heading")).where("heading <> ''")
